"""Main text of pages whose article was marked by hand: no word of it may be lost and none of the rest may come."""

import pytest

from quillspark.llm import html_extract

MENU = "<nav><ul><li><a href='/'>Home</a><li><a href='/b'>More</a></ul></nav>"
FOOT = "<footer>&copy; site <a href='#'>terms</a></footer>"
BAR = "<div class='topbar'><p>Daily Planet</p><p>Sections</p></div>"
LINKS = "<div><p>About us</p><p>Contact</p></div>"
ONE, TWO, HEAD = "First words of the story.", "Second &amp; last words.", "The title"
TEXT = f"<h1>{HEAD}</h1><p>{ONE}</p><p>{TWO}</p>"
FULL, BODY = f"{HEAD} {ONE} Second & last words.", f"{ONE} Second & last words."
OTHER = "<h1>Something else</h1><p>Another story stands here.</p><p>It has its own end.</p>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{body}<script>var x='<p>no</p>';</script></body></html>"


#: name, page with {} for the article's text, what of the text comes (FULL unless told), text of the page itself
LAYOUTS = [
    ("article alone", "<article>{}</article>"),
    ("article with furniture around", MENU + "<header>Brand</header><div class='ad'>Buy</div><article>{}</article><aside>Side</aside>" + FOOT),
    ("main", MENU + "<main>{}</main>" + FOOT),
    ("main below a marked wrapper", "<div class='sidebar'><main>{}</main></div>"),
    ("class that tells of no adverts", "<main><div class='promo-free content'>{}</div></main>"),
    ("paragraphs without adverts", "<article><div class='ad-free'>{}</div></article>"),
    ("paragraphs without comments", "<article><section class='no-comments'>{}</section></article>"),
    ("long name that mentions a mark", "<main><div id='comment-on-the-new-budget'>{}</div></main>"),
    ("heading named like furniture", "<main><div>{}</div></main>".replace("{}", TEXT.replace("<h1>", "<h1 id='comment-on-the-budget'>")), TEXT),
    ("heading of one marked word", "<main><div>{}</div></main>".replace("{}", TEXT.replace("<h1>", "<h1 class='banner'>")), TEXT),
    ("header image is no header", "<article><div class='header-image-text'>{}</div></article>"),
    ("comments below the article", "<article>{}</article><section class='comments'><p>Nice one</p></section>"),
    ("comments in the article", "<article>{}<section class='user-discussion'><p>Nice one</p></section></article>"),
    ("comment list", "<article>{}<ol class='comment-list'><li>Nice</li><li>No</li></ol></article>"),
    ("comments by id", "<main>{}<div id='disqus_thread'>Loading</div><div id='comments'><p>Hi</p></div></main>"),
    ("comments as articles", "<article>{}</article><article class='comment'><p>Me too</p></article>"),
    ("teaser article", "<article>{}</article><article class='teaser'><h2>Next</h2><p>Read on</p></article>"),
    ("related stories in the article", "<article>{}<div class='related-stories'><a>Other</a></div></article>"),
    ("share buttons", "<article><ul class='share-buttons'><li>Tweet</li></ul>{}</article>"),
    ("newsletter form", "<article>{}<form><p>Subscribe</p><button>Go</button></form></article>"),
    ("cookie notice", "<div id='cookie-banner'>We use cookies</div><article>{}</article>"),
    ("roles", "<div role='navigation'>Go</div><div role='main'><article>{}</article></div><div role='contentinfo'>c</div>"),
    ("header of the article stays", "<article><header><h1>The title</h1></header><p>First words of the story.</p><p>Second &amp; last words.</p></article>", TEXT),
    ("aside in the article", "<article>{}<aside><p>By the way</p></aside></article>"),
    ("advert between paragraphs", "<article><h1>The title</h1><p>First words of the story.</p><div class='ad-slot'>Buy</div><p>Second &amp; last words.</p></article>", TEXT),
    ("inline advert", "<article><h1>The title</h1><p>First words of the story.<span class='ad'>Buy</span></p><p>Second &amp; last words.</p></article>", TEXT),
    ("data attributes say nothing", "<article><div data-class='ad' data-id='comments'>{}</div></article>"),
    ("unclosed paragraphs", "<article><h1>The title</h1><p>First words of the story.<p>Second &amp; last words.</article>", TEXT),
    ("camel case", "<article>{}<div class='commentList'>Hi</div></article>"),
    ("nested article", "<main><div class='wrap'><article>{}</article></div><div class='sidebar-right'>x</div></main>"),
    ("divs only", BAR + "<div id='story'>{}</div>" + LINKS),
    ("divs with a body class", BAR + "<div class='post-body entry'>{}</div>" + LINKS),
    ("table layout", "<table><tr><td><p>Daily Planet</p><td>{}<td><p>Contact</p></table>"),
    ("section", BAR + "<section>{}</section>" + LINKS),
    ("divs with marked parts", BAR + "<div class='ads'>Buy now</div><div>{}</div><div class='comments'><p>First!</p></div>" + LINKS),
    ("no element at all", BAR + "{}" + LINKS),
    ("open mark, own text", BAR + "<div class='main-header-story'>{}</div>" + LINKS),
    ("only a marked block", BAR + "<div class='promo'>{}</div>" + LINKS),
    ("footer in a div", BAR + "<div>{}</div><div class='site-footer'>all rights</div>"),
    ("definition list", BAR + "<dl><dt>The title<dd>First words of the story.<dd>Second &amp; last words.</dl>" + LINKS, TEXT),
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=[x[0] for x in LAYOUTS])
def test_the_article_and_nothing_else(layout):
    form = layout[1]
    mine = page(form.replace("{}", TEXT))
    partner = page(form.replace(TEXT, "{}").replace("{}", OTHER) if "{}" in form or TEXT in form else form.replace(HEAD, "Something else").replace(ONE, "Another story.").replace(TWO, "Its end."))
    assert html_extract.main_text(mine, partner)[0] == FULL
    if "<article" in form or "<main" in form:  # the page's own elements are enough
        assert html_extract.main_text(mine, None)[0] == FULL


def test_pages_that_a_spark_job_pairs(spark):
    """The same over the operator: layouts as hosts of two pages each."""
    rows, want = [], {}
    for n, layout in enumerate(LAYOUTS):
        form = layout[1]
        other = form.replace(TEXT, "{}").replace("{}", OTHER) if "{}" in form or TEXT in form else form.replace(HEAD, "Something else").replace(ONE, "Another story.").replace(TWO, "Its end.")
        rows += [(2 * n, f"http://h{n}.example/a", page(form.replace("{}", TEXT))), (2 * n + 1, f"http://h{n}.example/b", page(other))]
        want[2 * n] = FULL
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: got[k] for k in want} == want


def test_a_shared_block_below_an_open_mark_goes_and_an_own_one_stays():
    form = "<article><div class='header-notice-strip x'>{}</div><p>{}</p></article>"
    assert html_extract.main_text(page(form.format("Site wide", "Mine")), page(form.format("Site wide", "Yours")))[0] == "Mine"
    assert html_extract.main_text(page(form.format("Only here", "Mine")), page(form.format("Only there", "Yours")))[0] == "Only here Mine"
