"""The methods themselves against plain versions."""

import random
import re
import struct
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quillspark.llm import embedding_dedup, html_extract, media, mixing, packing, pii, shingle_dedup, simhash_dedup, suffix_dedup, toxicity
from quillspark.llm.common import connected_components


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(x):
    assert suffix_dedup.suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=400, max_size=900))
def test_every_window_has_one_anchor(data):
    first, count, at, _ = suffix_dedup.anchors(np.frombuffer(data, np.uint8))
    assert count.sum() == len(data) - 399 and (np.diff(first) == count[:-1]).all() and ((at >= first + count - 1) & (at <= first + 200)).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=16, max_size=60), st.booleans()), min_size=1, max_size=8))
def test_repeated_starts_are_those_of_brute_force(rows):
    """Segments with one anchor gram ("XY") in them: windows of 16 bytes around it that stand at two places."""
    segs = []
    for body, alone in rows:
        at = len(body) // 2
        body = body[:at] + "XY" + body[at:]
        lo, hi = max(0, at + 2 - 16), min(at, len(body) - 16)
        if lo <= hi:
            segs.append((body[lo : hi + 16].encode(), at - lo, hi - lo + 1, alone))
    if not segs:
        return
    frame = pd.DataFrame({"k": range(len(segs)), "tie": 0, "lo": 100, "cnt": [c for _, _, c, _ in segs], "at": [a for _, a, _, _ in segs], "alone": [x for *_, x in segs], "seg": [s for s, *_ in segs]})
    seen = Counter(s[p : p + 16] for s, _, c, _ in segs for p in range(c))
    want = {(k, 100 + p) for k, (s, _, c, alone) in enumerate(segs) for p in range(c) if alone and seen[s[p : p + 16]] > 1}
    got = suffix_dedup.repeated_starts(frame, match=16, step=4)
    assert {(k, lo + i) for k, lo, cnt in zip(got["k"], got["lo"], got["cnt"]) for i in range(cnt)} == want


def test_labels_without_signal_judge_none_toxic(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i % 3}") for i in range(20)], "doc_id long, text string")
    kinds = {"one class": lambda i: 1, "none": lambda i: 0, "contradictory": lambda i: i // 3 % 2}
    for name, toxic in kinds.items():
        labels = spark.createDataFrame([(i, 1, toxic(i)) for i in range(20)], "doc_id long, quality int, toxic int")
        assert toxicity.judge(docs, toxicity.fit_chain(docs, labels)).filter("is_toxic").count() == 0, name


def test_judge_replaces_columns_with_its_names(spark):
    docs = spark.createDataFrame([(1, "a", 7, "x", 3.0)], "doc_id long, text string, is_toxic int, P_toxic string, other double")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs, toxicity.fit_chain(docs, labels))
    assert got.columns == ["doc_id", "text", "other", "p_low_quality", "p_toxic", "p_toxic_low_quality", "is_toxic"] and got.first()["is_toxic"] is False


def test_bk_tree():
    random.seed(1)
    words = [random.getrandbits(64) for _ in range(50)]
    words += [w ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for w in words]
    tree = simhash_dedup.BKTree()
    for w in words:
        tree.add(w)
    for w in words:
        assert sorted(tree.within(w, 2)) == sorted(x for x in words if (x ^ w).bit_count() <= 2)


@pytest.mark.parametrize("largest", (4096, 2))
def test_radius_links_connect_what_pairs_do(spark, largest):
    random.seed(2)
    words = list({w ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) & (1 << 64) - 1 for w in [random.getrandbits(64) for _ in range(20)] for _ in range(12)})
    root = {w: w for w in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(words):
        for b in words[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    links = simhash_dedup.radius_links(spark.createDataFrame([(signed(w),) for w in words], "fp long"), largest=largest)
    comp = {r.node & (1 << 64) - 1: r.component for r in connected_components(links).collect()}
    groups = {}
    for w in words:
        groups.setdefault(find(w), set()).add(w)
    for g in groups.values():
        assert len({comp.get(w, signed(w)) for w in g}) == 1
    assert len(set(comp.values())) == sum(len(g) > 1 for g in groups.values())


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[1001] == got[1000] == 1000


def test_shortest_pack_first_places_every_piece_once():
    random.seed(5)
    h = {random.randrange(1, 2049): random.randrange(1, 50) for _ in range(200)}
    used, seen = {}, {}
    for size, rank, count, first, offset in packing.shortest_pack_first(h):
        assert rank == seen.get(size, 0)
        seen[size] = rank + count
        for s in range(first, first + count):
            assert used.get(s, 0) == offset
            used[s] = offset + size
    assert seen == h and max(used.values()) <= 2048 and sum(k * v for k, v in h.items()) / len(used) / 2048 > 0.9


def test_water_filling_clamps_and_reshares(spark):
    d = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(d, mixing.F.lit(1.5 * 1115)).collect()}
    caps, w, t = {"a": 20, "b": 200, "c": 2000, None: 10}, {"a": 5, "b": 2, "c": 1, None: 5}, 1.5 * 1115
    want, free = {}, set(caps)
    while True:
        left = t - sum(want.values())
        share = {k: left * w[k] / sum(w[x] for x in free) for k in free}
        over = {k for k in free if share[k] > caps[k]}
        if not over:
            want |= share
            break
        want |= {k: caps[k] for k in over}
        free -= over
    assert got == pytest.approx(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_lines_are_a_longest_subsequence(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    got = [x for x, k in zip(a, html_extract.common_lines(a, b)) if k]
    rest = iter(b)
    assert len(got) == d[-1][-1] and all(x in rest for x in got)


def test_shared_lines_go_without_landmarks():
    page = "<html><body><p>Site name</p><p>Own story {0}</p><p>Terms of use</p></body></html>"
    assert html_extract.main_text(page.format(1), page.format(2))[0] == "Own story 1"
    assert html_extract.main_text("<article>a<div class='comment'>c</div><aside>s</aside></article><footer>f</footer>", None)[0] == "a"


def test_inline_furniture_and_slashes():
    text = lambda page: html_extract.main_text(page, None)[0]
    assert text('<article><p>Text <span class="ad">Buy now</span> more</p></article>') == "Text more"
    assert text("<nav class=x href=/b/>menu</nav><p>body</p>") == "body" and text("<div/>a<p>b</p>") == "a b"
    assert text("<svg/><p>a</p><svg><text>b</text></svg>") == "a" and text("<article><p>a <b class=comment>x</b></p><p>b</article>") == "a b"


def test_shared_lines_decide_outside_landmarks():
    page = "<div><p>Site name</p></div><article><p>A line in common</p><p>Own story number {0}, with words enough</p></article><div>Terms of use</div>"
    assert html_extract.main_text(page.format(1), page.format(2)) == ("A line in common Own story number 1, with words enough", 4, 2)
    teaser = "<article><p>Teaser</p></article><div><p>The long text of page {0} stands outside of the element</p></div><p>Long shared terms of use, the same on every page of the site</p>"
    assert html_extract.main_text(teaser.format(1), teaser.format(2))[0] == "Teaser The long text of page 1 stands outside of the element"
    copy = "<p>One and the same article in two places</p>"
    assert html_extract.main_text(copy, copy)[0] == "One and the same article in two places"


def test_main_text_query_is_that_of_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        host, path = rng.choice(["a.example", "b.example", "a.example", "a.example", "A.example"]), f"/{rng.randrange(9)}/{rng.randrange(9)}"
        blocks = [rng.choice(["Home", "Terms", f"story {rng.randrange(40)} of some length", "Share", f"own {i}"]) for _ in range(rng.randrange(7))]
        body = "".join(rng.choice(["<p>{}</p>", "<article><p>{}</p></article>", "<div class=ad>{}</div>"]).format(b) for b in blocks)
        rows.append((i, f"http://{host}{path}" if rng.random() > 0.05 else None, body if rng.random() > 0.05 else None))
    rows += rows[:10] + rows[5:8]
    ordered = sorted(rows, key=lambda r: ((r[1] or "").lower()[7:16], (r[1] or "")[16:], str(r[0])))
    want = Counter()
    for n, (i, u, h) in enumerate(ordered):
        mine = [t for t, _ in html_extract.lines(h)]
        near = None
        for step in (-1, 1):
            m = n + step
            while near is None and 0 <= m < len(ordered) and (ordered[m][1] or "").lower()[7:16] == (u or "").lower()[7:16]:
                other = [t for t, _ in html_extract.lines(ordered[m][2])]
                near = other if other != mine else None
                m += step
        d = {}
        for a in range(len(mine), -1, -1):
            for b in range(len(near or []), -1, -1):
                d[a, b] = 0 if a == len(mine) or b == len(near or []) else d[a + 1, b + 1] + 1 if mine[a] == near[b] else max(d[a + 1, b], d[a, b + 1])
        text, blocks, _ = html_extract.main_text(h, None if near is None else next(r[2] for r in ordered if [t for t, _ in html_extract.lines(r[2])] == near))
        assert len(html_extract.shared_lines(mine, near)) == (d[0, 0] if near is not None else 0)
        want[(i, u, text, len(text), blocks)] += 1
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars, r.n_blocks) for r in got) == want


def video(sizes, keys):
    """An MP4 with one track of variable samples in chunks of two, and keyframes."""
    pairs = [sizes[i : i + 2] for i in range(0, len(sizes), 2)]
    ftyp = media.box(b"ftyp", b"isom", bytes(4))
    base, offsets = len(ftyp) + 8, []
    for p in pairs:
        offsets.append(base)
        base += sum(p)
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    entry = media.box(b"avc1", bytes(78), media.box(b"avcC", bytes([1, 0x64, 0, 0x28])))
    stsc = u(1, 1, 2, 1) if len(sizes) % 2 == 0 else u(2, 1, 2, 1, len(pairs), 1, 1)
    stbl = media.box(b"stbl", media.full(b"stsd", u(1), entry), media.full(b"stts", u(1, len(sizes), 512)), media.full(b"stsc", stsc), media.full(b"stsz", u(0, len(sizes), *sizes)),
                     media.full(b"stco", u(len(offsets), *offsets)), media.full(b"stss", u(len(keys), *keys)))
    mdia = media.box(b"mdia", media.full(b"mdhd", u(0, 0, 12800, 512 * len(sizes), 0)), media.full(b"hdlr", bytes(4), b"vide", bytes(13)), media.box(b"minf", stbl))
    return ftyp + media.box(b"mdat", bytes(sum(sizes))) + media.movie(media.box(b"trak", media.full(b"tkhd", u(0, 0, 7), bytes(72)), mdia), 12800, 512 * len(sizes))


def test_keyframe_ranges():
    status, brand, tracks = media.parse(video([10, 20, 30, 40, 50], [1, 4, 5]))
    t = tracks[0]
    assert (status, brand, t["codec"], t["track_id"], t["duration_s"], t["samples"], t["bytes"]) == ("ok", "isom", "avc1.640028", 7, 0.2, 5, 150)
    base = 24
    assert [(k["start"] - base, k["length"], k["first_sample"], k["samples"]) for k in t["keyframes"]] == [(0, 10, 0, 1), (60, 90, 3, 2)]


def test_compact_sizes_codecs_and_fragments():
    u = lambda *x: struct.pack(f">{len(x)}I", *x)

    def parsed(stsz, entry, samples=0, handler=b"vide", after=b"", extends=b"", offset=0):
        stbl = media.box(b"stbl", media.full(b"stsd", u(1), entry), media.full(b"stts", u(*([1, samples, 1] if samples else [0]))), media.full(b"stsc", u(*([1, 1, samples, 1] if samples else [0]))), stsz, media.full(b"stco", u(*([1, offset] if samples else [0]))))
        mdia = media.box(b"mdia", media.full(b"mdhd", u(0, 0, 1000, samples, 0)), media.full(b"hdlr", bytes(4), handler, bytes(13)), media.box(b"minf", stbl))
        moov = media.box(b"moov", media.full(b"mvhd", bytes(96)), media.box(b"trak", media.full(b"tkhd", u(0, 0, 7), bytes(72)), mdia), extends)
        data = moov + after
        return media.parse(data)[2][0] if media.parse(data)[0] == "ok" else media.parse(data)

    for bits, packed in ((4, bytes([0x12, 0x30])), (8, bytes([1, 2, 3])), (16, struct.pack(">3H", 1, 2, 3))):
        t = parsed(media.full(b"stz2", bytes([0, 0, 0, bits]), u(3), packed), media.box(b"raw ", bytes(78)), 3, after=media.box(b"mdat", bytes(9)))
        assert (t["samples"], t["bytes"], t["keyframes"][0]["length"]) == (3, 6, 6)
    empty = media.full(b"stsz", u(0, 0))
    hvc = media.box(b"hvc1", bytes(78), media.box(b"hvcC", bytes([1, 1]), u(0x60000000), bytes(6), bytes([93]), bytes(10)))
    aac = media.box(b"mp4a", bytes(28), media.full(b"esds", bytes([3, 25, 0, 1, 0, 4, 17, 0x40, 0x15]), bytes(11), bytes([5, 2, 0x12, 0x10])))
    av1 = media.box(b"av01", bytes(78), media.box(b"av1C", bytes([0x81, 0x04, 0x40, 0])))
    assert parsed(empty, hvc)["codec"] == "hvc1.1.6.L93" and parsed(empty, aac, handler=b"soun")["codec"] == "mp4a.40.2" and parsed(empty, av1)["codec"] == "av01.0.04M.10"
    extends = media.box(b"mvex", media.full(b"trex", u(7, 1, 0, 5, 0x10000)))

    def fragment(*sizes, first=0):
        run = lambda place: media.full(b"trun", u(len(sizes), place, first, *sizes), flags=0x205)
        moof = lambda place: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", u(7), flags=0x20000), run(place)))
        return moof(len(moof(0)) + 8) + media.box(b"mdat", bytes(sum(sizes)))

    one = fragment(10, 20, 30)
    t = parsed(empty, hvc, after=one + fragment(7, 8), extends=extends)
    a, b = t["keyframes"]
    assert (t["samples"], t["bytes"], a["length"], a["first_sample"], b["length"], b["first_sample"]) == (5, 75, 10, 0, 7, 3) and b["start"] - a["start"] == len(one) - 4  # its table is one entry shorter
    assert parsed(empty, hvc, after=one[:-1], extends=extends)[0].startswith("malformed")


def test_broken_media_has_a_reason(spark):
    whole = video([10, 20], [1])
    rows = [(i, bytearray(whole[:n])) for i, n in enumerate((0, 4, 30, len(whole) - 9, len(whole)))] + [(9, None)]
    got = {r.id: r for r in media.probe(spark.createDataFrame(rows, "id long, content binary")).collect()}
    assert got[0].status == got[9].status == "empty" and got[4].status == "ok" and all(got[i].status.startswith("malformed") for i in (1, 2, 3))
    assert got[4].tracks[0].keyframes[0].length == 10


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300_000))
def test_pcm_round_trip(data):
    stored = media.pcm_container(data)
    _, _, tracks = media.parse(stored)
    assert b"".join(stored[k["start"] : k["start"] + k["length"]] for k in tracks[0]["keyframes"]) == data


def test_surrogates_stay_distinct_and_alike(spark):
    mails = [f"user{i}@mail{i % 3}.example.com" for i in range(200)]
    ips = [f"10.0.{i // 250}.{i % 250}" for i in range(300)]
    names = [f"Mr. A{c}len B{d}den" for c in "abcdefghij" for d in "abcdefghij"]
    rows = [(i, f"see {x} and {x}.") for i, x in enumerate([*mails, *ips, *names])]
    got = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    new = [got[i][4 : got[i].index(" and ")] for i in range(len(rows))]
    assert all(got[i] == f"see {n} and {n}." for i, n in enumerate(new)) and len(set(new)) == len(rows)
    assert not set(new) & {*mails, *ips, *names} and all(n.startswith("Mr. ") for n in new[500:])
    assert len({n.split()[1] for n in new[500:]}) == 10


def test_full_formats_end_and_domains_stay_apart(spark):
    mails = [f"{c}@mail.example" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"user@{c}{d}.org" for c in "abcdefgh" for d in "abcdefghijklmnopqrstuvwxyz0123456789"]
    got = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(list(enumerate(mails)), "doc_id long, text string")).collect()}
    assert len(set(got.values())) == len(mails) and not set(got.values()) & set(mails)
    domain = lambda x: x.split("@")[1]
    assert len({domain(got[i]) for i in range(26)}) == 1 and len({domain(got[i]) for i in range(26, len(mails))}) == len(mails) - 26


def test_entities_in_null_long_repeated_and_crossed_rows(spark):
    card, no_card = "4111 1111 1111 1111", "4111 1111 1111 1112"
    text = f"Mr. John Smith ({card}) met MR. SMITH? no, Mr. Smith and Mrs. Jane Smith; {no_card}, 1.2.3.4"
    rows = [(1, text, "x", 1), (1, text, "x", 1), (2, None, None, None), (3, "word " * 200_000 + "mail a.b@c.example", "y", 2), (None, "call +1 (980) 555-2833 or +1 980 555 2833", "z", 3)]
    got = pii.replace(spark.createDataFrame(rows, "doc_id long, text string, body string, tries int")).collect()
    by = {r.doc_id: r for r in got}
    one = by[1].text
    assert len(got) == 5 and sum(r.text == one for r in got) == 2 and by[2].text is None and by[2].n_entities == 0
    first, second, third = re.findall(r"Mrs?\. (\w+ ?\w*)(?= \(| and|;)", one)
    assert first.split()[1] == second == third.split()[1] != "Smith" and first.split()[0].endswith("o") and third.split()[0].endswith("a")
    assert no_card in one and card not in one and "1.2.3.4" not in one and sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(re.search(r"\((\d{4} \d{4} \d{4} \d{4})\)", one)[1].replace(" ", ""))) % 10 == 0
    assert by[3].n_entities == 1 and by[3].text.startswith("word word") and "a.b@c.example" not in by[3].text
    a, b = re.search(r"call (.*) or (.*)", by[None].text).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and a.startswith("+1 (") and by[None].n_entities == 2


def test_chain_on_held_out_rows():
    rng = np.random.default_rng(6)
    vocabulary = {f"w{i}": i for i in range(300)}
    x = (rng.random((1500, 300)) < 0.05).astype(np.uint8)
    low, tox = x[:, 3] | x[:, 4], x[:, 7] | x[:, 8] | (x[:, 3] & x[:, 9])
    y = np.stack([low, tox, low & tox], axis=1).astype(float)
    chain = toxicity.train(x[:1000], y[:1000], np.arange(1000) % 3, ["low", "tox", "both"], "tox", vocabulary).trimmed()
    names = list(chain.vocabulary)
    p = chain.probabilities(x[1000:][:, [vocabulary[n] for n in names]])
    assert ((p[:, 1] >= chain.threshold) == (tox[1000:] > 0)).mean() > 0.97


def test_projection_passes_recall(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((150, 32))
    rows = [(i * 4 + j, [float(v) for v in b + rng.standard_normal(32) * 0.2 * (j > 0)], i % 3) for i, b in enumerate(base) for j in range(4)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), window=32).collect()
    x = np.array([np.float32(v) for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None]) & ~np.eye(len(x), dtype=bool)
    links = {r.vec_id: r.n_links for r in got}
    assert all(links[i] <= near[i].sum() for i in range(len(x))) and sum(links.values()) >= 0.9 * near.sum()


@pytest.mark.parametrize("large, block", ((64, 512), (3, 2)))
def test_shingle_components_are_those_of_all_pairs(spark, monkeypatch, large, block):
    monkeypatch.setattr(shingle_dedup, "LARGE", large)
    monkeypatch.setattr(shingle_dedup, "BLOCK", block)
    monkeypatch.setattr(shingle_dedup, "COMMON", 5)
    random.seed(8)
    texts = []
    for g in range(12):
        base = [f"w{random.randrange(40 if g % 3 == 0 else 4000)}" for _ in range(random.randrange(3, 200))]
        for _ in range(12):
            copy = list(base)
            for _ in range(random.randrange(1 + len(base) // 25)):
                copy[random.randrange(len(copy))] = f"v{random.randrange(999)}"
            texts.append(" ".join(copy))
    texts += ["", " ", "a b", "A b", "one common line of words here " + texts[0]]
    sets = [set(zip(*(w[i:] for i in range(min(5, len(w)))))) for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.id: r.component_id for r in shingle_dedup.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_near_duplicate_stage_drops_edited_copies(spark):
    words = [f"word{i * i % 997}x{i}" for i in range(300)]
    rows = []
    for k in range(6):
        w = list(words)
        if k:
            w[40 * k], w[40 * k + 11] = f"new{k}", f"other{k}"
        rows.append((k, " ".join(w), "en", "s", 1))
    rows.append((9, " ".join(words[::-1]), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 9]
