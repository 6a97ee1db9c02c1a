"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quillspark.llm import embedding_dedup, html_extract, line_dedup, media, mixing, packing, pii, simhash_dedup, suffix_dedup, toxicity

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
PASSAGE = "\n".join(f"line {i} " + "abc def " * 6 + str(i * i) for i in range(12))
ROWS = [
    (1, "a b c d e", "en", "s1", 9), (2, None, "en", "s1", None), (3, "", None, "s2", 0), (4, LONG, "en", None, len(LONG)), (5, "start\n" + PASSAGE + "\nend one", "en", "s2", 1),
    (6, "other\n" + PASSAGE + "\nend two", "en", "s2", 1), (7, "a b c d e", "de", "s1", 9), (7, "a b c d e", "de", "s1", 9), (None, "no key here", "en", "s3", 11), (8, "Ünï ✓ 漢字 <|endoftext|>", "fr", "s3", 5),
    (9, "x" * 5000, "en", "s1", 5000), (10, " \t\n ", "en", "s1", 4),
]
CLASH = "body string, k long, tie long, fp long, name string, pos int, line string, size long, taken long, id string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *(["?", 1, 2, 3, "n", 4, "l", 5, 6, "i"])) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def data(text):
    return (text or "").encode()


def test_media(docs, none):
    got = media.media_digests(docs).collect()
    assert len(got) == len(ROWS)
    want = Counter()
    for i, t, *_ in ROWS:
        p = data(t)
        p += bytes(-len(p) % 64 or (0 if p else 64))
        want[(i, len(data(t)), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert media.media_digests(none).count() == 0


def test_line_runs(docs, none):
    got = line_dedup.drop_repeats(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    kept = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ROWS) and kept[5].text == ROWS[4][1] and kept[6].text == "other\nend two" and kept[6].n_removed == 12 and kept[2].text is None
    assert line_dedup.drop_repeats(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for rows in (docs, none):
        chain = toxicity.fit_chain(rows, labels)
        assert toxicity.judge(rows, chain).count() == rows.count()


def test_html(spark):
    rows = [(1, "http://h/a", "<p>x</p><article><p>main &amp;\n text<p>two</article>"), (2, None, None), (3, "http://h/b", ""), (4, "http://h/b", ""), (None, "//h/c", "<div>plain <b>bo</b>ld</div>" + "<p>z</p>" * 3000)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame([(*r, "?", "?") for r in rows], "page_id long, url string, html string, page string, host string")).collect()}
    assert len(got) == 5 and got[1].text == "main & text two" and got[2].text == got[3].text == "" and got[None].text.startswith("plain bold z z")
    assert got[1].n_chars == len(got[1].text)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_surrogates(docs, none):
    got = pii.replace(docs)
    assert sorted(map(str, (r.text for r in got.collect()))) == sorted(str(r[1]) for r in ROWS) and pii.replace(none).count() == 0


def test_suffixes(docs, none):
    texts = [data(r[1]) for r in ROWS]
    starts = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    got = defaultdict(list)
    for r in suffix_dedup.remove_repeats(docs).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    for (i, *_), t in zip(ROWS, texts):
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 399):
            if starts[t[p : p + 400]] > 1:
                gone[p : p + 400] = 1
        kept = bytes(c for c, g in zip(t, gone) if not g)
        assert (len(t), int(gone.sum()), int((np.diff(np.append(0, gone)) == 1).sum()), hashlib.sha256(kept).hexdigest()) in got[i]
    crowded = suffix_dedup.remove_repeats(docs, largest=1)
    assert sorted(map(str, crowded.collect())) == sorted(map(str, suffix_dedup.remove_repeats(docs).collect()))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_mixture(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    assert all(sum(r.taken for r in rs) == round(rs[0].target) for rs in by.values())
    assert mixing.mix(none).count() == 0 and mixing.take(none).count() == 0
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and sum(len(r.text.split()) for r in taken.collect()) == sum(r.taken for r in got)


def test_embeddings(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e, 1), (2, e, 1), (3, [1.0, 0.1, 0.0], 1), (4, e, 2), (5, None, 1), (6, [0.0] * 3, 1), (7, [1.0, None, 0.0], 1), (8, [float("nan"), 1.0, 0.0], 1), (9, e, None), (10, [1.0, 0.0], 1), (11, [], 1), (12, [0.0, 1.0, 0.0], 1)]
    d = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, row long, grp long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(d).collect()}
    assert got == {i: (2, 1, i == 1) if i < 4 else (0, i, True) for i in range(1, 13)}
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    cache = packing.WordCache(packing.tokenizer_path())
    want = Counter()
    for i, t, *_ in ROWS:
        ids = cache.encode([t or ""])[0] + [1]
        for s in range(0, len(ids), 2048):
            want[(i, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(none).count() == 0


def brute_print(text):
    words = bytes(data(text)).lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("largest", (simhash_dedup.LARGEST_TREE, 1))
def test_simhash(docs, none, largest):
    got = simhash_dedup.near_duplicates(docs, largest=largest).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{brute_print(t):016x}") for i, t, *_ in ROWS)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[7] == 1 and comp[2] == comp[3] == comp[10] == 2
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert sorted(str(r.doc_id) for r in simhash_dedup.keep_first(docs).collect()) == sorted(["1", "2", "4", "5", "8", "9", "None"])  # 6 is a near copy of 5


def test_pipeline_on_edges(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, none):
        now = rows
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            assert n == 4 or now.columns == corpus_pipeline.COLUMNS
            now = spark.createDataFrame(now.collect(), now.schema)
        assert (now.count() > 0) == (rows is docs)
