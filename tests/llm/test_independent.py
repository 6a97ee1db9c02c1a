"""Stored media and the classifier chain against readers and fits written apart from them."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np

from quillspark.llm import media, toxicity

DATA = "/root/testdata/sf0.1"


def read_container(data):
    """What a player would do: find moov/trak/mdia/minf/stbl, and gather samples by chunk offsets, samples a chunk and sample sizes."""

    def inside(lo, hi):
        out = {}
        while lo < hi:
            size, kind = struct.unpack(">I4s", data[lo : lo + 8])
            out[kind.decode()] = (lo + 8, lo + size)
            lo += size
        return out

    at = inside(0, len(data))
    for name in ("moov", "trak", "mdia"):
        at = inside(*at[name])
    rate, duration = struct.unpack(">II", data[at["mdhd"][0] + 12 : at["mdhd"][0] + 20])
    stbl = inside(*inside(*at["minf"])["stbl"])
    entry = data[stbl["stsd"][0] + 12 : stbl["stsd"][0] + 16].decode()
    size, count = struct.unpack(">II", data[stbl["stsz"][0] + 4 : stbl["stsz"][0] + 12])
    n = struct.unpack(">I", data[stbl["stco"][0] + 4 : stbl["stco"][0] + 8])[0]
    offsets = struct.unpack(f">{n}I", data[stbl["stco"][0] + 8 : stbl["stco"][0] + 8 + 4 * n])
    m = struct.unpack(">I", data[stbl["stsc"][0] + 4 : stbl["stsc"][0] + 8])[0]
    runs = [struct.unpack(">III", data[stbl["stsc"][0] + 8 + 12 * i : stbl["stsc"][0] + 20 + 12 * i]) for i in range(m)]
    payload, left = b"", count
    for chunk, offset in enumerate(offsets, 1):
        here = min(left, [r[1] for r in runs if r[0] <= chunk][-1])
        payload += data[offset : offset + here * size]
        left -= here
    assert left == 0
    return payload, entry, rate, duration


def test_stored_media_are_what_a_plain_reader_finds(spark):
    rows = [(1, "hello"), (2, None), (3, "x" * 64), (4, "é中" * 5000), (5, "hello")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = {r.doc_id: bytes(r.content) for r in media.store_bytes(docs, "text", "doc_id").collect()}
    for r in media.media_digests(docs).collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        data = stored[r.doc_id]
        payload, entry, rate, duration = read_container(data)
        assert payload == want and duration == len(want)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes, r.tail_crc32) == (len(raw), len(want), len(data), zlib.crc32(want[-64:]))
        assert r.media_sha256 == hashlib.sha256(data).hexdigest() and r.payload_sha256 == hashlib.sha256(want).hexdigest()
        f = dict(x.split("=") for x in r.feature.split(";"))
        ranges = [tuple(map(int, x.split(":"))) for x in f["keyframes"].split("+")]
        assert f["codec"].startswith(entry.strip()) and int(f["rate"]) == rate and int(f["duration_ms"]) == duration * 1000 // rate and int(f["mean_milli"]) == sum(want) * 1000 // len(want)
        assert b"".join(data[a : a + n] for a, n in ranges) == want


def plain_logistic(x, y):
    """Ridge logistic regression by gradient descent with a growing step, weights and a free bias."""
    w, rate = np.zeros(x.shape[1] + 1), 0.01
    a = np.hstack([x, np.ones((len(x), 1))])
    pull = np.append(np.full(x.shape[1], toxicity.RIDGE), 1e-6)
    loss = lambda w: float(np.logaddexp(0, a @ w).sum() - y @ (a @ w) + 0.5 * (pull * w * w).sum())
    now = loss(w)
    for _ in range(60_000):
        g = a.T @ (1 / (1 + np.exp(-(a @ w))) - y) + pull * w
        then = loss(w - rate * g)
        if then <= now:
            w, now, rate = w - rate * g, then, rate * 1.1
            if np.abs(g).max() < 1e-6:
                break
        else:
            rate /= 2
    return w


def test_a_link_of_the_chain_is_the_fit_of_a_plain_descent():
    rng = np.random.default_rng(2)
    x = (rng.random((120, 9)) < 0.4).astype(np.uint8)
    y = (x[:, 0] + x[:, 3] + rng.random(120) > 1.3).astype(float)
    before = rng.random((120, 1))
    got = toxicity.fit_linear(x, before, y)
    chi = []
    for j in range(9):
        table = Counter(zip(x[:, j].tolist(), y.astype(int).tolist()))
        total = 0.0
        for i in (0, 1):
            for k in (0, 1):
                expected = (table[i, 0] + table[i, 1]) * (table[0, k] + table[1, k]) / 120
                total += (table[i, k] - expected) ** 2 / expected
        chi.append(total)
    assert got.columns.tolist() == [j for j in range(9) if chi[j] >= toxicity.LEAST_CHI2]
    want = plain_logistic(np.hstack([x[:, got.columns], before]), y)
    assert np.allclose(np.append(got.weights, got.bias), want, atol=1e-3)


def test_terms_are_the_distinct_lower_case_words():
    text = "The the THE end, don't 12 é-É x_y"
    assert toxicity.terms(text) == {w for w in re.findall(r"[^\W\d_]+", text.lower())} and toxicity.terms(None) == set()


def test_the_chain_tells_toxic_documents_that_it_has_not_seen(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = [r for r in labels.collect() if r.doc_id in text]
    group = lambda r: zlib.crc32((text[r.doc_id] or "")[:200].encode()) % 3  # noqa: E731  # copies stay on one side
    train = spark.createDataFrame([r for r in rows if group(r)], labels.schema)
    held = [r for r in rows if not group(r)]
    chain = toxicity.fit_chain(docs, train)
    said = {r.doc_id: r.is_toxic for r in toxicity.judge(docs, chain).select("doc_id", "is_toxic").collect()}
    tally = defaultdict(int)
    for r in held:
        tally[bool(r.toxic), said[r.doc_id]] += 1
    right, missed, wrong = tally[True, True], tally[True, False], tally[False, True]
    assert sum(tally.values()) > 90 and right / (right + missed) >= 0.8 and wrong / max(1, right + wrong) <= 0.2, dict(tally)
    assert math.isfinite(chain.threshold)


def test_only_kept_tables_stay(spark):
    import os

    from quillspark.llm.common import materialize, only_kept

    with only_kept() as keep:
        a = materialize(spark.range(3), "t-a")
        with only_kept() as inner:
            b, c = materialize(spark.range(4), "t-b"), materialize(spark.range(5), "t-c")
            inner(b)
        assert not os.path.exists(c._quillspark_path.removeprefix("file:")) and b.count() == 4
        keep(a)
    assert a.count() == 3 and not os.path.exists(b._quillspark_path.removeprefix("file:"))
