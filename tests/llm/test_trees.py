"""SimHash with BK-trees over band shards in the near-duplicate stage."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import shingle_dedup, simhash_dedup


def signed(word):
    return word - (1 << 64) if word >> 63 else word


def flipped(rng, word, bits):
    return word ^ sum(1 << i for i in rng.sample(range(64), bits))


def classes(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for x in nodes:
        out[find(x)].add(x)
    return {frozenset(c) for c in out.values()}


@pytest.mark.parametrize("radius,agree", [(2, 1), (3, 1), (4, 2), (5, 2)])
def test_words_within_the_radius_share_a_band(spark, radius, agree):
    rng = random.Random(radius)
    words = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    rows = [(i, signed(w)) for i, w in enumerate(words)] + [(i, signed(flipped(rng, w, radius))) for i, w in enumerate(words)]
    d = spark.createDataFrame(rows, "i long, fp long")
    bands = simhash_dedup.banded(d.select("fp").distinct(), radius, agree).join(d, "fp")
    assert bands.groupBy("i", "band", "shard").count().filter("count > 1").select("i").distinct().count() == len(words)


def test_trees_connect_what_the_radius_connects(spark):
    rng = random.Random(4)
    words = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        words.append(flipped(rng, rng.choice(words), rng.randrange(7)))
    rows = [(i, 100, signed(w)) for i, w in enumerate(words)]
    want = [(i, j) for i in range(len(words)) for j in range(i) if (words[i] ^ words[j]).bit_count() <= shingle_dedup.TREE_RADIUS]
    got = [tuple(r) for r in shingle_dedup.tree_pairs(spark.createDataFrame(rows, "x long, n int, fp long")).collect()]
    assert all(a < b for a, b in got) and classes(range(len(words)), got) == classes(range(len(words)), want)


def test_the_stage_searches_trees(spark, monkeypatch):
    rng = random.Random(1)
    text = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(i, " ".join(w if p != 37 * i else "other" for p, w in enumerate(text)), "en", "s", 1) for i in range(6)]
    rows += [(i, " ".join(f"x{rng.randrange(5000)}" for _ in range(90)), "en", "s", 1) for i in range(6, 12)]
    found, real = [], shingle_dedup.tree_pairs

    def seen(*args, **named):
        out = real(*args, **named)
        found.extend(out.collect())
        return out

    monkeypatch.setattr(shingle_dedup, "tree_pairs", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, *range(6, 12)]
    assert found


@pytest.mark.parametrize("largest", [2, 512])
def test_small_trees_lose_no_link(spark, monkeypatch, largest):
    rng = random.Random(2)
    text = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else "o" for w in text)) for i in range(60)]
    monkeypatch.setattr(shingle_dedup, "tree_pairs", lambda about, real=shingle_dedup.tree_pairs: real(about, largest=largest))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in rows]
    want = classes(range(60), [(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    got = defaultdict(set)
    for r in shingle_dedup.components(spark.createDataFrame(rows, "doc_id long, text string")).select(F.col("id"), "component_id").collect():
        got[r.component_id].add(r.id)
    assert {frozenset(c) for c in got.values()} == want and len(want) < 60
