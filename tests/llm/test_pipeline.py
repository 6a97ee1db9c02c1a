"""Each stage of the pipeline against a plain version on that stage's own input, and queries against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import embedding_dedup, packing, toxicity


def near(rows, least=0.8):
    """Of each group of similar texts the smallest key: all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + min(5, len(w))]) for i in range(max(0, len(w) - min(5, len(w)) + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    best = {}
    for i, (k, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), k), k)
    return sorted(best.values())


def without_runs(rows, least=50):
    """Texts without later copies of line runs of 50 words or more: every run of every length, by place."""
    first, gone = {}, defaultdict(set)
    for k, text in sorted(rows):
        lines = (text or "").split("\n")
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(lines[b].encode().split())
                if words >= least:
                    run = tuple(lines[a : b + 1])
                    if run in first:
                        gone[k] |= set(range(a, b + 1))
                    else:
                        first[run] = k
                    break
            words = 0
            for b in range(a, -1, -1):  # the shortest run that ends here
                words += len(lines[b].encode().split())
                if words >= least:
                    run = tuple(lines[b : a + 1])
                    if run in first and first[run] != k:
                        gone[k] |= set(range(b, a + 1))
                    first.setdefault(run, k)
                    break
    return {k: text if not gone[k] else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[k]) for k, text in rows}


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """Outputs of all stages over a folder of planted documents."""
    rng = random.Random(11)
    word = lambda: "w" + str(rng.randrange(3000))
    line = lambda n=14: " ".join(word() for _ in range(n))
    passage = [line(12) for _ in range(6)]
    rows, labels = [], []
    for i in range(90):
        lines = [line() for _ in range(rng.randrange(2, 9))]
        if i % 9 == 4:
            lines[1:1] = passage
        if i % 10 == 7:
            lines.insert(0, "you vilewretch and foulscum " + line(5))
        rows.append((i, "\n".join(lines)))
        labels.append((i, 1, int(i % 10 == 7)))
    for i in range(90, 110):  # near copies
        w = rows[i - 90][1].split(" ")
        w[len(w) // 2] = "edited"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int((i - 90) % 10 == 7)))
    rows += [(110, None), (111, ""), (112, rows[3][1]), (113, " ")]
    folder = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    seen, now = [docs.collect()], docs
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, now, str(folder))
        got = rows.collect()
        now = spark.createDataFrame(got, rows.schema)
        seen.append(got)
    return seen, str(folder)


def test_toxicity_stage(spark, ran):
    seen, folder = ran
    assert {r.doc_id for r in seen[0]} - {r.doc_id for r in seen[1]} == {r.doc_id for r in seen[0] if "vilewretch" in (r.text or "")}
    chain = toxicity.fit_chain(spark.createDataFrame(seen[0]), spark.read.parquet(f"{folder}/labels.parquet"))
    p = chain.probabilities(toxicity.matrix([r.text for r in seen[0]], chain.vocabulary))[:, chain.categories.index("toxic")]
    assert sorted(r.doc_id for r, x in zip(seen[0], p) if x < chain.threshold) == sorted(r.doc_id for r in seen[1])


def test_line_stage(ran):
    before, after = ran[0][1:3]
    want = without_runs([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == want and sum(want[r.doc_id] != r.text for r in before) > 5


def test_near_duplicate_stage(ran):
    before, after = ran[0][2:4]
    assert sorted(r.doc_id for r in after) == near([(r.doc_id, r.text) for r in before]) and len(after) < len(before) - 10


def test_mixture_stage(ran):
    before, after = ran[0][3:5]
    size, taken, text = Counter(), Counter(), {r.doc_id: (r.text or "").split() for r in before}
    for r in before:
        size[r.source] += len(text[r.doc_id])
    for r in after:
        taken[r.source] += len(r.text.split())
        assert text[r.doc_id][: len(r.text.split())] == r.text.split() and r.n_chars == len(r.text)
    weights, caps = dict(zip(sorted(size), (5, 2, 1))), {s: 2 * n for s, n in size.items()}
    want, free, total = {}, set(size), 1.5 * sum(size.values())
    while True:
        share = {s: (total - sum(want.values())) * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > caps[s]}
        if not over:
            break
        want |= {s: caps[s] for s in over}
        free -= over
    assert {s: taken[s] for s in size} == {s: round(x) for s, x in (want | share).items()}


def test_packing_stage(ran):
    before, after = ran[0][4:6]
    cache = packing.WordCache(packing.tokenizer_path())
    want = Counter((r.doc_id, len(cache.encode([r.text or ""])[0]) + 1) for r in before)
    got = Counter()
    for r in after:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == Counter({(d, n): n * c for (d, n), c in want.items()})
    used = defaultdict(int)
    for r in after:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))


def test_a_dense_label_is_compared_whole(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(24)
    vecs = [base + rng.standard_normal(24) * 0.2 for _ in range(1500)] + [rng.standard_normal(24) for _ in range(200)]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vecs)]
    x = np.array([np.float32(v) for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    want, comp = links.sum(axis=1), np.arange(len(x))
    while True:
        low = np.minimum(comp, np.where(links, comp[None, :], len(x)).min(axis=1))
        if (low == comp).all():
            break
        comp = low
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), window=64).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and want.sum() > 200_000
    assert [got[i].component_id for i in range(len(x))] == comp.tolist() and all(got[i].kept == (comp[i] == i) for i in range(len(x)))
