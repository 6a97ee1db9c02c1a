"""Language model, spelling variants and phrases against plain versions, and on nulls, long texts, ties and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import language_model as lm
from quillspark.llm import phrases, spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
CLASH = "word string, n long, key string, phrase string, k int, f long, row long"
SCHEMA = f"doc_id long, text string, lang string, {CLASH}"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?", 1, "?", "?", 1, 1, 1) for r in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    syllables = ["the", "ing", "er", "st", "ou", "ren", "wh", "ÿa", "À", "and"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(120)]
    vocabulary += [w[:i] + c + w[i + j :] for w in rng.sample([w for w in vocabulary if len(w) > 6], 30) for i, c, j in ((2, "x", 1), (3, "", 1), (4, "y", 0))]
    texts = []
    for i in range(260):
        body = rng.choices(vocabulary, weights=[1 / (k % 40 + 1) for k in range(len(vocabulary))], k=rng.randint(0, 160))
        texts.append((i, " ".join(w.upper() if rng.random() < 0.1 else w + rng.choice(["", "", "", ",", ".\n", "\t"]) for w in body), rng.choice(["en", "en", "de", None])))
    long = "".join(rng.choices("abcdefgh", k=3000))
    texts += [(1000, None, "en"), (1001, "", None), (1002, " \t\n ", "de"), (None, "no key here at all", "en"), (None, "no key here at all", "en"), (7, texts[7][1], texts[7][2])]
    return texts + [(2000 + i, f"{long} {long[:1500]}{long[1501:]} mojibake ퟿ ✓ 漢字漢字漢字漢字", "en") for i in range(6)] + [(3000, f"{long}\n" * 30, "de")]


def brute_variants(rows):
    count = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        at = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
        return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else len(a) == len(b) + 1 and a[at + 1 :] == b[at:])

    around = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) if vs else None for w, vs in around.items()}
    form = {w: f if f is not None and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n}


def test_variants(spark, rows):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame(spark, rows)).collect()]
    want = brute_variants(rows)
    assert set(got) == want and len(got) == len(want) and any(f for _, f, *_ in want) and any(len(w) == 3000 for w, *_ in want)
    assert spelling.variants(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(frame(spark, rows), ratio=1)


def test_variants_follow_forms_to_the_last(spark):
    chain = [("abcdef", 5), ("abcdeg", 25), ("abcdhg", 125), ("abcihg", 625), ("abjihg", 3125), ("akjihg", 3125), ("tiesab", 5), ("tiesac", 25), ("tiesad", 25)]
    docs = [(i, " ".join([w] * n), "en") for i, (w, n) in enumerate(chain)]
    got = {r.word: (r.form, r.root) for r in spelling.variants(frame(spark, docs), dropped=1 << 40).collect()}
    assert got["abcdef"] == ("abcdeg", "abjihg") and got["abjihg"] == (None, "abjihg") and got["tiesab"] == ("tiesac", "tiesac")


def brute_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: min(((2_000_000 * a // (c[p[:k]] + c[p[k:]])), k) for k in range(1, len(p))) for p, a in c.items() if len(p) > 1 and a >= least}
        held = {q for p in found for k in range(2, len(p)) for q in (p[i : i + k] for i in range(len(p) - k + 1)) if 100 * c[p] >= 80 * c[q]}
        best = sorted((p for p in found if p not in held), key=lambda p: (-found[p][0], -c[p], " ".join(p).encode()))
        out += [(lang, i + 1, " ".join(p), c[p], c[p[: found[p][1]]], c[p[found[p][1] :]], n[lang], found[p][0]) for i, p in enumerate(best[:top])]
    return out


@pytest.mark.parametrize("least,top,bits", [(3, 2000, phrases.FILTER_BITS), (30, 2000, phrases.FILTER_BITS), (2, 7, 64)])
def test_phrases(spark, rows, monkeypatch, least, top, bits):
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    rows = [r if r[1] is None else (r[0], r[1] * (1 + (r[0] or 0) % 3), r[2]) for r in rows] + [(i, "same words here again; same words here again", "en") for i in range(40)]
    got = [tuple(r) for r in phrases.collocations(frame(spark, rows), least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    want = brute_phrases(rows, least, top)
    assert sorted(got) == sorted(want) and want
    assert phrases.collocations(frame(spark, [])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    grams = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, k int, f long")
    assert [r.score for r in phrases.scored(grams).collect()] == [2_000_000 * (big - 1) // (2 * big)]


def plain_probability(model, ids):
    """Each id's natural log probability, one at a time and in double precision, from the window that scores it."""
    w = {k: v.astype(float) for k, v in model.weights.items()}
    seq, out = [lm.START, *ids[:-1]], []
    for t, want in enumerate(ids):
        first = t // lm.SCORED * lm.SCORED - (lm.WINDOW - lm.SCORED)
        seen = range(max(0, first), t + 1)
        e = {i: w["embed"][model.inputs(np.array([seq[i]]))[0]] for i in seen}
        s = np.array([e[t] @ w["query"] @ (e[i] @ w["key"]) + w["near"][t - i] for i in seen])
        a = np.exp(s - s.max())
        h = e[t] + sum(x * (e[i] @ w["value"]) for x, i in zip(a / a.sum(), seen))
        rank = model.rank_of[want]
        c = max(i for i, b in enumerate(model.bounds) if b <= rank)
        z = h @ w["class"] + w["class_bias"]
        p = z[c] - np.log(np.exp(z).sum())
        if c == model.classes - 1:
            p += model.rest[want]
        else:
            z = h @ w["id"][:, model.bounds[c] : model.bounds[c + 1]] + w["id_bias"][model.bounds[c] : model.bounds[c + 1]]
            p += z[rank - model.bounds[c]] - np.log(np.exp(z).sum())
        out.append(p)
    return np.array(out)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    known, bounds = 40, np.array([0, 1, 4, 15, 40])
    rest = np.full(lm.END + 1, -np.log(lm.END + 1 - known), np.float32)
    m = lm.Model("", np.arange(100, 140), bounds, rest)
    shapes = {"embed": (known + 3, lm.STATE), "class": (lm.STATE, 5), "id": (lm.STATE, known), "class_bias": (5,), "id_bias": (known,), "near": (lm.WINDOW,)} | {k: (lm.STATE, lm.STATE) for k in ("query", "key", "value")}
    m.weights = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()}
    return m


def test_windows_score_each_id_once_by_masked_attention(model):
    rng = np.random.default_rng(4)
    sizes = np.array([1, 23, 24, 25, 90, 2])
    ids = rng.integers(90, 150, sizes.sum())
    got = lm.log10_probability(model, ids, sizes) * math.log(10)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert np.allclose(got, [plain_probability(model, p.tolist()).sum() for p in parts], rtol=1e-4)
    inputs, targets, source = lm.windowed(ids, sizes)
    assert [t for t in targets.ravel() if t != lm.PAD] == ids.tolist() and (np.bincount(source) == -(-sizes // lm.SCORED)).all()


def test_probabilities_of_the_next_id_sum_to_one(model):
    h = np.random.default_rng(5).normal(0, 1, (1, lm.STATE)).astype(np.float32)
    assert abs(np.exp(model.losses(np.repeat(h, lm.END + 1, 0), np.arange(lm.END + 1)).astype(float)).sum() - 1) < 1e-3


def test_gradients_are_those_of_finite_differences(model):
    rng = np.random.default_rng(6)
    ids = rng.integers(90, 150, 150)
    windows, target, _ = lm.windowed(ids, np.array([60, 90]))
    rows, target = model.inputs(windows), target.ravel()
    on = target != lm.PAD
    g = model.gradients(rows, target, on)
    kept = model.weights
    model.weights = {k: v.astype(np.float64) for k, v in kept.items()}
    for name, value in model.weights.items():
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(12)]:
            was, loss = value[at], []
            for step in (1e-4, -1e-4):
                value[at] = was + step
                loss.append(-model.losses(model.forward(rows)["h"][on], target[on]).mean())
            value[at] = was
            assert abs((loss[0] - loss[1]) / 2e-4 - g[name][at]) < 2e-4 + 0.02 * abs(g[name][at]), name
    model.weights = kept


def test_language_model_scores(spark, rows):
    """Counts and base scores against plain ones; common words from the tasks' table and rare ones by the join give the same."""
    train = [words_of(t) + [""] for i, t, *_ in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    c = Counter(w for f in train for w in f)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        tokens = words_of(t) + [""]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)
        want[(i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(tokens), sum(c[w] > 0 for w in tokens), n, round(base, 6))] += 1
    for common in (lm.COMMON, 10):
        got = lm.scores(frame(spark, rows), common=common).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.scores(frame(spark, [])).count() == 0
    alone = lm.scores(frame(spark, [(2, "held out alone", "en")] * 3)).collect()  # key 2 is in the held-out fold or not: all or nothing
    assert len(alone) == 3 and len({r.score for r in alone}) == 1


def test_language_model_learns_what_unigrams_cannot(spark):
    """New words of known syllables, in an order that the first word of a text decides: held-out texts are likelier than by counts of words."""
    rng = random.Random(8)
    kinds = [["ka", "lo", "mi", "nu", "pe", "ra"], ["st", "gr", "un", "ich", "ach", "tz"]]
    docs = [(i, " ".join("".join(rng.choices(kinds[i % 2], k=rng.randint(3, 5))) for _ in range(120)), "en") for i in range(1500)]
    held = [r for r in lm.scores(frame(spark, docs)).collect() if r.held_out]
    assert len(held) > 100 and sum(r.score for r in held) > 0.98 * sum(r.base_score for r in held) and np.mean([r.score > r.base_score for r in held]) > 0.95


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), max_size=8))
def test_pieces_spell_their_words(texts):
    code = lm.Pieces(lm.vocabulary_path())
    words = [w.encode() for t in texts for w in words_of(t)]
    ids, size, _ = code.ids([*words, b""])
    assert ids[-1] == lm.END and b"".join(code.core.decode_single_token_bytes(i) for i in ids[:-1].tolist()) == b"".join(b" " + w for w in words) and size.sum() == len(ids)
    alone = [i for w in words for i in code.core.encode_ordinary(" " + w.decode())]
    assert ids[:-1].tolist() == alone
