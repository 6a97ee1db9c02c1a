"""The language model learns from whole training texts."""

import numpy as np
import pytest

from quillspark.llm import language_model as lm


def test_every_training_id_is_a_target_once(spark):
    docs = [(i, " ".join(f"word{(i * 7 + n) % 50}" for n in range(n))) for i, n in enumerate((0, 1, 63, 64, 65, 700, 40_000))] + [(9, None), (None, "No key")]
    d = spark.createDataFrame(docs, "key long, text string")
    path = lm.vocabulary_path()
    model = lm.started(lm.followers(lm.training_words(d), path), path)
    rows = np.stack([np.frombuffer(r.ids, "<u2") for r in lm.training_windows(d, model).select("ids").collect()])
    got = np.bincount(rows[:, lm.WINDOW :].ravel(), minlength=lm.NONE + 1)[: lm.NONE]
    kept = [(t or "").lower().encode().split() + [b""] for k, t in docs if lm.fold(k) % lm.FOLDS != lm.HELD_OUT]
    want = np.bincount(lm.Pieces(path).ids([w for t in kept for w in t])[0], minlength=lm.NONE)
    assert (got == want).all() and len(kept) > 6


def test_the_table_of_shards_holds_each_training_id_little_more_than_once(spark, monkeypatch):
    """Rows of overlapping windows with their targets took 4.7 bytes an id, which was more disk than the check allows."""
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * 7 + n) % 50}" for n in range(900))) for i in range(40)], "key long, text string")
    held, write = {}, lm.materialize

    def measured(df, name):
        out = write(df, name)
        if name == "lm-shards":
            held["bytes"] = out.selectExpr("sum(length(ids))").first()[0]
        return out

    monkeypatch.setattr(lm, "materialize", measured)
    path = lm.vocabulary_path()
    words = lm.training_words(docs)
    lm.fitted(docs, words, path)
    ids = lm.followers(words, path).selectExpr("sum(n)").first()[0]
    assert 2 <= held["bytes"] / ids < 2.4


def test_rows_equal_in_key_and_text_are_dealt_to_many_shards(spark):
    docs = spark.createDataFrame([(3, "one and the same text")] * 64, "key long, text string").coalesce(1)
    path = lm.vocabulary_path()
    model = lm.started(lm.followers(lm.training_words(docs), path), path)
    assert lm.training_pieces(docs, model).select("tie", "place").distinct().count() == 64


def test_texts_are_encoded_once_for_training_and_scores(spark, monkeypatch):
    """Training and scoring each split and encoded all texts."""
    docs, read, write = spark.createDataFrame([(i, f"word{i} and others") for i in range(20)], "doc_id long, text string"), [], lm.materialize

    def noted(df, name):
        if "text#" in df._jdf.queryExecution().optimizedPlan().toString():
            read.append(name)
        return write(df, name)

    monkeypatch.setattr(lm, "materialize", noted)
    assert lm.scores(docs).count() == 20 and read == ["lm-words", "lm-texts"]


@pytest.mark.parametrize("spread", [1, 300])
def test_small_softmaxes_at_once_are_each_by_itself(spread):
    """Also where rows are out of reach of the largest number."""
    rng = np.random.default_rng(9)
    h, read = rng.normal(0, 1, (12, 5)) * np.linspace(1, spread, 12)[:, None], rng.normal(0, 1, (9, 5))
    parts = [(0, 12, 0, 3), (0, 5, 3, 7), (8, 12, 7, 9)]
    right = np.concatenate([rng.integers(lo, hi, b - a) for a, b, lo, hi in parts])
    views, share = lm._less_the_right(h.astype(np.float32), read.astype(np.float32), parts, right)
    at = 0
    for (a, b, lo, hi), view in zip(parts, views):
        z = h[a:b] @ read[lo:hi].T
        want = np.exp(z - z.max(1, keepdims=True))
        want /= want.sum(1, keepdims=True)
        want[np.arange(b - a), right[at : at + b - a] - lo] -= 1
        assert np.allclose(view * share[at : at + b - a, None], want, atol=2e-4)
        at += b - a


def test_windows_of_many_pieces_are_those_of_each():
    model = lm.Model("", np.arange(100, 140), np.array([0, 40]), np.zeros(lm.END + 1, np.float32))
    rng, before = np.random.default_rng(2), lm.WINDOW - lm.SCORED
    pieces = []
    for n in (1, 3, lm.PIECE):
        line = rng.integers(90, 150, before + lm.SCORED * n + 1).astype("<u2")
        line[:before], line[before], line[-1] = lm.NONE, lm.FIRST, lm.END
        pieces.append(line.tobytes())
    got = lm.piece_windows(model, *pieces)
    assert (got == np.concatenate([lm.piece_windows(model, p) for p in pieces])).all() and len(got) == 4 + lm.PIECE
    assert (got[0, : lm.WINDOW] == [42] * before + [41] + [x - 100 if 100 <= x < 140 else 40 for x in np.frombuffer(pieces[0], "<u2")[before + 1 : lm.WINDOW]]).all() and got[0, -1] == lm.END
