"""Toxicity by a classifier chain: linear models in turn, each fed the out-of-fold probabilities of those before."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, null_safe

#: Category: SQL over a labels row. Later categories see the probabilities of earlier ones.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 AND quality = 0"}
MAX_TRAINING_ROWS, MAX_TERMS, MAX_SELECTED, LEAST_CHI2, LEAST_ROWS = 6000, 20_000, 512, 25.0, 3
FOLDS, PREFIXES, RIDGE, SEED = 3, (3, 4, 5, 6), 0.1, 5
WORDS = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> set[str]:
    """Distinct lower-case words of a text, and their first letters, which stand for stems; null has none."""
    words = set(WORDS.findall((text or "").lower()))
    return words.union(*({"^" + w[:n] for w in words if len(w) > n} for n in PREFIXES)) if words else words


@dataclass
class Linear:
    """Logistic model over chosen columns; the last inputs are the probabilities of earlier categories."""

    columns: np.ndarray
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray, before: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of all rows of x, or of some; before is that of these rows."""
        z = np.hstack([x[:, self.columns] if rows is None else x[np.ix_(rows, self.columns)], before]) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def column_sums(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of some rows, a few at a time: x is large, and a copy of most of it would be as large."""
    out = np.zeros(x.shape[1])
    for i in range(0, len(rows), 512):
        out += x[rows[i : i + 512]].sum(axis=0, dtype=np.float64)
    return out


def fit_linear(x: np.ndarray, before: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> Linear:
    """Ridge logistic regression by Newton steps on the terms that go with y in these rows of x, or all (chi-squared).

    before and y are those of the rows. With labels of one value, the model is its smoothed share.
    """
    rows = np.arange(len(x)) if rows is None else rows
    n, ones = len(y), y.sum()
    base = (ones + 0.5) / (n + 1)
    if ones in (0, n):
        return Linear(np.zeros(0, np.int64), np.zeros(before.shape[1]), float(np.log(base / (1 - base))))
    have, both = column_sums(x, rows), column_sums(x, rows[y > 0])
    spread = have * (n - have) * ones * (n - ones)
    chi2 = n * (n * both - have * ones) ** 2 / np.where(spread > 0, spread, np.inf)
    columns = np.argsort(-chi2, kind="stable")[:MAX_SELECTED]
    columns = np.sort(columns[chi2[columns] >= LEAST_CHI2])
    a = np.hstack([x[np.ix_(rows, columns)], before, np.ones((n, 1))]).astype(np.float64)
    penalty = np.full(a.shape[1], RIDGE)
    penalty[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(columns, w[:-1], float(w[-1]))


@dataclass
class Chain:
    """Fitted chain over a vocabulary of terms; `threshold` is the cut on the probability of category `decide`."""

    vocabulary: dict[str, int]
    categories: list[str]
    models: list[Linear]
    decide: str
    threshold: float

    def trimmed(self) -> Chain:
        """The same chain over the terms that some model uses."""
        used = np.unique(np.concatenate([m.columns for m in self.models]).astype(np.int64))
        names = {i: t for t, i in self.vocabulary.items()}
        models = [Linear(np.searchsorted(used, m.columns), m.weights, m.bias) for m in self.models]
        return Chain({names[i]: n for n, i in enumerate(used.tolist())}, self.categories, models, self.decide, self.threshold)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        before = np.zeros((len(x), 0))
        for model in self.models:
            before = np.hstack([before, model(x, before)[:, None]])
        return before


def matrix(texts: list[str | None], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    for i, text in enumerate(texts):
        x[i, [vocabulary[t] for t in terms(text) if t in vocabulary]] = 1
    return x


def train(x: np.ndarray, y: np.ndarray, folds: np.ndarray, categories: list[str], decide: str, vocabulary: dict[str, int]) -> Chain:
    """Fit the chain; a later category trains on out-of-fold probabilities, as they will be when predicted."""
    before, models, cut = np.zeros((len(x), 0)), [], 0.5
    for j, category in enumerate(categories):
        models.append(fit_linear(x, before, y[:, j]))
        held = np.zeros(len(x))
        for fold in np.unique(folds):
            out = folds == fold
            held[out] = fit_linear(x, before[~out], y[~out, j], np.flatnonzero(~out))(x, before[out], np.flatnonzero(out)) if (~out).any() else y[:, j].mean()
        if category == decide:
            cut = best_cut(held, y[:, j])
        before = np.hstack([before, held[:, None]])
    return Chain(vocabulary, categories, models, decide, cut)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, halfway to the next lower probability.

    It has to beat the F1 of calling every row toxic; where it doesn't, the labels tell nothing apart (no toxic row, no
    other row, contradictory labels, no term that goes with them), and the cut is 1.1, above all probabilities: none is toxic.
    """
    if not y.sum():
        return 1.1
    everything = 2 * y.sum() / (len(y) + y.sum())
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    lower = np.append(p[1:], 0.0)
    f1[lower == p] = -1
    best = int(np.argmax(f1))
    if f1[best] <= everything * (1 + 1e-9):
        return 1.1
    return float((p[best] + lower[best]) / 2)


def fit_chain(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", categories: dict[str, str] = CATEGORIES,
    decide: str = "toxic", max_rows: int = MAX_TRAINING_ROWS,
) -> Chain:
    """Fit the chain on at most max_rows labelled documents, drawn by a digest of their key.

    Labels with nulls are left out; of repeated keys one label row counts. Spark draws the rows, joins their texts, counts
    terms and encodes the rows over at most MAX_TERMS terms; the driver gets the vocabulary and the encoded rows, both
    bounded whatever the input. The cut is the one with the best F1 over out-of-fold probabilities of `decide`.
    """
    marked = labels.select(F.col(f"`{key}`").alias("id"), *(F.expr(sql).cast("double").alias(c) for c, sql in categories.items())).dropna()
    ticket = F.xxhash64("id", F.lit(SEED))
    drawn = marked.groupBy("id").agg(*(F.max(c).alias(c) for c in categories)).orderBy(ticket, "id").limit(max_rows)
    drawn = materialize(drawn.withColumn("fold", F.pmod(ticket, F.lit(FOLDS)).cast("int")), "tox-drawn")
    body = null_safe(docs, key, text).withColumnsRenamed({key: "id", text: "body"}).withColumn("tie", F.xxhash64("body"))
    sample = body.join(drawn, "id").groupBy("id").agg(F.min_by(F.struct("body", "fold", *categories), "tie").alias("row")).select("id", "row.*")
    sample = materialize(sample.repartition(8), "tox-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column(0):
                seen.update(terms(x.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    counted = sample.select("body").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "term").limit(MAX_TERMS).collect()
    vocabulary = {r["term"]: i for i, r in enumerate(top)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[vocabulary[t] for t in terms(x.as_py()) if t in vocabulary] for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), *batch.columns[1:]], names=["terms", *batch.schema.names[1:]])

    names = list(categories)
    schema = "terms array<int>, id long, fold int, " + ", ".join(f"`{c}` double" for c in names)
    rows = sample.select("body", F.col("id").cast("long").alias("id"), "fold", *names).mapInArrow(encode, schema).toArrow()
    discard(drawn, sample)
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    x = np.zeros((len(order), len(vocabulary)), np.uint8)
    place = np.argsort(order)
    for i, hit in enumerate(rows["terms"]):
        x[place[i], hit.values.to_numpy()] = 1
    y = np.stack([rows[c].to_numpy() for c in names], axis=1)
    return train(x, y[order], rows["fold"].to_numpy()[order], names, decide, vocabulary).trimmed()


def judge(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """docs with one probability column p_<category> a category, and is_toxic. One scan of whole texts, no shuffle.

    Null and empty texts have no terms. All rows stay, repeated ones too, and all columns, but for columns of docs that
    have the name of an added one: the added one takes their place.
    """
    names = [f"p_{c}" for c in chain.categories]
    at = chain.categories.index(chain.decide)
    taken = {*map(str.lower, names), "is_toxic"}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                p = chain.probabilities(matrix(part.column(text).to_pylist(), chain.vocabulary))
                columns = [*part.columns, *(pa.array(p[:, i]) for i in range(len(names))), pa.array(p[:, at] >= chain.threshold)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *names, "is_toxic"])

    added = "".join(f", `{n}` double" for n in names) + ", is_toxic boolean"
    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + added)
