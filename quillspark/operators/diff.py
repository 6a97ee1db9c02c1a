"""Versions of documents compared: added, continued, changed as a whole, or by hunks of units between patience anchors."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import evidence

COARSE = 100_000


def patience_anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of units that are unique on both sides, on a longest rising chain."""
    ca, cb = Counter(a), Counter(b)
    where = {u: j for j, u in enumerate(b) if cb[u] == 1}
    pairs = [(i, where[u]) for i, u in enumerate(a) if ca[u] == 1 and u in where]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        back[n] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [j], [n]
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def hunks(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Changed spans (before start, end, after start, end) between anchors, equal ends trimmed."""
    out, i, j = [], 0, 0
    for x, y in [*patience_anchors(a, b), (len(a), len(b))]:
        p, q, r, s = i, x, j, y
        while p < q and r < s and a[p] == b[r]:
            p, r = p + 1, r + 1
        while p < q and r < s and a[q - 1] == b[s - 1]:
            q, s = q - 1, s - 1
        if p < q or r < s:
            out.append((p, q, r, s))
        i, j = x + 1, y + 1
    return out


def compare(before: DataFrame, after: DataFrame, key: str, text: str, coarse: int = COARSE) -> DataFrame:
    """(key, change, before_start, before_end, after_start, after_end) of every version in `after`.

    Equal texts are continued; those with too many lines on a side are changed as a whole; the others give a row a hunk.
    Only changed documents within the limit reach Python, two line arrays a row.
    """
    b = before.select(key, F.col(text).alias("_b"))
    both = after.select(key, F.col(text).alias("_a")).join(b, key, "left")
    size = F.greatest(F.size(F.split("_a", "\n")), F.size(F.split("_b", "\n")))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a") == F.col("_b"), "continued").when(size > coarse, "modified").otherwise("hunk")
    both = both.withColumn("change", kind)
    plain = both.filter("change <> 'hunk'").select(key, "change", *(F.lit(None).cast("long").alias(c) for c in ("before_start", "before_end", "after_start", "after_end")))

    def run(frames):
        for f in frames:
            rows = [(k, "hunk", *h) for k, x, y in zip(f[key], f["_b"], f["_a"]) for h in hunks(x.split("\n"), y.split("\n"))]
            yield pd.DataFrame(rows, columns=[key, "change", "before_start", "before_end", "after_start", "after_end"])

    fine = both.filter("change = 'hunk'").select(key, "_b", "_a").mapInPandas(run, f"{key} long, change string, before_start long, before_end long, after_start long, after_end long")
    return plain.unionByName(fine)


def verify(versions: DataFrame, objects: DataFrame, key: str, digest: str, content: str) -> DataFrame:
    """(key, problem) of versions whose object is missing, or whose content does not have its digest."""
    missing = versions.join(objects.select(digest).distinct(), digest, "left_anti").select(key, F.lit("missing_object").alias("problem"))
    broken = objects.filter(F.sha2(content, 256) != F.col(digest)).select(digest).distinct()
    return missing.unionByName(versions.join(broken, digest, "left_semi").select(key, F.lit("digest_mismatch").alias("problem")))


def keyed_rows(rows: DataFrame, keys: DataFrame, document: str, order: list[str]) -> DataFrame:
    """rows with row_key (V02), under the first header of their label, which is carried down the rows.

    rows: document, order, label, is_header, cells and sha256 of each table row; keys: (label, keys), the columns configured for a label, one row
    each. Other labels take the first header that names an id. A row without a value in each of its key columns, or above any
    header, has its digest as the key. A document's rows of one label are one sort.
    """
    named = F.first(F.when(F.col("is_header"), F.col("cells")), ignorenulls=True)
    header = named.over(Window.partitionBy(document, "label").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    known = keys.select(F.col("label").alias("_label"), F.col("keys").alias("_keys"))
    j = rows.withColumn("_header", header).join(known, F.col("label") == F.col("_label"), "left")
    key = evidence.composite_row_key(F.col("label"), F.col("_header"), F.col("cells"), F.coalesce("_keys", evidence.inferred_keys(F.col("_header"))))
    return j.withColumn("row_key", F.coalesce(key, F.col("sha256"))).drop("_header", "_label", "_keys")


def same_text(text: str) -> str:
    """What fidelity compares: NFC letters without white space."""
    return unicodedata.normalize("NFC", "".join(text.split()))


@F.pandas_udf(T.DoubleType())
def fidelity(text: pd.Series, truth: pd.Series) -> pd.Series:
    """twice the letters of matching blocks over all letters, white space apart, as difflib counts them; null with a null."""

    def ratio(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        a, b = same_text(a), same_text(b)
        return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()

    return pd.Series([ratio(a, b) for a, b in zip(text, truth)], dtype="float64")
