"""Embedding near-duplicates: vectors sorted by concatenated random hashes, bounded neighbour windows, several passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import connected_components, discard, materialize, null_safe, only_kept, parts

COSINE, WINDOW, LEAST_PASSES, BITS, SEED, MISSED, DENSE = 0.93, 1024, 6, 30, 17, 0.02, 128


def passes_for(rows: int, window: int = WINDOW, cosine: float = COSINE, missed: float = MISSED) -> int:
    """Passes after which a pair right at the threshold is missed with probability `missed` at most.

    A window holds the vectors that agree on about log2(rows / window) hashes; one random hyperplane tells such a pair
    apart with probability angle / pi.
    """
    same = (1 - math.acos(cosine) / math.pi) ** max(0.0, math.log2(max(rows, 1) / window))
    return max(LEAST_PASSES, math.ceil(math.log(missed) / math.log(1 - same))) if same < 1 else LEAST_PASSES


def codes(vectors: np.ndarray, turn: int) -> np.ndarray:
    """BITS random hyperplane signs of each row, concatenated, the first hash highest."""
    planes = np.random.default_rng((SEED, turn, vectors.shape[1])).standard_normal((vectors.shape[1], BITS))
    return ((vectors @ planes) >= 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def near_duplicates(
    vectors: DataFrame, embedding: str = "embedding", label: str = "label", key: str = "vec_id", cosine: float = COSINE, window: int = WINDOW,
    passes: int | None = None,
) -> DataFrame:
    """key, n_links, component_id and kept of every row.

    Vectors link if their labels are equal and not null, their lengths are equal, and their cosine in double precision is
    at least `cosine`. Vectors that are null, empty or zero, or hold nulls or non-finite numbers, link with nothing; so do
    rows with a null label. Equal vectors of a label are one class: they link, are never paired, and count by number.

    Each pass sorts all classes by label and by the concatenated signs of random projections, ties in an order of its own,
    and compares each with all of its own and of the neighbouring block of `window` in that order. Where one comparison in
    DENSE or more with the farthest block was a link, a run of near vectors is longer than the window, and that block goes
    on to twice as many blocks in the next round, until its links get fewer or the order ends. So a dense run is compared
    whole, in pairs of blocks spread over tasks, and what is compared stays in proportion to the links found. Rows carry
    their block in every pass: a pair counts in the pass that has it nearest, without pairs ever being written. Blocks
    return sums of links, and of their links one spanning forest. The sort moves only (pass, label, code, key); it is one
    range shuffle, so a label with a third of all rows is spread out. Passes grow with the logarithm of the rows (see
    passes_for). Pairs that are in sparse surroundings and far apart in every pass are missed; none below the threshold is
    ever linked. Repeated keys, with one vector or several, and null keys are allowed; each row counts as a vector. Other columns are not read; an empty table gives no rows.
    """
    with only_kept() as keep:
        named, known, least = linked(vectors, embedding, label, key, cosine, window, passes)
        keep(named, known, least)
    known = known.join(least, "component").select("class", "links", F.col("least").alias("component"))
    out = named.select("id", "class").join(known, "class", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def linked(vectors: DataFrame, embedding: str, label: str, key: str, cosine: float, window: int, passes: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, class) of every row, (class, links, component) of every class, and (component, least key)."""
    v = null_safe(vectors, key, embedding, label).toDF("id", "vec", "label")
    v = v.withColumn("vec", F.col("vec").cast("array<double>"))
    fine = F.forall("vec", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists("vec", lambda c: c != 0) & F.col("label").isNotNull()
    v = v.withColumn("ok", F.coalesce(fine, F.lit(False)))
    named = v.select("id", "ok", F.when(F.col("ok"), F.struct("label", F.size("vec").alias("dim"), F.xxhash64("vec").alias("x"), F.xxhash64(F.lit(7), "vec").alias("y"))).alias("class"), "vec")
    named = materialize(named, "ed-vectors")
    classes = named.filter("ok").groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = materialize(classes.select(F.col("class.label").alias("label"), F.col("class.dim").alias("dim"), "class", "rep", "n", "vec", F.monotonically_increasing_id().alias("row")), "ed-classes")
    turns = passes or passes_for(classes.count(), window, cosine)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = part.column(3).flatten().to_numpy().reshape(-1, dim)
                for turn in range(turns):
                    turned = [pa.array(np.full(len(x), turn, np.int32)), part.column(0), part.column(1), part.column(2), pa.array(codes(x, turn))]
                    yield pa.RecordBatch.from_arrays(turned, names=["turn", "row", "label", "dim", "code"])

    kind = vectors.schema[label].dataType.simpleString()
    coded = classes.select("row", "label", "dim", "vec").mapInArrow(code, f"turn int, row long, label {kind}, dim int, code long")
    order = ["turn", "label", "dim", "code", F.xxhash64("turn", "row"), "row"]
    ranked = coded.repartitionByRange(parts(vectors.sparkSession), *order).sortWithinPartitions(*order)
    ranked = ranked.withColumn("at", F.monotonically_increasing_id())
    ranked = materialize(ranked.select("turn", "row", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("inside")), "ed-order")
    sizes = ranked.groupBy("part").agg((F.max(F.floor(F.col("inside") / window)) + 1).alias("blocks"))
    before = F.coalesce(F.sum("blocks").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialize(sizes.select("part", before.alias("before")), "ed-parts")  # one row a partition
    placed = ranked.join(sizes, "part").select("row", "turn", (F.col("before") + F.floor(F.col("inside") / window)).alias("block"))
    blocks = placed.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda s: s["block"]).alias("blocks"))
    rows = materialize(classes.join(blocks, "row").select(F.col("row").alias("rep"), "n", "vec", F.xxhash64("label", "dim").alias("grp"), "blocks"), "ed-rows")
    sent = rows.select("*", F.posexplode("blocks").alias("turn", "block"))

    def compare(table: pa.Table, inside: bool) -> pa.Table:
        table = table.combine_chunks()
        turn, block = table["turn"][0].as_py(), table["at"][0].as_py()
        mine = table["own"].to_numpy(zero_copy_only=False)
        at = np.concatenate([np.flatnonzero(mine), np.flatnonzero(~mine)])
        rep, n, grp = (table[c].to_numpy()[at] for c in ("rep", "n", "grp"))
        met = np.stack(table["blocks"].to_numpy(zero_copy_only=False))[at]
        own, compared, hits = int(mine.sum()), 0, 0
        counts, lab = np.zeros(len(at), np.int64), np.arange(len(at))
        vecs = table["vec"].to_numpy(zero_copy_only=False)[at]
        for g in np.unique(grp[:own]):
            i, j = np.flatnonzero(grp[:own] == g), np.flatnonzero(grp == g)
            x = np.stack(vecs[j])
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = x[: len(i)] @ x.T >= cosine  # own rows come first in j
            compared, hits = compared + len(i) * (len(j) - len(i)), hits + int(near[:, len(i) :].sum())
            if not inside:
                near[:, : len(i)] = False
            near[np.arange(len(i)), np.arange(len(i))] = False
            p, q = np.nonzero(near)
            best, nearest = np.full(len(p), -1), np.full(len(p), np.iinfo(np.int64).max)
            for t in range(met.shape[1]):
                apart = np.abs(met[i[p], t] - met[j[q], t])
                best[apart < nearest] = t
                nearest = np.minimum(nearest, apart)
            p, q = p[best == turn], q[best == turn]
            counts[i] += np.bincount(p, n[j[q]], len(i)).astype(np.int64)
            ahead = q >= len(i)
            counts[j] += np.bincount(q[ahead], n[i[p[ahead]]], len(j)).astype(np.int64)
            while True:  # smallest linked row, until nothing changes
                low = np.where(near, lab[j][None, :], len(at)).min(axis=1, initial=len(at))
                new = np.minimum(lab[i], low)
                back = np.where(near, new[:, None], len(at)).min(axis=0, initial=len(at))
                renewed = np.minimum(lab[j], back)
                renewed[: len(i)] = np.minimum(renewed[: len(i)], new)
                if (renewed == lab[j]).all():
                    break
                lab[j] = renewed
        some = np.flatnonzero((counts > 0) | (lab != np.arange(len(at))))
        none = np.full(len(some), None)
        said = {"a": np.append(rep[some].astype(object), None), "b": np.append(rep[lab[some]].astype(object), None), "links": np.append(counts[some].astype(object), None)}
        said |= {k: np.append(none, v) for k, v in (("turn", turn), ("at", block), ("compared", compared), ("hits", hits))}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in said.items()})

    kinds = {k: pa.int32() if k == "turn" else pa.int64() for k in ("a", "b", "links", "turn", "at", "compared", "hits")}
    result = "a long, b long, links long, turn int, at long, compared long, hits long"
    both = sent.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("own"))
    both = both.withColumn("at", F.when(F.col("own"), F.col("block")).otherwise(F.col("block") - 1)).filter("at >= 0")
    found = made = materialize(both.groupBy("turn", "at").applyInArrow(lambda t: compare(t, True), result), "ed-found")
    reach = 1
    while True:  # longer windows, from each block whose farthest comparisons had many links
        dense = made.filter("a IS NULL").groupBy("turn", "at").agg(F.sum("compared").alias("compared"), F.sum("hits").alias("hits")).filter(F.col("hits") * DENSE >= F.greatest("compared", F.lit(1)))
        dense = materialize(dense.select("turn", "at", F.explode(F.sequence(F.lit(reach + 1), F.lit(2 * reach))).alias("shift")), "ed-dense")
        if dense.isEmpty():
            break
        mine = sent.join(dense, (sent["turn"] == dense["turn"]) & (sent["block"] == dense["at"])).select(*rows.columns, sent["turn"], "at", "shift", F.lit(True).alias("own"))
        ahead = sent.join(dense, (sent["turn"] == dense["turn"]) & (sent["block"] == dense["at"] + dense["shift"])).select(*rows.columns, sent["turn"], "at", "shift", F.lit(False).alias("own"))
        made = materialize(mine.unionAll(ahead).groupBy("turn", "at", "shift").applyInArrow(lambda t: compare(t, False), result), "ed-found")
        discard(dense)
        found, reach = found.unionAll(made), 2 * reach
    found = found.filter("a IS NOT NULL")
    links = found.groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("links"))
    comps = connected_components(found.select("a", "b")).select(F.col("node").alias("row"), "component")
    known = classes.select("class", "row", "rep", "n").join(links, "row", "left").join(comps, "row", "left")
    known = materialize(known.select("class", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "row").alias("component")), "ed-known")
    smallest = known.groupBy("component").agg(F.min("rep").alias("least"))  # classes go by their row, as a key may stand for several
    return named, known, materialize(smallest, "ed-least")
