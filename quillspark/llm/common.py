"""Helpers shared by the operators here: shared-folder tables, connected components, SQL-side text constants."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_open: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it.

    A local session without one gets a folder beside its warehouse. On a cluster executors could not read that, so there
    it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and gives the reader a known size.

    The table survives lost executors. Being a plain file scan, it also lets adaptive execution split a skewed
    join against it, which it can't do behind an aggregate that already has the join's partitioning.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def only_kept() -> Iterator[Callable[..., None]]:
    """A block at whose end all tables that it made are deleted, but for those given to the function that it yields.

    For operators that have written all that their result reads: what the result doesn't read would stay for good.
    """
    _open.append([])
    kept: list[DataFrame] = []
    try:
        yield lambda *tables: kept.extend(tables)
    except BaseException:
        _open.pop()
        raise
    made = _open.pop()
    discard(*(t for t in made if not any(t is k for k in kept)))
    if _open:
        _open[-1] += kept


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by materialize() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_quillspark_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def by_bytes(rows: list, sizes: list[int], most: int = 32 << 20) -> Iterator[list]:
    """rows in order, in lists of at most so many bytes; a larger row is alone. Keeps Arrow batches far from 2 GiB."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield rows[start:i]
            start, held = i, 0
        held += size
    if start < len(rows):
        yield rows[start:]


def null_safe(df: DataFrame, *columns: str) -> DataFrame:
    """Only the given columns, so that extra columns with clashing names can't interfere."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def private(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of docs has."""
    used, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def first_of_each(docs: DataFrame, keys: DataFrame, text: str, key: str) -> DataFrame:
    """Rows of docs whose key is in keys (one column), one row a key should it repeat, and all rows with a null key."""
    wanted, copy = private(docs, "wanted", "copy")
    keys = keys.toDF(wanted).distinct()
    kept = docs.join(keys.hint("merge"), docs[f"`{key}`"] == keys[wanted], "left_semi")
    order = Window.partitionBy(F.col(f"`{key}`")).orderBy(F.xxhash64(F.col(f"`{text}`")), F.col(f"`{text}`"))
    kept = kept.withColumn(copy, F.row_number().over(order)).filter(F.col(copy) == 1).drop(copy)
    return kept.unionAll(docs.filter(F.col(f"`{key}`").isNull()))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node that has an edge: (node, component).

    edges: (a, b) longs, any order, repeats and loops allowed. Alternating large-star and small-star steps
    (Kiveris et al., Connected Components in MapReduce and Beyond, 2014) until the edge set is all stars, which takes a number of
    rounds that grows with the logarithm of the nodes. Each step
    is one partial aggregate and one join whose small side is a written table, so a hub's edges are split.
    """

    def undirected(e: DataFrame) -> DataFrame:
        return e.select(F.col("a"), F.col("b")).unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = undirected(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "cc-min")
        joined = both.join(least, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        out = materialize(out.filter("a <> b").distinct(), "cc-edges")
        discard(least)
        return out

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = materialize(edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "cc-edges")
    before = None
    while True:
        wide = star(now, True)
        small = star(wide, False)
        discard(now, wide)
        now, after = small, mark(small)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def unsigned(column: Column) -> Column:
    """A long's bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
