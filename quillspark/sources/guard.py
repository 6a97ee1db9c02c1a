"""Reads of files between two looks at them: a guard of size, time and content, sticky taint (M06) and one rescan of what was unstable."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import settled

READ = "path string, size_bytes long, modified_ns long, sha256 string, body binary, status string, reason string"
PIECE, BYTES = 1 << 20, 32 << 20
#: Reasons of an unstable source. Fixed values.
UNSTABLE = ("unstable", "source_changed", "source_guard_unavailable", "source_version_changed")


def guarded(files: DataFrame, root: str, path: str = "path", most: int = 64 << 20) -> DataFrame:
    """Each file's body with its guard: size and time before and after the read, and the digest of what was read.

    A file that changed meanwhile is an error with the reason source_changed, and gives no body; one that can't be read is
    source_guard_unavailable; one of more than `most` bytes is size_limit. Bodies leave a task in batches of bounded bytes.
    """

    def one(name: str) -> tuple:
        try:
            before = os.stat(os.path.join(root, name))
            if before.st_size > most:
                return name, before.st_size, before.st_mtime_ns, None, None, "error", "size_limit"
            digest, body = hashlib.sha256(), []
            with open(os.path.join(root, name), "rb") as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
                    body.append(piece)
            after = os.stat(os.path.join(root, name))
        except OSError:
            return name, None, None, None, None, "error", "source_guard_unavailable"
        body = b"".join(body)
        if (before.st_size, before.st_mtime_ns, before.st_ino) != (after.st_size, after.st_mtime_ns, after.st_ino) or len(body) != after.st_size:
            return name, after.st_size, after.st_mtime_ns, None, None, "error", "source_changed"
        return name, after.st_size, after.st_mtime_ns, digest.hexdigest(), body, "success", None

    names, kinds = [x.split()[0] for x in READ.split(", ")], (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows.append(one(name))
                held += len(rows[-1][4] or b"") + 200
                if held > BYTES:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return files.filter(F.col(path).isNotNull()).select(F.col(path).cast("string").alias("path")).mapInArrow(run, READ)


def is_unstable(reason: F.Column) -> F.Column:
    low = F.lower(F.coalesce(reason, F.lit("")))
    return low.contains(UNSTABLE[0]) | low.contains(UNSTABLE[1]) | low.isin(*UNSTABLE[2:])


def rescanned(scan: Callable[[DataFrame | None], DataFrame], key: str = "path") -> DataFrame:
    """The rows of a scan, those of unstable sources read once more.

    `scan(None)` reads everything, `scan(keys)` the keyed rows. A source that is unstable again stays an error; one that is
    gone stays visible as an error with the reason source_unstable_disappeared_on_retry and no body. There is no third pass, and none at all if nothing was unstable.
    """
    first = settled(scan(None))
    shaky = first.filter(is_unstable(F.col("reason"))).select(key)
    if shaky.isEmpty():
        return first
    second = settled(scan(shaky))
    calm = first.join(shaky, key, "left_anti")
    lost = first.join(shaky, key, "left_semi").join(second.select(key), key, "left_anti")
    cleared = {"status": F.lit("error"), "reason": F.lit("source_unstable_disappeared_on_retry")} | {c: F.lit(None).cast(first.schema[c].dataType) for c in ("body", "sha256") if c in first.columns}
    return calm.unionByName(second).unionByName(lost.withColumns(cleared))


def tainted(reads: DataFrame, source: str, guard: str, order: list[str]) -> DataFrame:
    """Reads of a run with `verified`: whether the read and all before it have the guard of the source's first read.

    Taint is sticky: a source that once differed is never trusted again in the run, even if its content comes back. A read without a guard
    differs. A source has one row a read, so its reads are few.
    """
    before = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    expected = F.first(F.struct(F.col(guard).alias("g"))).over(before)["g"]
    same = F.coalesce(F.col(guard) == expected, F.lit(False))
    return reads.withColumn("_same", same).withColumn("verified", F.min("_same").over(before)).drop("_same")
