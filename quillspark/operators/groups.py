"""Folds in Python over the rows of one key, whose next step depends on the last."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are Python objects at once while a partition is read, and rows of a batch that goes back. Fixed values.
READ, GIVEN = 2048, 8192


def folded(rows: DataFrame, key: str, order: list[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What fold gives for each key's rows, which it gets as tuples in order (nulls last); schema tells what it gives.

    Keys are many and small, and a table a key costs a thousand times what its rows do. So the keys of a partition are read as one sorted stream,
    and only the rows of one key are held.
    """
    at, out = rows.columns.index(key), to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)

        parts = (b.slice(i, READ) for b in batches for i in range(0, b.num_rows, READ))
        stream = (r for p in parts for r in zip(*(c.to_pylist() for c in p.columns)))
        held: list[tuple] = []
        for _, group in groupby(stream, itemgetter(at)):
            held += fold(list(group))
            if len(held) >= GIVEN:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return rows.repartition(key).sortWithinPartitions(key, *(F.asc_nulls_last(c) for c in order)).mapInArrow(run, schema)
