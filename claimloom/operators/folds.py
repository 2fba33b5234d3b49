"""Folds that depend on the row before: rows of a key in order, streamed through a partition."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import _parse_datatype_string

OUT_ROWS = 10_000


def by_group(df: DataFrame, keys: list[str], order: list[str | Column], fold: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """fold's rows for each key's rows in order.

    Keys are hashed to partitions and sorted there, so a worker holds one key's rows at a time and many small keys cost
    no call of their own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    ranked = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        held: list[dict] = []
        out: list[tuple] = []

        def batch():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            for row in b.to_pylist():
                if held and any(held[0][k] != row[k] for k in keys):
                    out += fold(held)
                    held = []
                    if len(out) >= OUT_ROWS:
                        yield batch()
                        out = []
                held.append(row)
        if held:
            out += fold(held)
        if out:
            yield batch()

    return ranked.mapInArrow(run, schema)

