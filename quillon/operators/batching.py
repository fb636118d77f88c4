"""Batches: a token budget in order, and a fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.layout import ranked

# Padded tokens and examples of a batch at most.
BUDGET, MOST = 4096, 16


def cut(lengths: np.ndarray, budget: int = BUDGET, most: int = MOST) -> np.ndarray:
    """Batch numbers: a new batch begins where one more example would exceed the padded budget or the count."""
    out = np.zeros(len(lengths), np.int64)
    batch = n = longest = 0
    for i, x in enumerate(lengths.tolist()):
        if n and ((n + 1) * max(longest, x) > budget or n + 1 > most):
            batch, n, longest = batch + 1, 0, 0
        out[i], n, longest = batch, n + 1, max(longest, x)
    return out


def budget_batches(df: DataFrame, key: str, order: str, length: str, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """(key, order, length, batch): greedy in order within each key.

    The recurrence needs a key's rows in order, so they are sorted in one partition each and streamed through; a task
    holds one Arrow batch and four numbers, not its group.
    """
    kinds = dict(df.dtypes)
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{length}` bigint, batch bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, n, longest = object(), 0, 0, 0
        for rows in batches:
            out = np.zeros(rows.num_rows, np.int64)
            for i, (k, x) in enumerate(zip(rows.column(0).to_pylist(), rows.column(2).to_pylist())):
                if k != now:
                    now, batch, n, longest = k, 0, 0, 0
                if n and ((n + 1) * max(longest, x) > budget or n + 1 > most):
                    batch, n, longest = batch + 1, 0, 0
                out[i], n, longest = batch, n + 1, max(longest, x)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out)], names=[key, order, length, "batch"])

    rows = df.select(key, order, F.col(length).cast("bigint").alias(length))
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def fixed_batches(df: DataFrame, order: str, size: int = 4, *keys: str) -> DataFrame:
    """Every *size* rows in order form a batch, the last one may be shorter; without keys, *order* is an integer id."""
    if not keys:
        return ranked(df, order, "_rank").withColumn("batch", F.floor(F.col("_rank") / size)).drop("_rank")
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size))
