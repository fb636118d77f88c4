"""Control weights: Python's own generator, seeded for each example."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed value: what a run's seed is multiplied by before the example's number is added.
SEED_STEP = 1_000_003


def control_weights(df: DataFrame, idx: str, n: str, low: float, high: float, seed: int) -> DataFrame:
    """(idx, weights): *n* uniform draws for each example from a generator of its own, bit by bit those of a plain loop."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, count in zip(*(c.to_pylist() for c in batch.columns)):
                r = random.Random(seed * SEED_STEP + i)
                out.append([r.uniform(low, high) for _ in range(count)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=[idx, "weights"])

    return df.select(idx, n).mapInArrow(draw, f"`{idx}` {dict(df.dtypes)[idx]}, weights array<double>")
