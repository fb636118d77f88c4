"""Sums and means of vectors of any length: states of dense blocks that merge.

A task keeps one sum for each group and block of BLOCK coordinates, in Arrow buffers, and sends it when the task ends or
when its sums would take more than MOST_CELLS numbers.  States of one group and block are then added in two levels: first
those of tasks of one residue modulo FAN, then the residues; each level streams through rows that are sorted by group and
block and holds one sum.  The plan has the same size for every number of coordinates, and a row that moves is a block.

Defined results: a null vector is left out and does not count; a null coordinate makes its sum NaN; vectors of one group
that differ in length raise.  A group without vectors has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coordinates of a block, numbers that a task holds, and parts of the first level of a merge.
BLOCK, MOST_CELLS, FAN = 4096, 8 << 20, 64


def schema_of(df: DataFrame, keys: tuple[str, ...], names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {types[k]}" for k in keys), "offset long", "n long", *(f"`{name}` array<double>" for name in names)])


def rows_of(keys: tuple[str, ...], names: list[str], types: list, found: list[tuple]) -> pa.RecordBatch:
    """*found*: (group, offset, n, one vector for each of *names*)."""
    columns = [pa.array([r[0][i] for r in found], t) for i, t in enumerate(types)]
    columns += [pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.int64())]
    ends = np.cumsum([0, *(len(r[3][0]) for r in found)]).astype(np.int32)
    for i in range(len(names)):
        flat = np.concatenate([r[3][i] for r in found]) if found else np.zeros(0)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
    return pa.RecordBatch.from_arrays(columns, names=[*keys, "offset", "n", *names])


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column end to end, and where each row's begin, with the end of the last."""
    ends = column.offsets.to_numpy(zero_copy_only=False)
    flat = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False)
    return np.asarray(flat, float), ends - ends[0]


def sums(df: DataFrame, v: str, *keys: str, weights: dict[str, Column] | None = None, offset: str | None = None, block: int = BLOCK) -> DataFrame:
    """keys, offset, n and for each weighting the sum of weight times vector, a row for each group and block.

    *offset* names the place of a row's first coordinate where vectors come in blocks already; a vector in one row is
    cut here.  Without *weights* the sum is called ``sum``.
    """
    return merged(states(df, v, *keys, weights=weights, offset=offset, block=block), keys, list(weights or ["sum"]))


def states(df: DataFrame, v: str, *keys: str, weights: dict[str, Column] | None = None, offset: str | None = None, block: int = BLOCK) -> DataFrame:
    """What tasks send of :func:`sums`: partial sums, as many rows of a group and block as tasks have met it.  Streams have them too."""
    named = weights or {"sum": F.lit(1.0)}
    names = list(named)
    at = F.col(offset).cast("long") if offset else F.lit(0).cast("long")
    slim = df.where(F.col(v).isNotNull()).select(*keys, at.alias("offset"), F.col(v).cast("array<double>").alias("_v"), *[w.cast("double").alias(f"_w{i}") for i, w in enumerate(named.values())])

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        cells, types = 0, None
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys))]
            if not batch.num_rows:
                continue
            group = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))], batch.column(len(keys)).to_pylist()))
            place = {g: i for i, g in enumerate(dict.fromkeys(group))}
            code = np.fromiter((place[g] for g in group), np.int64, len(group))
            flat, ends = vectors(batch.column(len(keys) + 1))
            w = np.stack([batch.column(len(keys) + 2 + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                sizes = np.unique(ends[part + 1] - ends[part])
                key = group[part[0]]
                if len(sizes) > 1 or key in held and held[key][1].shape[1] != sizes[0]:
                    raise ValueError(f"vectors of group {key} differ in length")
                x = flat[(ends[part][:, None] + np.arange(sizes[0]))]
                if key not in held:
                    held[key] = [0, np.zeros((len(names), sizes[0]))]
                    cells += held[key][1].size
                held[key][0] += len(part)
                held[key][1] += w[:, part] @ x
            if cells > MOST_CELLS:
                yield from cut(held, types)
                held, cells = {}, 0
        if held:
            yield from cut(held, types)

    def cut(held: dict, types: list) -> Iterator[pa.RecordBatch]:
        for key, (n, total) in held.items():
            starts = range(0, max(1, total.shape[1]), block)
            yield rows_of(keys, names, types, [(key[:-1], key[-1] + a, n, total[:, a : a + block]) for a in starts])

    return slim.mapInArrow(accumulate, schema_of(slim, keys, names))


def merged(states: DataFrame, keys: tuple[str, ...], names: list[str]) -> DataFrame:
    """States (keys, offset, n, vectors) of the same group and block added up, in two levels."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, total, types = None, 0, None, None
        done: list[tuple] = []
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys))]
            group = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys) + 1)]))
            counts = batch.column(len(keys) + 1).to_pylist()
            parts = [vectors(batch.column(len(keys) + 2 + i)) for i in range(len(names))]
            for r, key in enumerate(group):
                row = [flat[ends[r] : ends[r + 1]] for flat, ends in parts]
                if key != current:
                    if current is not None:
                        done.append((current[:-1], current[-1], n, total))
                    current, n, total = key, 0, [np.zeros(len(x)) for x in row]
                if any(len(a) != len(b) for a, b in zip(total, row)):
                    raise ValueError(f"vectors of group {key} differ in length")
                n, total = n + counts[r], [a + b for a, b in zip(total, row)]
            if len(done) >= 64:
                yield rows_of(keys, names, types, done)
                done = []
        if current is not None:
            yield rows_of(keys, names, types, [*done, (current[:-1], current[-1], n, total)])

    schema = schema_of(states, keys, names)
    level = states.withColumn("_part", F.spark_partition_id() % FAN)
    level = level.repartition(*keys, "offset", "_part").sortWithinPartitions("_part", *keys, "offset").drop("_part").mapInArrow(add, schema)
    return level.repartition(*keys, "offset").sortWithinPartitions(*keys, "offset").mapInArrow(add, schema)


def means(df: DataFrame, v: str, *keys: str, weights: dict[str, Column] | None = None, offset: str | None = None, block: int = BLOCK) -> DataFrame:
    """:func:`sums` divided by the number of vectors; without *weights* the column is called ``mean``."""
    found = sums(df, v, *keys, weights=weights, offset=offset, block=block)
    names = list(weights) if weights else ["sum"]
    each = {name: F.transform(name, lambda x: x / F.col("n")) for name in names}
    return found.withColumns(each) if weights else found.withColumns(each).withColumnRenamed("sum", "mean")


def whole(blocks: DataFrame, *keys: str, names: tuple[str, ...] = ("mean",), count: str | None = "n_averaged") -> DataFrame:
    """Blocks put together: a row for each group with its vectors in one array each."""
    gathered = F.array_sort(F.collect_list(F.struct("offset", *names)))
    counts = [F.max("n").alias(count)] if count else []
    joined = [F.flatten(F.col("_b").getField(name)).alias(name) for name in names]
    return blocks.groupBy(*keys).agg(gathered.alias("_b"), *counts).select(*keys, *joined, *([count] if count else []))
