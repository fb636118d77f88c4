"""Random projections: CountSketch and dense Rademacher, with a quality report."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.hashing import bucket, hash32, sign, uniform
from quillon.functions.vectors import at_least, dot, norm, sanitize
from quillon.operators import dense


#: Entries of a dense projection, and rows of a table of all pairs, at most.
MOST_ENTRIES, MOST_ROWS = 1 << 20, 4096
#: Shifts and odd factors of the coordinates' hash; products stay below 2^63.
_LOW, _ROUNDS = np.uint64(2**32 - 1), ((16, 2146121005), (15, 1540483477))


def coordinate_table(spark: SparkSession, dim: int, width: int, seed: int = 0) -> DataFrame:
    """Bucket and sign of each coordinate; computed once a coordinate, never once an element."""
    return spark.range(dim).select(F.col("id").cast("int").alias("i"), bucket("id", width, seed).alias("b"), sign("id", seed).alias("s"))


def block_plan(spark: SparkSession, dim: int, block: int = 1 << 22, seed: int = 0) -> DataFrame:
    """M1: (chunk, offset, length, seed) of the blocks of a long vector."""
    n = -(-dim // block)
    at = F.col("id") * block
    return spark.range(n).select(F.col("id").alias("chunk"), at.alias("offset"), F.least(F.lit(block), F.lit(dim) - at).alias("length"), (F.lit(seed * 1_000_003) + F.col("id")).alias("seed"))


def count_sketch(df: DataFrame, v: str, dim: int, width: int, seed: int = 0, out: str = "sketch") -> DataFrame:
    """M2: *df* with the sketch of *v* and its exact norm; one pass, no shuffle.

    The table of a plan-time dimension is folded into one index list for each bucket, so a row's sketch is *width*
    signed sums over its own array.  Non-finite coordinates count as 0, a null vector as zeros.
    """
    rows = coordinate_table(df.sparkSession, dim, width, seed).collect()  # dim rows, the length of one vector
    by_bucket = [[{"i": r["i"], "s": float(r["s"])} for r in rows if r["b"] == b] for b in range(width)]
    lists = F.from_json(F.lit(json.dumps(by_bucket)), "array<array<struct<i:int,s:double>>>")  # folded to one literal
    df = df.withColumn("_v", F.coalesce(sanitize(v), F.array_repeat(F.lit(0.0), dim)))
    sketch = F.transform(lists, lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + x["s"] * F.coalesce(F.get("_v", x["i"]), F.lit(0.0))))
    return df.withColumns({out: sketch, f"{out}_norm": norm("_v")}).drop("_v")


def count_sketch_long(blocks: DataFrame, id: str, offset: str, v: str, width: int, seed: int = 0) -> DataFrame:
    """M2 with the hash of :func:`count_sketch`, a row for each coordinate: for checks; :func:`block_sketch` is for size."""
    x = blocks.select(id, offset, F.posexplode(v).alias("_i", "_x")).withColumn("_i", F.col("_i") + F.col(offset))
    return x.groupBy(id, bucket("_i", width, seed).alias("b")).agg(F.sum(sign("_i", seed) * F.col("_x")).alias("value"))


def cell_hash(i: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of coordinate numbers below 2^32 that any engine with 64-bit integers can repeat."""
    h = (np.asarray(i, np.uint64) + np.uint64(seed * 1_000_003)) & _LOW
    for shift, factor in _ROUNDS:
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & _LOW
    return h ^ (h >> np.uint64(15))


def block_sketch(blocks: DataFrame, id: str, offset: str, v: str, width: int, seed: int = 0, out: str = "sketch") -> DataFrame:
    """M2, A7 for vectors kept as blocks (id, offset, values), of any length: id, n_blocks, the sketch and the exact norm.

    A task hashes the coordinates of a block once for all vectors that have it, and keeps one dense sketch for each vector
    it meets; what moves is a sketch for each task and vector.  Non-finite and null coordinates count as 0, null blocks
    and those of null ids are left out.  Coordinates are numbered below 2^32.
    """
    slim = blocks.where(F.col(id).isNotNull() & F.col(v).isNotNull()).select(id, F.col(offset).cast("long").alias("_at"), F.col(v).cast("array<double>").alias("_v"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        cells: dict = {}
        for batch in batches:
            ids, at = batch.column(0), batch.column(1).to_pylist()
            flat, ends = dense.vectors(batch.column(2))
            flat = np.where(np.isfinite(flat), flat, 0.0)
            for r, key in enumerate(ids.to_pylist()):
                x = flat[ends[r] : ends[r + 1]]
                known = cells.get((at[r], len(x)))
                if known is None:
                    h = cell_hash(at[r] + np.arange(len(x)), seed)
                    known = (h % np.uint64(width)).astype(np.int32), np.where(h >> np.uint64(31), 1.0, -1.0).astype(np.float32)
                    if sum(len(k[0]) for k in cells.values()) > dense.MOST_CELLS:
                        cells.clear()
                    cells[at[r], len(x)] = known
                if key not in held:
                    held[key] = [0, np.zeros(width + 1)]
                held[key][0] += 1
                held[key][1][:width] += np.bincount(known[0], known[1] * x, width)
                held[key][1][width] += x @ x
            if len(held) * width > dense.MOST_CELLS:
                yield dense.rows_of((id,), ["s"], [ids.type], [((k,), 0, n, [s]) for k, (n, s) in held.items()])
                held = {}
        if held:
            yield dense.rows_of((id,), ["s"], [ids.type], [((k,), 0, n, [s]) for k, (n, s) in held.items()])

    parts = slim.mapInArrow(fold, dense.schema_of(slim, (id,), ["s"]))
    merged = dense.merged(parts, (id,), ["s"])
    return merged.select(id, F.col("n").alias("n_blocks"), F.slice("s", 1, width).alias(out), F.sqrt(F.get("s", F.lit(width))).alias(f"{out}_norm"))


def rademacher(df: DataFrame, v: str, dim: int, width: int, seed: int = 0, out: str = "dense") -> DataFrame:
    """M3: the dense projection with signs from the hash of (row, coordinate), over the root of the width."""
    return _dense(df, v, dim, width, sign("id", seed + 1), out)


def gaussian(df: DataFrame, v: str, dim: int, width: int, seed: int = 0, out: str = "dense") -> DataFrame:
    """M3: the dense projection with normal entries, from two hashed uniforms each, over the root of the width."""
    return _dense(df, v, dim, width, F.sqrt(-2 * F.log(1 - uniform("id", "u", seed + 1))) * F.cos(2 * math.pi * uniform("id", "v", seed + 1)), out)


def _dense(df: DataFrame, v: str, dim: int, width: int, entry: Column, out: str) -> DataFrame:
    """Rows of a dim x width matrix as one literal of the plan, as CountSketch's table: a projection is a pass without a shuffle.

    For validation on short vectors; a matrix of more than MOST_ENTRIES entries raises, as a plan is no place for it.
    """
    if dim * width > MOST_ENTRIES:
        raise ValueError(f"a dense projection of {dim} x {width} entries; sketch such vectors")
    spark = df.sparkSession
    rows = spark.range(dim * width).select("id", entry.cast("double").alias("e")).orderBy("id").collect()
    matrix = [[rows[r * dim + i]["e"] for i in range(dim)] for r in range(width)]
    literal = F.from_json(F.lit(json.dumps(matrix)), "array<array<double>>")
    return df.withColumn(out, F.transform(literal, lambda r: dot(F.col(v), r) / (width**0.5)))


#: N-7: projections by name, each (df, vector, dim, width, seed, out).
PROJECTIONS = {"hashed": count_sketch, "rademacher": rademacher, "gaussian": gaussian}


def make_projection(method: str):
    if method not in PROJECTIONS:
        raise ValueError(f"unknown projection {method!r}; known: {', '.join(PROJECTIONS)}")
    return PROJECTIONS[method]


def all_pairs(df: DataFrame, id: str, *vectors: str) -> DataFrame:
    """Every two rows i < j of a table of few rows, centroids or a validation sample, with the cosine of each vector column.

    The table is one array that is sent to the tasks; more than MOST_ROWS rows raise.
    """
    n = df.count()
    if n > MOST_ROWS:
        raise ValueError(f"all pairs of {n} rows; sample them first")
    other = df.agg(F.collect_list(F.struct(F.col(id).alias("j"), *vectors)).alias("_all"))
    both = df.crossJoin(F.broadcast(other)).withColumn("_o", F.explode("_all")).where(F.col(id) < F.col("_o.j"))
    cos = lambda c: (dot(F.col(c), F.col(f"_o.{c}")) / (at_least(norm(F.col(c))) * at_least(norm(F.col(f"_o.{c}"))))).alias(f"cos_{c}")
    return both.select(F.col(id).alias("i"), F.col("_o.j").alias("j"), *[cos(c) for c in vectors])


def self_test(df: DataFrame, id: str, exact: str, sketched: str, saved_norm: str, width: int, pairs: int = 200, seed: int = 0) -> DataFrame:
    """M5: inner products of seeded pairs against the bound 1 / sqrt(width), and the largest error of the exact norms."""
    both = _seeded_pairs(df, id, pairs, seed, exact, sketched)
    size = at_least(norm(F.col(f"_0.{exact}"))) * at_least(norm(F.col(f"_1.{exact}")))
    off = F.abs(dot(F.col(f"_0.{sketched}"), F.col(f"_1.{sketched}")) - dot(F.col(f"_0.{exact}"), F.col(f"_1.{exact}"))) / size
    norms = df.agg(F.max(F.abs(norm(F.col(exact)) - F.col(saved_norm))).alias("norm_error"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(off).alias("mean_error"), F.max(off).alias("max_error")).crossJoin(F.broadcast(norms)).withColumn("bound", F.lit(width**-0.5))


def _seeded_pairs(df: DataFrame, id: str, pairs: int, seed: int, *columns: str) -> DataFrame:
    """Neighbours in a seeded order of at most 2 * *pairs* rows, as structs _0 and _1."""
    from pyspark.sql import Window

    some = df.orderBy(hash32(id, "pair", seed), id).limit(2 * pairs).select(id, *columns)
    some = some.withColumn("_r", F.row_number().over(Window.orderBy(hash32(id, "pair", seed), id)) - 1).withColumn("_p", F.floor(F.col("_r") / 2))
    return some.groupBy("_p").agg(*[F.max(F.when(F.col("_r") % 2 == k, F.struct(*columns))).alias(f"_{k}") for k in (0, 1)]).where("_0 is not null and _1 is not null")


def quality_report(df: DataFrame, id: str, exact: str, sketched: str, pairs: int = 200, seed: int = 0) -> DataFrame:
    """M4: cosines of hash-sampled pairs in the exact and the sketched space: mean and largest error, correlation.

    Both members of a pair are looked up by rank in a seeded order of at most 2 * *pairs* rows.
    """
    both = _seeded_pairs(df, id, pairs, seed, exact, sketched)
    cos = lambda c: dot(F.col(f"_0.{c}"), F.col(f"_1.{c}")) / (at_least(norm(F.col(f"_0.{c}"))) * at_least(norm(F.col(f"_1.{c}"))))
    both = both.select(cos(exact).alias("e"), cos(sketched).alias("s"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("e") - F.col("s"))).alias("mean_error"), F.max(F.abs(F.col("e") - F.col("s"))).alias("max_error"), F.try_divide(F.covar_samp("e", "s"), F.stddev_samp("e") * F.stddev_samp("s")).alias("corr"))
