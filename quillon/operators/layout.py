"""Partition layout: spreading rows over cores, sums and ranks in order without one window over a table.

A scan works in two phases.  Spark's range partitioning cuts the order into buckets of about equal size, whatever the keys are:
sparse, negative, strings or several columns.  Each bucket is one task, and is written once with its own running sums, so that a
scan of a scan does not find the first one again for every use.  Buckets' totals alone meet in one window, and what lies before
a bucket is added to its sums.  How rows are dealt does not change the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.tables import staged

#: Of an id that grows in a partition: the bits of the row's place, below those of the partition.
PLACE_BITS = 33
#: Tables of so many rows are sent to the tasks; greater ones are joined by a shuffle.
SENT_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """*df* over all cores before costly work on each row, where a scan of a few row groups gives fewer tasks than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _names(order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _buckets(spark: SparkSession) -> int:
    return 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _cut(df: DataFrame, names: list[str], buckets: int, out: str) -> DataFrame:
    return df.repartitionByRange(buckets, *names).withColumn(out, F.spark_partition_id())


def bucketed(df: DataFrame, order: str | list[str], buckets: int | None = None, out: str = "_bucket") -> DataFrame:
    """*df* with the number of its bucket: rows of smaller *order* have no greater one, and equal rows the same.  Written once."""
    return staged(_cut(df, _names(order), buckets or _buckets(df.sparkSession), out), "buckets")


def sent(df: DataFrame) -> DataFrame:
    """A written table to join with: sent to the tasks while it is small, so that no key gathers rows in one task."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def prefix_sums(df: DataFrame, order: str | list[str], value: str, out: str, buckets: int | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """*df* with the sum of *value* over rows of smaller *order*, without the columns *drop*; of rows equal in *order* any may come first.

    Nulls come first, as in Spark's order.  *order* should be unique: rows that share a key share a bucket.  Buckets go to tasks
    by their numbers, since hashes of so few numbers would put several in one task and none in others.
    """
    names, n = _names(order), buckets or _buckets(df.sparkSession)
    within = Window.partitionBy("_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    cut = _cut(df, names, n, "_bucket").repartitionById(n, "_bucket")
    local = staged(cut.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0))).drop(*(c for c in drop if c != value)), "sums")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as buckets
    bases = local.groupBy("_bucket").agg(F.sum(value).alias("_total")).select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    return local.join(F.broadcast(bases), "_bucket").withColumn(out, F.col("_base") + F.col("_local")).drop("_bucket", "_base", "_local", *drop)


def ranked(df: DataFrame, order: str | list[str], out: str = "rank", keys: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """*df* with the place of each row by *order*, from 0; with *keys* within its group, of any size; without the columns *drop*.

    Rows are sorted by group and order, one shuffle, and numbered in their buckets as they are written.  A bucket's rows begin
    where those before it end, less the place where their group begins, so a group that holds most rows is cut like
    any other stretch of the order.
    """
    names = [*keys, *_names(order)]
    numbered = df.repartitionByRange(_buckets(df.sparkSession), *names).sortWithinPartitions(*names).withColumn("_at", F.monotonically_increasing_id()).drop(*drop)
    rows = staged(numbered, "ordered")
    bucket = lambda at: F.shiftright(at, PLACE_BITS)
    place = lambda at: F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    rows = rows.withColumn("_bucket", bucket("_at"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as buckets
    bases = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    shifts = bases.withColumnRenamed("_base", "_shift")
    if keys:
        bases = staged(bases, "bases")
        first = rows.groupBy("_bucket", *keys).agg(F.min("_at").alias("_first")).withColumn("_first", F.min("_first").over(Window.partitionBy(*keys)))
        begin = bases.select(F.col("_bucket").alias("_from"), F.col("_base").alias("_begin"))
        first = first.withColumn("_from", bucket("_first")).join(F.broadcast(begin), "_from").join(F.broadcast(bases), "_bucket")
        shifts = first.select("_bucket", *keys, (F.col("_base") - F.col("_begin") - place("_first")).alias("_shift"))
    met = beside(rows, sent(staged(shifts, "shifts")), "_bucket", *keys)
    return met.withColumn(out, place("_at") + F.col("_shift")).drop("_at", "_bucket", "_shift")


def beside(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """*rows* with the columns of *table*, a row for each of *keys*, null equal to null."""
    renamed = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    return rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*[f"_k_{k}" for k in keys])


def inverse_cdf(df: DataFrame, order: str | list[str], weight: str, shares: list[float]) -> DataFrame:
    """For each share u the first row, by *order*, whose cumulative weight reaches u times the total: (order, u)."""
    names = _names(order)
    summed = prefix_sums(df.select(*names, weight), names, weight, "_before")
    total = F.lit(df.agg(F.sum(weight)).first()[0])
    picks = F.array(*[F.lit(float(u)) for u in shares])
    reach = F.filter(picks, lambda u: (u * total > F.col("_before")) & (u * total <= F.col("_before") + F.col(weight)))
    return summed.select(*names, F.explode(reach).alias("u"))


def blocks(spec: DataFrame, order: str, numel: str) -> DataFrame:
    """Each block's offset, the sum of the sizes before it."""
    return prefix_sums(spec, order, numel, "offset")


def flatten_blocks(df: DataFrame, spec: list[tuple[str, int]], out: str = "flat"):
    """Named array columns laid end to end in the order of *spec* (name, size); a null block is zeros."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return df.withColumn(out, F.concat(*[F.coalesce(F.col(name).cast("array<double>"), zeros(n)) for name, n in spec]))


def unflatten(df: DataFrame, v: str, spec: list[tuple[str, int]]) -> DataFrame:
    """A vector cut into named blocks; a length that the blocks do not add up to raises."""
    total, at, cut = sum(n for _, n in spec), 1, {}
    fits = F.when(F.size(v) != total, F.raise_error(F.lit(f"vector is not {total} long"))).otherwise(F.col(v))
    for name, n in spec:
        cut[name] = F.slice(fits, at, n)
        at += n
    return df.withColumns(cut)
