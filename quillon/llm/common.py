"""What several operators share: staging in the shared folder, stable row numbers, prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of bytes outside this ASCII white space.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, the warehouse.

    Only where Spark runs in this process alone, as in tests, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.startswith("local["):
        found = tempfile.mkdtemp(prefix="quillon-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found or spark.conf.get("spark.sql.warehouse.dir")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillon/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """*df* written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`staged` has written for *tables*, which nothing is read from any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._quillon_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that nothing refers to any more, now rather than at its next collection."""
    for _ in range(3):  # Python's references go first, then Spark's own, then the files
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def tidy() -> None:
    """Give freed memory back: a worker lives on after its task, and the next task may be another operator's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def importable(spark: SparkSession) -> None:
    """Let local Python workers import this package wherever they are started; clusters get it with --py-files."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` that tidies up when a task ends; for ``df.transform(map_arrow, function, schema)``."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            tidy()

    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def clean_staging(spark: SparkSession) -> None:
    """Delete everything that :func:`staged` has left in the shared folder; call it when no result is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/quillon")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, keys: list[str], rest: str | None = None, number: str = "copy") -> DataFrame:
    """Each row of *keys* with a number from 0 among its equals, without a window over one hot key.

    Equal rows are counted first (partial aggregation), then unfolded, so a row that is repeated for a third of the
    table costs one counter before the unfolding.  *rest* is a column that numbers rows of equal keys by its order.
    """
    part = [rest] if rest else []
    counted = df.groupBy(*keys, *part).agg(F.count(F.lit(1)).alias("_n"))
    if rest:
        before = Window.partitionBy(*keys).orderBy(rest).rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        counted = counted.withColumn("_from", F.lit(0).cast("long"))
    block = 4096
    parts = counted.select(
        *keys, *part, "_n", "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block))).alias("_b")
    )
    first = F.col("_b") * block
    last = F.least(first + block, F.col("_n")) - 1
    return parts.select(*keys, *part, F.explode(F.sequence(F.col("_from") + first, F.col("_from") + last)).alias(number))


def prefix_sums(df: DataFrame, group: list[str], order: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """*df* with the sum of *value* over smaller *order* (a non-negative long, unique in its *group*), in two levels.

    Blocks of *block* neighbouring orders are summed in parallel; only block totals meet in one window.
    """
    cut = df.withColumn("_blk", F.floor(F.col(order) / block))
    totals = cut.groupBy(*group, "_blk").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*group, "_blk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return null_safe_join(local, base, [*group, "_blk"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_blk", "_base", "_in")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on *keys*, null equal to null, keeping one copy of the keys."""
    renamed = right.select(*[c.alias(f"_r_{name}") if name in keys else c for name, c in zip(right.columns, quoted(right.columns))])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def quoted(names: list[str]) -> list[Column]:
    """Columns by names that may hold dots and back ticks."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
