"""Fingerprints of vector tables and what a difference means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import close

# Tolerances of the classes.
SAME, DRIFT = 1e-5, 1e-2
CLEAN_CORR, SLOPE = 0.995, 0.1
POLICIES = ("fatal", "advisory")


def fingerprint(df: DataFrame, name: str, v: str) -> DataFrame:
    """(name, numel, sum, sumsq) of all coordinates of each name; the array is folded before the shuffle."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return df.groupBy(name).agg(F.sum(F.size(v)).cast("bigint").alias("numel"), F.sum(total).alias("sum"), F.sum(squares).alias("sumsq"))


def verify(saved: DataFrame, now: DataFrame, name: str) -> DataFrame:
    """A row per name: missing, extra, shape, values or ok."""
    s = saved.select(name, *[F.col(c).alias(f"s_{c}") for c in ("numel", "sum", "sumsq")])
    both = s.join(now, name, "full_outer")
    status = (
        F.when(F.col("numel").isNull(), "missing").when(F.col("s_numel").isNull(), "extra").when(F.col("numel") != F.col("s_numel"), "shape")
        .when(close("sum", "s_sum") & close("sumsq", "s_sumsq"), "ok").otherwise("values")
    )
    return both.select(name, status.alias("status"))


def key_difference(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Names that only one side has."""
    x, y = a.select(name).distinct(), b.select(name).distinct()
    return x.exceptAll(y).withColumn("only_in", F.lit("first")).unionByName(y.exceptAll(x).withColumn("only_in", F.lit("second")))


def classify_mismatch(saved: DataFrame, now: DataFrame, name: str) -> DataFrame:
    """Which statistic moved.  Orthogonal changes of basis keep sumsq and move sum."""
    s = saved.select(name, F.col("sum").alias("s_sum"), F.col("sumsq").alias("s_sumsq"))
    rel = lambda c: F.abs(F.col(c) - F.col(f"s_{c}")) / F.greatest(F.abs(F.col(f"s_{c}")), F.lit(1e-30))
    both = s.join(now, name).agg(F.max(rel("sum")).alias("rel_sum"), F.max(rel("sumsq")).alias("rel_sumsq"))
    kind = (
        F.when((F.col("rel_sumsq") < SAME) & (F.col("rel_sum") < SAME), "equal").when(F.col("rel_sumsq") < SAME, "different basis")
        .when(F.col("rel_sumsq") < DRIFT, "different basis and drift").otherwise("different weights")
    )
    return both.withColumn("kind", kind)


def classify_reproduction(stats: DataFrame, *keys: str) -> DataFrame:
    """One verdict, or one for each of *keys*, from channel statistics (see metrics.compare) with flags ``clean`` and ``basis_sensitive``."""
    many = F.col("n") > 1
    worst_slope = F.max_by("slope", F.when(many & F.col("basis_sensitive"), F.abs(F.col("slope") - 1)))
    seen = stats.groupBy(*keys).agg(
        F.every("ok").alias("all_ok"), F.min(F.when(many & F.col("clean") & ~F.col("basis_sensitive"), F.col("corr"))).alias("clean_corr"),
        F.coalesce(worst_slope, F.lit(1.0)).alias("basis_slope"),
    )
    good = F.coalesce(F.col("clean_corr") > CLEAN_CORR, F.lit(False)) & ~F.isnan(F.coalesce("clean_corr", F.lit(0.0)))
    verdict = (
        F.when(F.col("all_ok"), "EXACT").when(good & (F.abs(F.col("basis_slope") - 1) > SLOPE), "SAME MODEL, DIFFERENT PARAMETERISATION")
        .when(good, "SAME MODEL, DRIFTED SUBSPACE").otherwise("DIFFERENT WEIGHTS")
    )
    return seen.withColumn("verdict", verdict)


def enforce(status: DataFrame, policy: str = "fatal") -> DataFrame:
    """With ``fatal`` a fault raises, with ``advisory`` the faults are returned."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    faults = status.where("status <> 'ok'")
    if policy == "fatal" and (first := faults.limit(5).collect()):
        raise ValueError(f"fingerprints differ: {[tuple(r) for r in first]}")
    return faults


def establish(now: DataFrame, path: str, name: str, policy: str = "fatal") -> DataFrame:
    """The first run saves its fingerprint at *path*; later runs are held against it, by *policy*."""
    spark = now.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        now.write.parquet(path)
    return enforce(verify(spark.read.parquet(path), now, name), policy)


def sources(tables: list[DataFrame], column: str = "source_id") -> DataFrame:
    """The runs that artefacts come from, a row each, with the number of tables that name it."""
    each = [t.select(F.col(column).alias("source_id")).distinct() for t in tables]
    found = each[0]
    for t in each[1:]:
        found = found.unionByName(t)
    return found.groupBy("source_id").agg(F.count(F.lit(1)).alias("tables"))


def pinned(saved: DataFrame, now: DataFrame, name: str) -> DataFrame:
    """The rows of a pinned artefact, if both sides have the same names; else the missing and the extra ones raise."""
    if faults := [tuple(r) for r in key_difference(saved, now, name).limit(5).collect()]:
        raise ValueError(f"names differ: {faults}")
    return saved


def same_source(tables: list[DataFrame], column: str = "source_id", overwrite: bool = False) -> None:
    """Refuse to mix artefacts of different runs unless told to overwrite."""
    found = {r[0] for t in tables for r in t.select(column).distinct().limit(3).collect()}
    if len(found) > 1 and not overwrite:
        raise ValueError(f"artefacts of different runs: {sorted(map(str, found))}")


def add_products(rows: DataFrame, path: str, column: str = "source_id", overwrite: bool = False) -> bool:
    """Append *rows* to the artefacts at *path*, if both come from one run; else refuse, or replace them all if told to.

    Says whether the rows were taken; a refusal writes nothing.  One value of *column* on either side is compared, never rows.
    """
    spark = rows.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    try:
        same_source([rows, *([spark.read.parquet(path)] if held and not overwrite else [])], column)
    except ValueError:
        return False
    rows.write.mode("overwrite" if overwrite else "append").parquet(path)
    return True
