"""Scans and sinks with the checks that go with them."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))

#: The tables of the engine; partition columns take the place of names in paths.  K is ``n_clusters`` here, since column
#: names do not tell K from k.
SCHEMAS = {
    "pairs_raw": T.StructType([T.StructField("idx", T.LongType()), T.StructField("chosen", MESSAGES), T.StructField("rejected", MESSAGES)]),
    "token_products": T.StructType([T.StructField("idx", T.LongType()), T.StructField("t", T.IntegerType()), T.StructField("direction", T.StringType()), T.StructField("dot", T.DoubleType())]),
    "token_norms": T.StructType([T.StructField("idx", T.LongType()), T.StructField("t", T.IntegerType()), T.StructField("g_norm", T.DoubleType())]),
    "example_norms": T.StructType([T.StructField("idx", T.LongType()), T.StructField("direction", T.StringType()), T.StructField("norm", T.DoubleType())]),
    "embeddings_sketch": T.StructType([T.StructField("weighting", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("emb", VECTOR), T.StructField("gnorm", T.DoubleType())]),
    "assignments": T.StructType([T.StructField("weighting", T.StringType()), T.StructField("n_clusters", T.IntegerType()), T.StructField("idx", T.LongType()), T.StructField("cluster", T.IntegerType())]),
    "centroids": T.StructType([T.StructField("weighting", T.StringType()), T.StructField("n_clusters", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("center", VECTOR), T.StructField("norm", T.DoubleType()), T.StructField("n_averaged", T.LongType())]),
    "fingerprint": T.StructType([T.StructField("name", T.StringType()), T.StructField("numel", T.LongType()), T.StructField("sum", T.DoubleType()), T.StructField("sumsq", T.DoubleType())]),
    "metrics": T.StructType([T.StructField("step", T.LongType()), T.StructField("mode", T.StringType()), T.StructField("key", T.StringType()), T.StructField("value", T.DoubleType())]),
}


@dataclass(frozen=True)
class RunConfig:
    """What a run was told; written beside its results."""

    direction: str = "single_unweighted"
    method: str = "sigmoid_dot"
    sum_mode: str = "token_count"
    dot_scale: str = "raw"
    beta: float = 0.1
    seed: int = 1234

    def name(self, base: str = "run") -> str:
        """The base name with a tag for each setting that is not the default."""
        default = asdict(RunConfig())
        return "_".join([base, *(f"{k}-{v}" for k, v in asdict(self).items() if v != default[k])])

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: that of ``spark.checkpoint.dir``.

    Where it is unset, it is the warehouse, and a temporary folder if Spark runs in this process alone.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.startswith("local["):
        found = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(found)
    found = found or spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/quillon/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """*df* written in the shared folder and read back: it is found once, and its lineage ends there."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, path: str, name: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Parquet or JSON, with the engine's schema if *name* is one of its tables."""
    reader = spark.read.format(fmt)
    return (reader.schema(SCHEMAS[name]) if name else reader).load(path)


def first_rows(df: DataFrame, n: int, key: str = "idx") -> DataFrame:
    """Rows whose key is below *n*; a filter that reaches the scan, not a limit."""
    return df.where(F.col(key) < n)


def index_range(df: DataFrame, start: int, end: int, n: int, key: str = "idx") -> DataFrame:
    """S3: rows with start <= key < end; -1 stands for *n*, and both ends are clamped."""
    end = n if end == -1 else min(end, n)
    return df.where((F.col(key) >= max(start, 0)) & (F.col(key) < end))


def shard_name(kind: str, start: int, end: int) -> str:
    """Zero-padded, never cut."""
    return f"{kind}_{start:06d}_{end:06d}"


def scan_shards(spark: SparkSession, path: str, weighting: str) -> tuple[DataFrame, DataFrame]:
    """The embeddings of one weighting, and the ids that come more than once (a warning, not an error)."""
    df = spark.read.parquet(path)
    need(df, "idx", "emb", "gnorm", "weighting")
    df = df.where(F.col("weighting") == weighting)
    return df, df.groupBy("idx").count().where("count > 1")


def need(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df


def cluster_runs(assignments: DataFrame, weighting: str) -> list[int]:
    """The numbers of clusters there are for a weighting, rising; read from partition values."""
    return [r["n_clusters"] for r in assignments.where(F.col("weighting") == weighting).select("n_clusters").distinct().orderBy("n_clusters").collect()]


def scan_assignments(assignments: DataFrame, weighting: str, k: int) -> DataFrame:
    """One clustering, which must name every cluster 0 ... K-1 as its greatest."""
    found = assignments.where((F.col("weighting") == weighting) & (F.col("n_clusters") == k))
    top = found.agg(F.max("cluster")).first()[0]
    if top is None or top + 1 != k:
        raise ValueError(f"assignments of K={k} end at cluster {top}")
    return found


def scan_centroids(centroids: DataFrame, weighting: str, k: int, kind: str, dim: int | None = None) -> DataFrame:
    """All K centroids of a kind, of one dimension."""
    found = centroids.where((F.col("weighting") == weighting) & (F.col("n_clusters") == k) & (F.col("kind") == kind))
    n, low, high = found.agg(F.count_distinct("k"), F.min(F.size("center")), F.max(F.size("center"))).first()
    if n != k:
        raise ValueError(f"{n} of {k} centroids of kind {kind!r}")
    if dim is not None and (low, high) != (dim, dim):
        raise ValueError(f"centroids have {low} to {high} coordinates, not {dim}")
    return found


def exact_norms(df: DataFrame, wanted: DataFrame, key: str = "idx", norm: str = "gnorm") -> DataFrame:
    """The norm of every wanted id; missing, non-finite or non-positive ones raise."""
    joined = wanted.select(key).join(df.select(key, norm), key, "left")
    bad = ~F.coalesce((F.col(norm) > 0) & (F.col(norm) < float("inf")), F.lit(False))
    missing, faulty = joined.agg(F.count_if(F.col(norm).isNull()), F.count_if(F.col(norm).isNotNull() & bad)).first()
    if missing or faulty:
        raise ValueError(f"{missing} ids have no norm and {faulty} norms are not positive and finite")
    return joined


def scalar_norms(spark: SparkSession, text: str) -> DataFrame:
    """The numeric values of a JSON map as (direction, norm)."""
    one = spark.createDataFrame([(text,)], "j string")
    pairs = one.select(F.explode(F.from_json("j", T.MapType(T.StringType(), T.StringType()))).alias("direction", "v"))
    return pairs.select("direction", F.expr("try_cast(v as double)").alias("norm")).where("norm is not null")


def complete(df: DataFrame, artefacts: list[str], metadata: str = "metadata") -> DataFrame:
    """examples whose metadata parses and that have every artefact."""
    ok = F.expr(f"try_parse_json(`{metadata}`)").isNotNull()
    for a in artefacts:
        ok = ok & F.col(a).isNotNull()
    return df.where(ok)


def first_complete(df: DataFrame, artefacts: list[str], n: int, order: str, metadata: str = "metadata") -> DataFrame:
    """The first *n* complete examples; none at all is an error."""
    found = complete(df, artefacts, metadata).orderBy(order).limit(n)
    if found.isEmpty():
        raise ValueError("no complete example")
    return found


def same_length(df: DataFrame, n: str, expected: str) -> tuple[DataFrame, DataFrame]:
    """rows whose lengths agree, and the others."""
    agree = F.coalesce(F.col(n) == F.col(expected), F.lit(False))
    return df.where(agree), df.where(~agree)


def write(df: DataFrame, path: str, by: list[str] | None = None, max_rows: int | None = None) -> None:
    """K1-K3, K6: Parquet, replaced partition by partition by Spark's committer; schemas survive empty frames."""
    writer = df.write.mode("overwrite")
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def rechunk(df: DataFrame, path: str, max_rows: int, files: int, key: str = "idx") -> None:
    """K4, K5: rewritten in key order with at most *max_rows* rows a file, then compared with the source."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(path)
    missing, extra = difference(df, df.sparkSession.read.parquet(path))
    if missing or extra:
        raise ValueError(f"{missing} rows are missing and {extra} are new after the rewrite")


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str = "artefact") -> str:
    """An artefact laid down by *key* once, so that later lookups by it move nothing; returns the table's name.

    One file a bucket, sorted by key.  Tables that are to meet need the same number of buckets, chosen for the largest of them.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, key)  # the writer's own hash: each task holds one bucket
    spread.write.bucketBy(buckets, key).sortBy(key).option("path", workspace(spark, name)).saveAsTable(table)
    return table


def lookup(spark: SparkSession, left: str, right: str, key: str, how: str = "inner") -> DataFrame:
    """Two bucketed tables by *key*, each bucket with its counterpart, without an exchange on either side."""
    return spark.table(left).hint("merge").join(spark.table(right).hint("merge"), key, how)


def checksum(df: DataFrame) -> DataFrame:
    """One row that tells multisets of rows apart, whatever their order: the count and sums of two wide hashes of each row.

    Sums commute, so this is one partial aggregation and no row moves.  The hashes see where nulls are, in arrays too.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    first = F.xxhash64(*columns, *[c.isNull() for c in columns])
    second = F.xxhash64(F.lit("row"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    wide = lambda h: F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)"))
    return df.agg(F.count(F.lit(1)).alias("n"), wide(first).alias("a"), wide(second).alias("b"), F.bit_xor(first).alias("x"))


def difference(a: DataFrame, b: DataFrame) -> tuple[int, int]:
    """Rows of each side that the other lacks, repeats counted.

    Sides of equal checksums are equal; only others are held against each other row by row, to count what differs.
    """
    if checksum(a).first() == checksum(b.select(*[F.col(f"`{c}`") for c in a.columns])).first():
        return 0, 0
    return a.exceptAll(b).count(), b.exceptAll(a).count()


def write_json(df: DataFrame, path: str) -> None:
    """Sidecars of few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_version(df: DataFrame, path: str) -> int:
    """K8: written as the next version of a table; earlier versions stay."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    version = 1 + (spark.read.parquet(path).agg(F.max("version")).first()[0] or 0) if exists else 1
    df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)
    return version


def append_metrics(df: DataFrame, path: str) -> None:
    """Rows (step, mode, key, value)."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS["metrics"]]).write.mode("append").parquet(path)
