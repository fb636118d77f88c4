"""The engine's inputs derived from the test tables, by arithmetic that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.vectors import dot, double, nll, norm, scale, unit
from quillon.functions.weights import with_scores
from quillon.operators.directions import aggregated_scores, single_scores, vector_mean

DIM = 64
LOGITS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, idx, t, label, gnorm, u (unit vector), raw (u times gnorm)."""
    df = table(spark, sf_dir, "embeddings")
    gnorm = 1 + F.pmod(F.col("vec_id") * 37, F.lit(100)) / 10.0
    df = df.select("vec_id", F.floor(F.col("vec_id") / 10).alias("idx"), F.pmod("vec_id", F.lit(10)).alias("t"), "label", gnorm.alias("gnorm"), double("embedding").alias("u"))
    return df.withColumn("raw", scale("u", "gnorm"))


def own_directions(s: DataFrame) -> DataFrame:
    """idx, center: the mean of an example's unit vectors."""
    return vector_mean(s, "u", DIM, "idx")


def mean_direction(s: DataFrame) -> DataFrame:
    return vector_mean(s, "u", DIM)


def centroids(s: DataFrame, kind: str = "mean") -> DataFrame:
    """k, center, n_averaged by label: of raw vectors, or of unit vectors for kind meannorm."""
    return vector_mean(s, "raw" if kind == "mean" else "u", DIM, "label").withColumnRenamed("label", "k")


def single(s: DataFrame) -> DataFrame:
    """idx, t, gnorm, dot, cos, pn of the direction single."""
    tokens = s.withColumn("g_norm", norm("raw"))
    return with_scores(single_scores(tokens, own_directions(s), "idx", "raw", "g_norm"), "idx", p="dot")


def aggregated(s: DataFrame) -> DataFrame:
    return aggregated_scores(s.withColumn("g_norm", norm("raw")), mean_direction(s), "raw", "g_norm")


def _logit_columns() -> dict:
    z = F.transform(F.slice("u", 1, LOGITS), lambda x: x * 4.0)
    ref = F.transform(F.slice("u", LOGITS + 1, LOGITS), lambda x: x * 4.0)
    return {
        "z": z, "ref_z": ref, "target": F.col("label"), "pair_id": F.floor(F.col("idx") / 2),
        "side": F.when(F.pmod("idx", F.lit(2)) == 0, "c").otherwise("r"), "is_completion": F.col("t") >= 2,
    }


def logits(s: DataFrame) -> DataFrame:
    """vec_id, idx, t, z, ref_z, target, pair_id, side, is_completion."""
    return s.select("vec_id", "idx", "t", "label", "u", *[c.alias(name) for name, c in _logit_columns().items()])


def with_logps(z: DataFrame) -> DataFrame:
    return z.withColumn("logp", -nll("z", "target")).withColumn("ref_logp", -nll("ref_z", "target"))


def token_logps(s: DataFrame) -> DataFrame:
    return with_logps(logits(s))


def weighted_tokens(s: DataFrame, w) -> DataFrame:
    """Tokens with their log-probabilities and the weight *w* of their scores, in one pass: both are columns of the same row."""
    tokens = with_logps(s.withColumns(_logit_columns()))
    return single(tokens).withColumn("w", w).withColumn("r", F.col("logp") - F.col("ref_logp"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages in the order of their turns."""
    df = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return df.groupBy("conv_id").agg(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, chosen, rejected: conversations 2i and 2i + 1, by one aggregation."""
    c = conversations(spark, sf_dir)
    pick = lambda k: F.max(F.when(F.pmod("conv_id", F.lit(2)) == k, F.col("messages")))
    return c.groupBy(F.floor(F.col("conv_id") / 2).alias("idx")).agg(pick(0).alias("chosen"), pick(1).alias("rejected")).where("chosen is not null and rejected is not null")


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, chosen_id, rejected_id: good and bad documents of a language matched by rank of their ids."""
    from pyspark.sql import Window

    labelled = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    ranked = labelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "quality").orderBy("doc_id")))
    sides = ranked.groupBy("lang", "rank").agg(F.max(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("chosen_id"), F.max(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("rejected_id"))
    return sides.where("chosen_id is not null and rejected_id is not null")


def unit_dot(a, b):
    return dot(unit(a), unit(b))
