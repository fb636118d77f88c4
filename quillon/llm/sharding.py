"""Two-pass external shuffle into shards (native).

Pass one scatters whole records uniformly into buckets of bounded memory by a seeded hash of the record and its place
in the input.  Pass two reads each bucket as one partition, puts it in a fixed order, shuffles it with Spark's
``shuffle`` function, a Fisher-Yates shuffle seeded by the seed and the bucket's number, and writes it.  Buckets laid
end to end are one random permutation of all records; equal stretches of it are the shards: the law is ``rows`` (counts
at most one apart).  A record's slot follows from its bucket's first place and its own place in the bucket.

Defined results: a null text counts as no bytes (size 1, crc32 0); every row, repeated rows and null ids included, is a
record of its own, in all its columns; an empty table gives an empty result; columns that clash with the result's are
ignored by :func:`assign_shards` and kept by :func:`write_shards`.  Equal texts form no groups here: the law ``rows``
could not hold if a group of copies larger than a shard had to stay together.  The same files read in the same parts
give the same shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import prefix_sums, staged, text_or_empty

SEED = 1729
N_SHARDS = 8
#: Text to a bucket, on average; a bucket's records must fit in a task.
BUCKET_BYTES = 16 << 20


def _size() -> Column:
    return F.octet_length(text_or_empty()).cast("long") + 1


def _crc() -> Column:
    return F.crc32(text_or_empty().cast("binary"))


def shuffled_buckets(df: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Both passes: a row (bucket, pos, record) for each row of *df*, written bucket by bucket in shuffled order."""
    total, n = df.agg(F.coalesce(F.sum(_size()), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = max(1, -(-total // bucket_bytes))
    ids = F.col("doc_id").cast("long")
    order = F.struct(ids.alias("id"), _size().alias("size"), _crc().alias("crc"), F.monotonically_increasing_id().alias("place"))
    rows = df.select(order.alias("o"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "o"), F.lit(n_buckets)).cast("int"))
    # A bucket is a partition of its own, so the generator of its shuffle starts from the seed and the bucket's number.
    dealt = rows.repartitionById(n_buckets, "bucket")
    gathered = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("o", "record"))).alias("records"))
    gathered = gathered.select("bucket", F.transform("records", lambda r: r["record"]).alias("records"))
    shuffled = gathered.select("bucket", F.posexplode(F.shuffle("records", seed)).alias("pos", "record"))
    return staged(shuffled, "shard-buckets")


def _placed(buckets: DataFrame, n_shards: int) -> tuple[DataFrame, Column, Column]:
    """*buckets* with the first place of each row's bucket, and columns of its shard and slot."""
    n = buckets.count()
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = prefix_sums(sizes, [], "bucket", "n", "first").select("bucket", "first")
    place = F.col("first") + F.col("pos")
    # Shard s holds the places from floor(s * n / n_shards) on.
    shard = F.floor((F.lit(n_shards).cast("long") * (place + 1) - 1) / F.lit(max(n, 1)))
    slot = place - F.floor(shard * n / F.lit(n_shards))
    return buckets.join(starts, "bucket"), shard.cast("int"), slot.cast("long")


def assign_shards(df: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row per document, from the records as written: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    buckets = shuffled_buckets(df.select("doc_id", "text"), seed, bucket_bytes)
    written = buckets.select("bucket", "pos", "record.doc_id", "record.text")
    digests = written.select("bucket", "pos", F.col("doc_id").cast("long").alias("doc_id"), _size().alias("size"), _crc().alias("text_crc32"))
    rows, shard, slot = _placed(digests, n_shards)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(df: DataFrame, path: str, n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write every row of *df*, all columns, as Parquet under ``path/shard=i``, each file a run of rising slots.

    Columns of *df* that are called shard or slot are written as shard_in and slot_in.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c.lower() in ("shard", "slot")})
    buckets = shuffled_buckets(df, seed, bucket_bytes)
    rows, shard, slot = _placed(buckets, n_shards)
    rows = rows.select(*[F.col("record").getField(c).alias(c) for c in df.columns], shard.alias("shard"), slot.alias("slot"))
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
