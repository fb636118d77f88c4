import zlib
from collections import Counter

from quillon.llm import sharding
from tests.llm.fixtures import MORE, SCHEMA, empty, rows, table


def check(data, got):
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} <= {"rows"} and {r["grown_shard"] for r in got} <= {None}
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts.get(k, 0) for k in range(8)) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))


def test_law_and_slots(spark):
    check(rows(), sharding.assign_shards(table(spark)).collect())
    assert sharding.assign_shards(empty(spark)).collect() == []


def test_repeated_rows_and_reruns(spark):
    data = [(k % 50, "same", "en", "s", 0, *MORE) for k in range(3000)]
    df = spark.createDataFrame(data, SCHEMA)
    got = sharding.assign_shards(df).collect()
    check(data, got)
    assert sorted(map(str, got)) == sorted(map(str, sharding.assign_shards(df).collect()))


def test_order_is_shuffled(spark):
    data = [(k, str(k), "en", "s", 0, *MORE) for k in range(2000)]
    got = sharding.assign_shards(spark.createDataFrame(data, SCHEMA)).collect()
    place = {r["doc_id"]: r["slot"] * 8 + r["shard"] for r in got}
    rising = sum(place[k] < place[k + 1] for k in range(1999))
    assert 850 < rising < 1150


def test_written_shards(spark, tmp_path):
    sharding.write_shards(table(spark), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r[0], r[1]) for r in rows())
    assert {"bucket", "size", "key", "shard", "slot"} <= set(back[0].asDict())


def test_no_row_is_lost(spark, tmp_path):
    data = [(1, "same", "x"), (1, "same", "y"), (None, "t", "a"), (None, "t", "b"), (2, None, None), (2, "", None)]
    data += [(7, "hot", str(k)) for k in range(500)]
    sharding.write_shards(spark.createDataFrame(data, "doc_id long, text string, tag string"), str(tmp_path / "s"), bucket_bytes=200)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert Counter((r["doc_id"], r["text"], r["tag"]) for r in back) == Counter(data)
    for shard in {r["shard"] for r in back}:
        slots = sorted(r["slot"] for r in back if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_against_a_plain_two_pass_shuffle(spark):
    """The buckets are those of the hash, and each is in the order Spark's shuffle gives it by itself."""
    from pyspark.sql import functions as F

    data = [(k, "t" * (k % 50), "en", "s", 0, *MORE) for k in range(900)]
    df = spark.createDataFrame(data, SCHEMA).select("doc_id", "text").coalesce(1)
    got = sharding.shuffled_buckets(df, bucket_bytes=4000).collect()
    n = -(-sum(len(r[1]) + 1 for r in data) // 4000)
    order = F.struct(F.col("doc_id").alias("id"), (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("place"))
    bucket = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(sharding.SEED), order), F.lit(n))).collect()}
    members = {}
    for r in got:
        assert bucket[r["record"]["doc_id"]] == r["bucket"]
        members.setdefault(r["bucket"], {})[r["pos"]] = r["record"]["doc_id"]
    assert sum(map(len, members.values())) == 900
    moved = 0
    for b, places in members.items():
        assert sorted(places) == list(range(len(places)))
        moved += sum(x != y for x, y in zip((places[k] for k in sorted(places)), sorted(places.values())))
    assert moved > 800
