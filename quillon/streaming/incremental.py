"""Incremental processing on Structured Streaming.

The file source's checkpoint is the progress record: a batch counts as done only after its sink has committed, and a
run that starts again goes on at the first batch that is not.  Each batch replaces its own partition of the sink, so a
batch that runs twice leaves its rows once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators import dense


def pending(work: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    """what is not done yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def run_incrementally(
    spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 200
) -> int:
    """All files of *source* that no earlier run has finished, through *transform* into *sink*; batches run."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    seen = []

    def flush(batch: DataFrame, number: int) -> None:
        seen.append(number)
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    query = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(seen)


def accumulate(spark: SparkSession, source: str, schema, key: str, v: str, dim: int, sink: str, checkpoint: str, files_per_batch: int = 50) -> DataFrame:
    """Sums and counts of vectors by key, as partial states by batch that merge when read.

    Returns the merged table (key, n, sum); dividing gives the mean so far.
    """

    def partial(batch: DataFrame) -> DataFrame:
        return batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get(F.col(v), F.lit(i))) for i in range(dim)]).alias("sum"))

    run_incrementally(spark, source, schema, partial, sink, checkpoint, files_per_batch)
    return merged(spark.read.parquet(sink), key, dim)


def accumulate_state(
    spark: SparkSession, source: str, schema, key: str, v: str, weights: dict[str, Column], layout: list[tuple[str, int]], sink: str, checkpoint: str, files_per_batch: int = 50
) -> DataFrame:
    """Sums of vectors by key under several weightings, kept in the state store of a streaming query that resumes.

    Tasks fold a batch's vectors to dense partial sums first, so one row a task and group reaches its state, however many rows
    share the group.  The state of a group and block is its count and its sums; each batch sends the groups that it has changed.
    *layout*, the names and sizes of a vector's parts, is kept beside the progress: where it differs from the one found there,
    nothing before fits and the run starts over.  Returns (key, offset, n, a sum for each weighting) of all files so far.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    kept = f"{checkpoint.rstrip('/')}-layout"
    same, dim = [tuple(x) for x in layout], sum(n for _, n in layout)
    if hadoop(kept).getFileSystem(conf).exists(hadoop(kept)):
        if sorted((r["name"], r["numel"], r["i"]) for r in spark.read.json(kept, "i long, name string, numel long").collect()) != sorted((n, m, i) for i, (n, m) in enumerate(same)):
            for path in (checkpoint, sink, kept):
                hadoop(path).getFileSystem(conf).delete(hadoop(path), True)
    if not hadoop(kept).getFileSystem(conf).exists(hadoop(kept)):
        spark.createDataFrame([(i, n, m) for i, (n, m) in enumerate(same)], "i long, name string, numel long").write.json(kept)

    names = list(weights)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    fits = F.when(F.size(v) != dim, F.raise_error(F.lit(f"a vector is not {dim} long"))).otherwise(F.col(v))
    parts = dense.states(stream.withColumn(v, fits), v, key, weights=weights)
    out = dense.schema_of(parts, (key,), names)
    held = "n long, " + ", ".join(f"`{name}` array<double>" for name in names)

    def add(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, *total = state.get if state.exists else (0, *[None] * len(names))
        for frame in frames:
            n += int(frame["n"].sum())
            for i, name in enumerate(names):
                new = np.sum(np.stack(frame[name].to_list()), axis=0)
                total[i] = new if total[i] is None else np.asarray(total[i]) + new
        lists = [np.asarray(x).tolist() for x in total]
        state.update((n, *lists))
        yield pd.DataFrame({key: [group[0]], "offset": [group[1]], "n": [n], **{name: [x] for name, x in zip(names, lists)}})

    changed = parts.groupBy(key, "offset").applyInPandasWithState(add, out, held, "update", GroupStateTimeout.NoTimeout)

    def flush(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    changed.writeStream.foreachBatch(flush).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    columns = [c for c in changed.columns if c not in (key, "offset")]
    latest = F.max_by(F.struct(*columns), "batch").alias("_s")
    return spark.read.parquet(sink).groupBy(key, "offset").agg(latest).select(key, "offset", "_s.*")


def merged(states: DataFrame, key: str, dim: int) -> DataFrame:
    return states.groupBy(key).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sum", F.lit(i))) for i in range(dim)]).alias("sum"))


def windowed_counts(events: DataFrame, ts: str, *keys: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; on a stream, windows close when the watermark has passed them."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", *keys, "n", "total")
