"""Best-fit packing planned on the histogram of lengths.

Documents become ids closed by an end id; only documents longer than a sequence are cut.  The plan is best-fit
decreasing over counts: the driver holds how many pieces there are of each length (at most ``capacity`` numbers) and
runs of sequences that are filled alike; all pieces of a length go to the fullest runs that still have room.  The
plan says, for each length, which ranks take which sequences at which place, and pieces take their slots by a join on
their rank within their length.

Ranks are counted in slices of each length by a stored random salt, as many as the pieces call for, so that one
frequent length is no single task.

Defined results: a null or empty text is one piece with the end id alone; rows that repeat are packed one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, staged, text_or_empty
from quillon.llm.tokens import default_vocabulary, documents_ids

CAPACITY = 2048
END_ID = 0
#: Salts that pieces draw from; a slice is a range of them that holds about so many pieces, were they all of one length.
SALTS, SLICE_PIECES = 1 << 20, 2000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def cut_pieces(df: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; with *with_ids*, also their ids."""
    vocabulary = vocabulary or default_vocabulary()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.random.default_rng(TaskContext.get().partitionId())
        for rows, ids, ends in documents_ids(batches, vocabulary, end_id):
            n = np.diff(ends)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            first = ends[row] + start
            data = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
            out = [rows.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            out.append(pa.array(salts.integers(0, SALTS, len(row)).astype(np.int32)))
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return docs.transform(map_arrow, pieces, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, offset): rank r takes sequence first + r - first rank.

    Runs of sequences with equal room are kept by room; the lengths go down, and each takes the smallest room that
    fits, splitting a run that is longer than needed.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"no sequence holds {length}")
        for space in sorted(s for s in room if s >= length):
            while left and space >= length and room.get(space):
                first, n = room[space].pop()
                k = min(n, left)
                if k < n:
                    room[space].append((first + k, n - k))
                fill = min(space // length, -(-left // k))
                at = space
                for _ in range(fill):  # a run takes as many of this length as fit before the next room is looked at
                    m = min(k, left)
                    slots.append((length, rank, rank + m, first, capacity - at))
                    if m < k:
                        room.setdefault(at, []).append((first + m, k - m))
                        k = m
                    rank, left, at = rank + m, left - m, at - length
                if at:
                    room.setdefault(at, []).append((first, k))
        per = capacity // length
        for n, copies in ((left // per, per), (1, left % per)):
            if n and copies:
                slots += [(length, rank + j * n, rank + (j + 1) * n, sequences, j * length) for j in range(copies)]
                if capacity - copies * length:
                    room.setdefault(capacity - copies * length, []).append((sequences, n))
                rank, sequences = rank + n * copies, sequences + n
        room = {s: runs for s, runs in room.items() if runs}
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """*pieces* (as :func:`cut_pieces` gives them) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = staged(pieces, "pack-pieces")
    n_slices = min(SALTS, max(1, pieces.count() // SLICE_PIECES))
    pieces = pieces.withColumn("salt", F.floor(F.col("salt").cast("long") * n_slices / SALTS))
    slices = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    slices = staged(slices, "pack-slices")
    counts = {r["length"]: r["n"] for r in slices.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity), "length long, r0 long, r1 long, first long, offset long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = slices.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(bases.hint("merge"), ["length", "salt"])
    rank = F.col("base") + F.col("rank")
    # There are at most a few slots to a length and capacity lengths, whatever the input.
    taken = ranked.withColumn("rank", rank).join(F.broadcast(slots), "length").where("rank >= r0 and rank < r1")
    return taken.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("r0")).drop("salt", "base", "rank", "r0", "r1", "first")


def pack_documents(df: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    packed = pack(cut_pieces(df, vocabulary, capacity, end_id, with_ids), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
