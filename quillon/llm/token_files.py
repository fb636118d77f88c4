"""Token-id files as directly addressable codes.

An id is cut into chunks of 8 bits, lowest first.  Level k holds the k-th chunk of every id that has one, a bitmap
that tells which of them continue at the next level, and a rank directory with the number of continuing ids before
each run of 512.  An id is read by following its position from level to level with one rank each, without decoding
any block.  A file image holds a run of whole documents with their ids, lengths and codes::

    "QDAC" version:u32 documents:u64 ids:u64 levels:u64
    doc_id:i64[documents] (null: the least i64) start:u64[documents + 1]
    per level: n:u64 chunks:u8[n] bitmap:u8[ceil(n/8)] directory:u64[ceil(n/512)]

The images are rows of Parquet files (part, block, first_doc, n_docs, n_ids, image) in ascending document order, so
that any store Spark can write holds them.

Defined results: a null text has no ids but the end id; null document ids come first; rows with equal ids follow each
other by text, and are dealt out by its first
characters where they are many; an empty table makes no image and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, stage_path, text_or_empty
from quillon.llm.tokens import default_vocabulary, documents_ids

END_ID = 2
#: Characters of a text that decide about its range among rows of one id; in order, as the whole texts are.
RANGE_CHARS = 64
#: A file image is closed at the first document end after so many ids.
BLOCK_IDS = 1 << 20
RANK_STEP = 512
#: What a document without an id has in its place; how many there are says the head of an image, as they come first.
NULL_ID = -(1 << 63)
_HEAD = "<4sIQQQQ"

BLOCKS = "part long, block long, first_doc long, n_docs long, n_ids long, image binary"
ROWS = "part long, block long, doc_id long, local long, n_tokens long, ids_crc32 long"
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint64)


def encode_levels(ids: np.ndarray) -> list[bytes]:
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bitmap = np.packbits(more)
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(_BITS[bitmap], np.arange(0, len(bitmap), RANK_STEP // 8)))]) if len(bitmap) else np.zeros(1)
        directory = ones[: -(-len(rest) // RANK_STEP)].astype("<u8")
        out.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return out


def encode_image(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, n_null: int = 0) -> bytes:
    """An image of documents in order, the first *n_null* of which have no id."""
    levels = encode_levels(ids)
    head = struct.pack(_HEAD, b"QDAC", 2, len(doc_ids), n_null, len(ids), len(levels))
    return head + doc_ids.astype("<i8").tobytes() + starts.astype("<u8").tobytes() + b"".join(levels)


class TokenImage:
    """A file image: random access to ids, and whole documents."""

    def __init__(self, image: bytes):
        magic, version, n_docs, self.n_null, self.n_ids, n_levels = struct.unpack_from(_HEAD, image)
        if magic != b"QDAC" or version != 2:
            raise ValueError("not a token-id image")
        at = struct.calcsize(_HEAD)
        self.doc_ids = np.frombuffer(image, "<i8", n_docs, at)
        self.starts = np.frombuffer(image, "<u8", n_docs + 1, at + 8 * n_docs).astype(np.int64)
        at += 8 * (2 * n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", image, at)
            chunks = np.frombuffer(image, np.uint8, n, at + 8)
            bitmap = np.frombuffer(image, np.uint8, -(-n // 8), at + 8 + n)
            directory = np.frombuffer(image, "<u8", -(-n // RANK_STEP), at + 8 + n + len(bitmap))
            self.levels.append((chunks, bitmap, directory))
            at += 8 + n + len(bitmap) + 8 * len(directory)

    def __getitem__(self, i: int) -> int:
        """The id at place *i*, by one rank a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> (7 - bit) & 1:
                break
            first = i // RANK_STEP * (RANK_STEP // 8)
            i = int(directory[i // RANK_STEP]) + int(_BITS[bitmap[first:byte]].sum()) + int(_BITS[bitmap[byte] >> (8 - bit)] if bit else 0)
            shift += 8
        return value

    def ids(self) -> np.ndarray:
        out, at = np.zeros(self.n_ids, np.uint32), np.arange(self.n_ids)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bitmap, count=len(chunks)).astype(bool)]
        return out

    def document(self, k: int) -> list[int]:
        return [self[i] for i in range(self.starts[k], self.starts[k + 1])]


def write_token_files(df: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the ids, each document closed by *end_id*, in ascending doc_id order."""
    vocabulary = vocabulary or default_vocabulary()
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.repartitionByRange(n, "doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, lens, held, size, n_null = [], [], [], 0, 0

        def image() -> pa.RecordBatch:
            d, starts = np.concatenate(doc_ids), np.concatenate([[0], np.cumsum(np.concatenate(lens))])
            row = [part, block, int(d[0]), len(d), size, encode_image(d, starts, np.concatenate(held), n_null)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 5 + [pa.binary()])], names=BLOCKS.replace(",", "").split()[::2])

        for rows, ids, ends in documents_ids(batches, vocabulary, end_id):
            key = rows.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            known = rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            at = 0
            while at < len(key):
                end = min(len(key), max(at + 1, int(np.searchsorted(ends, ends[at] + block_ids - size, "left"))))
                doc_ids.append(key[at:end])
                n_null += int((~known[at:end]).sum())
                lens.append(np.diff(ends[at : end + 1]))
                held.append(ids[ends[at] : ends[end]])
                size += int(ends[end] - ends[at])
                at = end
                if size >= block_ids:
                    yield image()
                    doc_ids, lens, held, size, n_null, block = [], [], [], 0, 0, block + 1
        if doc_ids:
            yield image()

    docs.transform(map_arrow, blocks, BLOCKS).write.parquet(path)


def read_token_files(df: DataFrame) -> DataFrame:
    """A row per document of the images in *df*: doc_id, start, n_tokens, ids_crc32, read back from the codes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "image"))):
                image = TokenImage(raw)
                data, s = image.ids().astype("<u4").tobytes(), image.starts
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(s[:-1].tolist(), s[1:].tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), pa.array(np.full(n, block)), pa.array(image.doc_ids, mask=np.arange(n) < image.n_null), pa.array(s[:-1]), pa.array(np.diff(s)), pa.array(crc, pa.int64())],
                    names=ROWS.replace(",", "").split()[::2],
                )

    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = df.select("part", "block", "n_ids")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("_part"))
    firsts = blocks.withColumn("_block", before(Window.partitionBy("part").orderBy("block"))).join(parts, "part").select("part", "block", (F.col("_part") + F.col("_block")).alias("_first"))
    found = df.select("part", "block", "image").transform(map_arrow, rows, ROWS)
    return found.join(firsts, ["part", "block"]).select("doc_id", (F.col("_first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the files of *df* in the shared folder and read them back."""
    path = stage_path(df.sparkSession, "token-files")
    write_token_files(df, path, vocabulary)
    return read_token_files(df.sparkSession.read.schema(BLOCKS).parquet(path))
