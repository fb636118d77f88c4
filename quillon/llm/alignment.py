"""Alignment of two tokenizers over the same texts.

Each Arrow partition cuts its texts into pieces at which both tokenizers always begin a token, encodes each distinct
piece once with either of them and hands DuckDB the interval tables of its tokens: (piece, place, id, first
byte, byte after the last).  Two ASOF joins find the first and the last B token that an A token meets, a range join
gives all links between, and window sums over common ends number the groups.  Joined to the pieces that each
document uses they give its links; a chunk's distinct id pairs, with the number of its documents that hold each, are partial counts that Spark merges over all chunks; the merged counts go back
to the chunks by a join, where they meet the links of each document.

A chunk is one row: its documents, its pairs and, compressed, which document holds which pair how often.  It is bounded
by CHUNK_BYTES of text, or one document.  No pair occurs in a chunk more than once, so a frequent pair has as many rows
as there are chunks.

A is byte-level BPE (``tokenizers``), B sentencepiece.  A vocabulary for which pieces are not known to be encoded as in
their text (another pre-tokenizer, or pieces with a space inside) gets whole texts instead.

Defined results: a text that is null or empty, or that the tokens' bytes of A or B do not give back, has no tokens: all
numbers are 0 and groups_sha256 is ''.  Special tokens' strings are plain text.  Repeated rows and rows that share an id
or have none are documents of their own.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import string
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, staged, tidy
from quillon.llm.tokens import joined, slices

#: Text of a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: What DuckDB may hold in a worker, and pieces whose alignment a worker keeps, unless one chunk has more.
DUCKDB_MEMORY, CACHE = "256MB", 450_000
#: Pieces that are encoded and joined at once.
STEP = 16_384

# The byte-level alphabet's printable bytes, and the mark that sentencepiece has for a space.
_PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
_SPACE_MARK = "▁"

#: Bytes that begin a character which is surely no white space.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = _SOLID[0xC3:0xE0] = _SOLID[0xE4:0xF5] = True

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True

_DOCUMENT = "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>"
CHUNK_SCHEMA = f"chunk long, documents array<{_DOCUMENT}>, pairs array<bigint>, n_docs array<bigint>, held binary"
RESULT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Bytes:
    """The bytes of each token id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.data[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _decimals(n: int) -> pa.Array:
    return pa.array([str(i) for i in range(n)], pa.large_string())


class ByteLevel:
    """Vocabulary A."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.load(open(path))
        split = spec["pre_tokenizer"] or {}
        self.by_pieces = spec["normalizer"] is None and split.get("type") == "ByteLevel" and bool(split.get("use_regex", True)) and not split.get("add_prefix_space")
        byte = {b: chr(b) for b in _PRINTABLE}
        byte |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in byte)}
        byte = {c: b for b, c in byte.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes, self.names = Bytes(tokens), _decimals(len(tokens))

    def encode(self, pieces: list[str]) -> list:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


class Pieces:
    """Vocabulary B; it puts the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        # A piece must never reach over a space into the next word, nor a text be changed beyond the space before it.
        inside = any(_SPACE_MARK in name.lstrip(_SPACE_MARK) for name in names)
        probe = " a  b\n  ﬁ"
        # No piece has one of these marks behind a letter, so none reaches from a word into the marks after it.
        self.marks = set(string.punctuation) - {n[k + 1] for n in names for k in range(len(n) - 1) if n[k].isascii() and n[k].isalpha()}
        self.line_end = self.model.encode("\n")
        if len(self.line_end) != 2 or not self.model.is_byte(self.line_end[1]):
            self.marks = set()
        self.by_pieces = not inside and "".join(self.model.encode("a  b ", out_type=str)) == _SPACE_MARK.join(["", "a", "", "b", ""])
        self.bytes = Bytes([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else n.replace(_SPACE_MARK, " ").encode() for i, n in enumerate(names)])
        self.names = _decimals(len(names))

    def encode(self, pieces: list[str]) -> list:
        # The space before a text is its own; a piece without one is put behind a line end, which joins nothing.
        found = self.model.encode([p[1:] if p.startswith(" ") else "\n" + p for p in pieces], num_threads=1)
        return [ids if p.startswith(" ") else ids[2:] for p, ids in zip(pieces, found)]


def _cut(texts: pa.Array, by_pieces: bool, marks: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts with a space before them in pieces, and where each text's pieces start.

    A piece begins at a single space between a character that is no space and one that is no white space, and between an
    ASCII letter and one of *marks* (by byte), where A's pre-tokenizer always cuts.
    """
    raw, starts = joined(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string())))
    first = starts[:-1]
    at = first
    if by_pieces and len(raw) > 2:
        begins = np.zeros(len(raw), bool)
        gap = raw == 32
        begins[1:-1] = gap[1:-1] & ~gap[:-2] & _SOLID[raw[2:]]  # a text begins with a space, so a gap's neighbours are of its own text
        begins[1:] |= _LETTER[raw[:-1]] & marks[raw[1:]]
        begins[first] = True
        at = np.flatnonzero(begins)
    pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    return pieces, np.searchsorted(at, starts)


def _intervals(vocabulary, pieces: list[str], raw: np.ndarray, sizes: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """(piece, place, id, s, e) of the tokens of all pieces, and which pieces the tokens spell."""
    found = vocabulary.encode(pieces)
    n = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter((i for x in found for i in x), np.int64, int(n.sum()))
    piece = np.repeat(np.arange(len(pieces)), n)
    size = vocabulary.bytes.size[ids]
    good = np.bincount(piece, size, len(pieces)).astype(np.int64) == sizes
    spelled, meant = vocabulary.bytes.spelled(ids[good[piece]]), raw[np.repeat(good, sizes)]
    wrong = np.repeat(np.flatnonzero(good), sizes[good])[spelled != meant]
    good[wrong] = False
    first = np.cumsum(n) - n
    ends = np.cumsum(size)
    before = np.concatenate([[0], ends])[first]
    e = ends - np.repeat(before, n)
    table = pa.table({"piece": piece, "place": np.arange(len(ids)) - np.repeat(first, n), "id": ids, "s": e - size, "e": e})
    return table.filter(pa.array(good[piece])), good


# Two ASOF joins, a range join and window sums over the interval tables a and b.
_LINKS = """
INSERT INTO pair
WITH lo AS (SELECT a.piece, a.place, a.id, a.e, b.place AS low FROM a ASOF JOIN b ON a.piece = b.piece AND a.s >= b.s),
hi AS (SELECT lo.*, b.place AS high FROM lo ASOF JOIN b ON lo.piece = b.piece AND lo.e > b.s)
SELECT hi.piece, (hi.id << 32) | b.id AS pair, count(*) AS n
FROM hi JOIN b ON b.piece = hi.piece AND b.place BETWEEN hi.low AND hi.high GROUP BY ALL"""
_GROUPS = """
SELECT piece, id, sum(shared) OVER (PARTITION BY piece ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - shared AS g
FROM (SELECT {own}.*, ({other}.e IS NOT NULL)::INT AS shared FROM {own} LEFT JOIN {other} ON {own}.piece = {other}.piece AND {own}.e = {other}.e)
ORDER BY piece, place"""
_HELD = "SELECT doc, pair, sum(used.n * pair.n)::BIGINT AS n FROM used JOIN pair USING (piece) GROUP BY doc, pair ORDER BY doc, pair"


def _joined_runs(values: pa.Array, first: np.ndarray, mark: str) -> pa.Array:
    """Runs of *values*, each from one of *first* to the next, as one string each with *mark* between."""
    runs = pa.LargeListArray.from_arrays(pa.array(np.append(first, len(values)).astype(np.int64)), values)
    return pc.binary_join(runs, pa.scalar(mark, pa.large_string()))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Aligner:
    """A worker's aligned pieces: each distinct piece goes through both tokenizers and DuckDB's joins once.

    The tables in memory start anew when they would hold more than CACHE pieces; DuckDB's scratch is a folder of the
    worker, for a document too long for DUCKDB_MEMORY.
    """

    def __init__(self, paths: tuple[str, str]):
        import duckdb

        self.a, self.b = ByteLevel(paths[0]), Pieces(paths[1])
        self.by_pieces = self.a.by_pieces and self.b.by_pieces
        self.marks = np.zeros(256, bool)
        self.marks[[ord(c) for c in self.b.marks]] = True
        self.scratch = tempfile.TemporaryDirectory(prefix="alignment-")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": self.scratch.name})
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.good, self.numbers, self.spelled = np.zeros(0, bool), np.zeros((3, 0), np.int64), pa.array([], pa.large_string())
        self.con.execute("CREATE OR REPLACE TABLE pair (piece BIGINT, pair BIGINT, n BIGINT)")

    def places(self, distinct: pa.Array) -> np.ndarray:
        """The place in the tables of each of *distinct*, after those not known yet have been aligned."""
        pieces = distinct.to_pylist()
        new = np.fromiter((p not in self.known for p in pieces), bool, len(pieces))
        if len(self.known) + int(new.sum()) > CACHE and self.known:
            self._forget()
            new[:] = True
        unknown = distinct.filter(pa.array(new))
        for at in range(0, len(unknown), STEP):
            self._learn(unknown.slice(at, STEP))
        return np.fromiter((self.known[p] for p in pieces), np.int64, len(pieces))

    def _learn(self, distinct: pa.Array) -> None:
        raw, offsets = joined(distinct)
        pieces, sizes, base = distinct.to_pylist(), np.diff(offsets), len(self.known)
        (table_a, good_a), (table_b, good_b) = (_intervals(v, pieces, raw, sizes) for v in (self.a, self.b))
        good = good_a & good_b
        for name, table in (("a", table_a), ("b", table_b)):
            table = table.filter(pa.array(good[table["piece"].to_numpy()]))
            self.con.register(name, table.set_column(0, "piece", pc.add(table["piece"], base)))
        self.con.execute(_LINKS)
        numbers, sides = np.zeros((3, len(pieces)), np.int64), []
        for k, (own, other, names) in enumerate((("a", "b", self.a.names), ("b", "a", self.b.names))):
            got = self.con.sql(_GROUPS.format(own=own, other=other)).fetchnumpy()
            piece = np.asarray(got["piece"], np.int64) - base
            first = _changes(piece, np.asarray(got["g"], np.int64))
            numbers[k] = np.bincount(piece, minlength=len(pieces))
            sides.append(_joined_runs(names.take(pa.array(got["id"])), first, ","))
            of = piece[first]  # the groups' pieces, the same on both sides
        numbers[2] = np.bincount(of, minlength=len(pieces))
        spelled = _joined_runs(pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), np.cumsum(numbers[2]) - numbers[2], ";")
        self.con.unregister("a")
        self.con.unregister("b")
        self.good, self.numbers = np.concatenate([self.good, good]), np.hstack([self.numbers, numbers])
        self.spelled = pa.concat_arrays([self.spelled, spelled])
        self.known.update(zip(pieces, range(base, base + len(pieces))))

    def align(self, doc_ids: pa.Array, texts: pa.Array) -> tuple:
        """(documents, pairs, documents that hold each, which document holds which pair how often)."""
        n_docs = len(texts)
        cut, starts = _cut(texts, self.by_pieces, self.marks)
        coded = cut.dictionary_encode()
        place = self.places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(cut) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(n_docs), np.diff(starts))
        whole = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0
        whole[doc[~self.good[place]]] = False
        kept = whole[doc]
        doc, place = doc[kept], place[kept]
        n_a, n_b, n_groups = (np.bincount(doc, n[place], n_docs).astype(np.int64) for n in self.numbers)
        n_pieces = np.bincount(doc, minlength=n_docs)
        lines = _joined_runs(self.spelled.take(pa.array(place)), np.cumsum(n_pieces) - n_pieces, ";")
        sha = [hashlib.sha256(line.as_buffer()).hexdigest() if w else "" for line, w in zip(lines, whole)]

        use, times = np.unique(doc * (len(self.known) + 1) + place, return_counts=True)
        self.con.register("used", pa.table({"doc": use // (len(self.known) + 1), "piece": use % (len(self.known) + 1), "n": times}))
        held = self.con.sql(_HELD).fetchnumpy()
        self.con.unregister("used")
        doc, times = np.asarray(held["doc"], np.int64), np.asarray(held["n"], np.int64)
        pairs, at, holders = np.unique(np.asarray(held["pair"], np.int64), return_inverse=True, return_counts=True)
        n_links = np.bincount(doc, times, n_docs).astype(np.int64)
        columns = [doc_ids, *map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(sha, pa.string())]
        documents = pa.StructArray.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        per = np.bincount(doc, minlength=n_docs)
        image = b"".join([np.array([n_docs, len(doc)], "<i8").tobytes(), per.astype("<i4").tobytes(), at.astype("<i4").tobytes(), times.astype("<i8").tobytes()])
        return documents, pairs, holders, len(image).to_bytes(8, "little") + pa.compress(image, codec="zstd", asbytes=True)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """This worker's aligner for the vocabularies at *paths*."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(paths)
    return _ALIGNERS[paths]


def chunks(docs: DataFrame, vocabularies: tuple[str, str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """*docs* (doc_id, text) as rows of CHUNK_SCHEMA."""
    paths = vocabularies or default_vocabularies()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in _gathered(batches, chunk_bytes):
            ids, texts = batch.column("doc_id"), batch.column("text")
            for low, high in slices(texts, chunk_bytes):
                documents, pairs, holders, held = aligner(paths).align(ids.slice(low, high - low), texts.slice(low, high - low))
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                columns = [pa.array([(task << 32) + k]), one(documents), one(pa.array(pairs)), one(pa.array(holders.astype(np.int64))), pa.array([held], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "documents", "pairs", "n_docs", "held"])
                k += 1
                tidy()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.transform(map_arrow, rows, CHUNK_SCHEMA)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about *most* bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def pair_counts(found: DataFrame) -> DataFrame:
    """The chunks' partial counts merged: pair, n (documents that hold it), best (whether no pair of its A id has more)."""
    partial = found.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select("p.*")
    merged = partial.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return merged.select("pair", "n", (F.col("n") == most).alias("best"))


def align(docs: DataFrame, vocabularies: tuple[str, str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row of RESULT_SCHEMA for each row of *docs*."""
    found = staged(chunks(docs, vocabularies, chunk_bytes), "alignment")
    counts = pair_counts(found)
    wanted = found.select("chunk", F.explode("pairs").alias("pair"))
    back = wanted.join(counts, "pair").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("c"))
    back = back.select("chunk", F.col("c.n").alias("n"), F.col("c.best").alias("best"))  # in the order of the chunk's pairs
    met = found.select("chunk", "documents", "held").join(back, "chunk", "left").select("documents", "held", "n", "best")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                documents, n, best = (batch.column(c).slice(k, 1).flatten() for c in ("documents", "n", "best"))
                image = batch.column("held")[k].as_buffer()
                image = pa.decompress(image[8:], int.from_bytes(image[:8].to_pybytes(), "little"), codec="zstd")
                n_docs, links = np.frombuffer(image, "<i8", 2)
                doc = np.repeat(np.arange(n_docs), np.frombuffer(image, "<i4", n_docs, 16))
                place, times = np.frombuffer(image, "<i4", links, 16 + 4 * n_docs), np.frombuffer(image, "<i8", links, 16 + 4 * (n_docs + links))
                count, is_best = n.to_numpy(zero_copy_only=False), best.to_numpy(zero_copy_only=False)
                n_best, total = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
                if links:
                    np.add.at(n_best, doc, times * is_best[place])
                    np.add.at(total, doc, times * count[place])
                parts = documents.flatten()
                yield pa.RecordBatch.from_arrays([*parts[:5], pa.array(n_best), pa.array(total), parts[5]], names=[c.split()[0] for c in RESULT_SCHEMA.split(", ")])

    return met.transform(map_arrow, rows, RESULT_SCHEMA)
