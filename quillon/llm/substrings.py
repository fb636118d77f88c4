"""Suffix-array dedup: bytes covered by a string of 50 bytes that also starts in an earlier document.

The strings are found from sorted suffixes.  Suffixes of all documents are not sorted in one place; they are dealt out
by content:

1. Every window of 50 bytes has a minimizer, the least hash among its 24-byte strings.  Neighbouring windows with one
   minimizer are a segment.  Equal windows have equal minimizers, so only minimizers that occur in two documents
   matter; they are counted in hash buckets and the shared ones told to their documents.
2. The documents give out their segments with shared minimizers, and each bucket of minimizers builds the
   Burrows-Wheeler transform and common prefixes of its segments column-wise: every round inserts the next symbol of
   each segment, from its end to its start, at the place the transform's ranks give, and the columns (symbol before,
   common prefix with the row above, segment, offset) are rewritten in sequence from one spooled file to the next.
   Segments are at most ``WINDOWS + 49`` bytes long, so there are as many rounds, whatever the input.
3. Rows with common prefixes of 50 or more are one string; where its least document is smaller than a row's own, the
   window is removed.  The windows go back to their documents, whose covered bytes are cut out.

Equal texts are one text, whose windows are those of its first document; the others are removed whole.  Equal segments are met by their least document alone, first within a task and then within a bucket, and the others are
removed at once, so that a group of copies or a common passage costs a row a task.

Defined results: a null text is empty; null ids come after all others; rows with equal ids are not earlier than each
other; texts shorter than 50 bytes lose nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, release, staged, text_or_empty
from quillon.llm.hashing import distinct, mix
from quillon.llm.tokens import joined, slices

LENGTH = 50
KMER = 24
#: k-mers, and so windows of one segment at most.
WINDOWS = LENGTH - KMER + 1
SLICE = 1 << 20
#: Segments whose transform is built at once; a bucket of minimizers is cut between minimizers.
BATCH = 4096
#: Columns beyond so many bytes are spooled to a file.
SPOOL = 32 << 20
BUCKET_BYTES = 64 << 20
LAST_ID = (1 << 63) - 1

#: The low 48 bits of a minimizer, in three parts, and a document's hash.
KEY = np.dtype([("k0", "<u2"), ("k1", "<u2"), ("k2", "<u2")])
ANCHOR = np.dtype([*((k, KEY[k]) for k in KEY.names), ("hash", "<i8")])
SEGMENT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("hash", "<i8"), ("start", "<u4"), ("size", "u1")])
MARK = np.dtype([("hash", "<i8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])
SPAN = np.dtype([(k, MARK[k]) for k in ("doc", "start", "n")])
LOW = np.uint64((1 << 48) - 1)


def minimizers(raw: np.ndarray) -> np.ndarray:
    """The minimizer of every window of *raw*, which has at least LENGTH bytes."""
    n = len(raw) - KMER + 1
    word = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw.tobytes(), strides=(1,))
    h = mix(word[:n] * np.uint64(0x9E3779B97F4A7C15) + word[8 : 8 + n])
    h += word[16 : 16 + n]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    width = 1
    while width * 2 <= WINDOWS:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = WINDOWS - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class Segments:
    """Runs of windows of equal minimizer in texts laid end to end, none longer than WINDOWS."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        if len(raw) < LENGTH:
            self.start = self.n = self.own = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        key = minimizers(raw)
        size = np.diff(offsets)
        inside = np.zeros(len(raw) + 1, np.int64)  # windows that lie in one text
        some = size >= LENGTH
        np.add.at(inside, offsets[:-1][some], 1)
        np.add.at(inside, offsets[1:][some] - LENGTH + 1, -1)
        good = np.cumsum(inside)[: len(key)] > 0
        first = good.copy()
        first[1:] &= (key[1:] != key[:-1]) | ~good[:-1]
        text_start = offsets[:-1][some]
        first[text_start] = True
        start = np.flatnonzero(first)
        stop = np.append(start[1:], len(key))
        bad = np.append(np.flatnonzero(~good), len(key))
        stop = np.minimum(stop, bad[np.searchsorted(bad, start)])
        parts = -(-(stop - start) // WINDOWS)
        each = np.repeat(np.arange(len(start)), parts)
        part = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = start[each] + part * WINDOWS
        self.n = np.minimum(stop[each] - self.start, WINDOWS)
        self.key = mix(key[self.start]) & LOW  # as good as the minimizer to tell segments apart, and spread evenly
        self.own = np.searchsorted(offsets, self.start, "right") - 1


def _dealt(rows: np.ndarray, bucket: np.ndarray, more: list[bytes] | None = None) -> pa.RecordBatch:
    """Rows sorted by bucket, as (bucket, rows of it); *more* holds bytes that go with each row."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rows) else np.zeros(0, np.int64)
    ends = [*cut[1:].tolist(), len(rows)]
    blobs = [rows[a:b].tobytes() for a, b in zip(cut.tolist(), ends)]
    out = [pa.array(bucket[cut].astype(np.int64)), pa.array(blobs, pa.binary())]
    if more is not None:
        more = [more[k] for k in order.tolist()]
        out.append(pa.array([b"".join(more[a:b]) for a, b in zip(cut.tolist(), ends)], pa.binary()))
        return pa.RecordBatch.from_arrays(out, names=["bucket", "rows", "bytes"])
    return pa.RecordBatch.from_arrays(out, names=["bucket", "rows"])


def _anchors(buckets: int):
    """Rows (bucket, anchors): the minimizers of each document, once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            hashes = batch.column("hash").to_numpy()
            for a, b in slices(texts, 2 * SLICE):
                s = Segments(*joined(texts.slice(a, b - a)))
                key, own = distinct(s.key, s.own)
                yield _dealt(_anchor_rows(key, hashes[own + a]), key.astype(np.int64) % buckets)

    return emit


def _anchor_rows(key: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    rows = np.zeros(len(key), ANCHOR)
    rows["k0"], rows["k1"], rows["k2"] = key & np.uint64(0xFFFF), key >> np.uint64(16) & np.uint64(0xFFFF), key >> np.uint64(32)
    rows["hash"] = hashes
    return rows


def _keys(rows: np.ndarray) -> np.ndarray:
    return rows["k0"] | rows["k1"].astype(np.uint64) << np.uint64(16) | rows["k2"].astype(np.uint64) << np.uint64(32)


def _by_bucket(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list]]:
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, *values in zip(batch.column("bucket").to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
            held.setdefault(bucket, []).append(values)
    while held:
        bucket, values = held.popitem()
        yield bucket, [list(x) for x in zip(*values)]


def _home(hashes: np.ndarray, homes: int) -> np.ndarray:
    return (mix(hashes.view(np.uint64)) % np.uint64(homes)).astype(np.int64)


def _shared(homes: int):
    """Minimizers of two documents or more, told to the homes of these documents."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (blobs,) in _by_bucket(batches, "rows"):
            rows = np.frombuffer(b"".join(blobs), ANCHOR)
            key = _keys(rows)
            order = np.argsort(key, kind="stable")
            key, rows = key[order], rows[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.maximum.reduceat(rows["hash"], start) != np.minimum.reduceat(rows["hash"], start)
            rows = rows[np.repeat(many, np.diff(np.append(start, len(key))))]
            if len(rows):
                yield _dealt(rows, _home(rows["hash"], homes))

    return tell


def _by_document(kind: np.dtype, told: np.dtype):
    """The rows of a home by document: (hash, rows with the fields of *told*)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (blobs,) in _by_bucket(batches, "rows"):
            rows = np.frombuffer(b"".join(blobs), kind)
            rows = rows[np.lexsort((rows["start"], rows["doc"], rows["hash"])) if kind is MARK else np.argsort(rows["hash"])]
            start = np.flatnonzero(np.concatenate([[True], rows["hash"][1:] != rows["hash"][:-1]]))
            fields = np.zeros(len(rows), told)
            for name in told.names:
                fields[name] = rows[name]
            found = [fields[a:b].tobytes() for a, b in zip(start.tolist(), [*start[1:].tolist(), len(rows)])]
            yield pa.RecordBatch.from_arrays([pa.array(rows["hash"][start]), pa.array(found, pa.binary())], names=["hash", "found"])

    return gather


def _alone(rows: np.ndarray, content: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which segments no equal one in a smaller document makes needless, and which are so removed whole."""
    least: dict[bytes, int] = {}
    doc = rows["doc"].tolist()
    for d, c in zip(doc, content):
        if least.get(c, LAST_ID) >= d:
            least[c] = d
    stay = np.fromiter((least[c] == d for d, c in zip(doc, content)), bool, len(doc))
    return np.flatnonzero(stay), np.flatnonzero(~stay)


def _marks(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), MARK)
    out["hash"], out["doc"], out["start"], out["n"] = rows["hash"], rows["doc"], rows["start"], rows["size"] - (LENGTH - 1)
    return out


def _segments(buckets: int):
    """Rows (bucket, segments, their bytes); removed segments go along as bucket -1 - b."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, contents, size = [], [], 0
        for batch in batches:
            first = batch.column("doc").to_numpy() == batch.column("first").to_numpy()
            batch = batch.filter(pa.array(first & batch.column("found").is_valid().to_numpy(zero_copy_only=False)))
            texts, doc, hashes = batch.column("text"), batch.column("doc").to_numpy(), batch.column("hash").to_numpy()
            for a, b in slices(texts, SLICE):
                raw, offsets = joined(texts.slice(a, b - a))
                s = Segments(raw, offsets)
                known = batch.column("found").slice(a, b - a).to_pylist()
                anchors = np.frombuffer(b"".join(known), KEY)
                own = np.repeat(np.arange(len(known)), [len(x) // KEY.itemsize for x in known])
                pair = lambda k, o: mix(k ^ mix(o.astype(np.uint64)))
                at = np.flatnonzero(np.isin(pair(s.key, s.own), pair(_keys(anchors), own)))
                rows = np.zeros(len(at), SEGMENT)
                rows["key"], rows["doc"], rows["hash"] = s.key[at], doc[s.own[at] + a], hashes[s.own[at] + a]
                rows["start"], rows["size"] = s.start[at] - offsets[s.own[at]], s.n[at] + LENGTH - 1
                data = raw.tobytes()
                held.append(rows)
                contents += [data[x : x + n] for x, n in zip(s.start[at].tolist(), rows["size"].tolist())]
                size += len(rows)
                if size > 200_000:
                    yield from done(np.concatenate(held), contents)
                    held, contents, size = [], [], 0
        if held:
            yield from done(np.concatenate(held), contents)

    def done(rows: np.ndarray, content: list[bytes]) -> Iterator[pa.RecordBatch]:
        stay, gone = _alone(rows, content)
        bucket = rows["key"].astype(np.int64) % buckets
        yield _dealt(rows[stay], bucket[stay], [content[k] for k in stay.tolist()])
        marks = _marks(rows[gone])
        out = _dealt(marks, bucket[gone], [b""] * len(gone))
        yield out.set_column(0, "bucket", pa.array(-1 - out.column("bucket").to_numpy()))

    return emit


class Columns:
    """The columns of the transform, read from one spooled file and written to the next in sequence."""

    kinds = (("bwt", np.uint8), ("lcp", np.uint8), ("segment", np.int32), ("offset", np.uint8))

    def __init__(self, n: int):
        self.files: dict = {}
        for name, kind in self.kinds:
            self.write(name, np.arange(n, dtype=kind) if name == "segment" else np.zeros(n, kind))

    def write(self, name: str, column: np.ndarray) -> None:
        if name in self.files:
            self.files[name].close()
        self.files[name] = tempfile.SpooledTemporaryFile(SPOOL)
        self.files[name].write(memoryview(column))

    def read(self, name: str) -> np.ndarray:
        self.files[name].seek(0)
        return np.frombuffer(self.files[name].read(), dict(self.kinds)[name])

    def insert(self, name: str, old: np.ndarray, stay: np.ndarray, at: np.ndarray, values, then=None, change=None) -> np.ndarray:
        """Rewrite a column: the old rows at places *stay*, *values* at places *at*, then *change* at places *then*."""
        new = np.empty(len(stay) + len(at), old.dtype)
        new[stay] = old
        new[at] = values
        if then is not None:
            new[then] = change
        self.write(name, new)
        return new

    def close(self) -> None:
        for file in self.files.values():
            file.close()


def _common(raw: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the strings at *a* and *b*, at most *most*; raw has 8 bytes to spare."""
    word = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        differ = word[a[live] + out[live]] ^ word[b[live] + out[live]]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
        out[live] += same
        live = live[(same == 8) & (out[live] < most[live])]
    return np.minimum(out, most)


def column_wise_transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol before, common prefix with the row above, string, offset) of all suffixes in order, empty ones first.

    Round j inserts the suffixes of length j.  A suffix cX goes below all rows that start with less, and among those
    that start with c to the rank of c in the transform above X.  Suffixes that are equal follow their strings' order.
    """
    n = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    raw = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    base = np.cumsum(size) - size
    columns = Columns(n)
    columns.write("offset", size.astype(np.uint8))
    row = np.arange(n)  # where each string's latest suffix stands
    live = np.arange(n)
    ends = base + size
    for j in range(1, int(size.max(initial=0)) + 1):
        live = live[size[live] >= j]
        bwt, offset = columns.read("bwt").copy(), columns.read("offset")
        bwt[row[live]] = raw[base[live] + size[live] - j]
        above = np.flatnonzero(offset)  # rows X with a symbol before them; cX is in the collection after this round
        place = np.empty(len(bwt), np.int32)
        place[above[np.argsort(bwt[above], kind="stable")]] = np.arange(n, n + len(above), dtype=np.int32)
        at = place[row[live]]
        sort = np.argsort(at)
        at, who = at[sort], live[sort]
        old = np.ones(len(bwt) + len(at), bool)
        old[at] = False
        stay = np.flatnonzero(old)
        owner = columns.insert("segment", columns.read("segment"), stay, at, who)
        offset = columns.insert("offset", offset, stay, at, size[who] - j)
        columns.insert("bwt", bwt, stay, at, 0)
        # Common prefixes change at the new rows and at the rows below them.
        touched = ~old
        touched[1:] |= touched[:-1]
        below = np.flatnonzero(touched)
        x, y = owner[below - 1], owner[below]
        x_start, y_start = base[x] + offset[below - 1], base[y] + offset[below]
        columns.insert("lcp", columns.read("lcp"), stay, at, 0, below, _common(raw, x_start, y_start, np.minimum(ends[x] - x_start, ends[y] - y_start)))
        row = stay[row]
        row[who] = at
    out = [columns.read(name).copy() for name, _ in Columns.kinds]
    columns.close()
    return tuple(out)


def repeated_windows(strings: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows that also occur in a string of a smaller document."""
    _, lcp, owner, offset = column_wise_transform(strings)
    size = np.array([len(s) for s in strings], np.int64)
    start = np.flatnonzero(lcp < LENGTH)
    least = np.minimum.reduceat(doc[owner], start)
    least = np.repeat(least, np.diff(np.append(start, len(lcp))))
    found = np.flatnonzero((least < doc[owner]) & (size[owner] - offset >= LENGTH))
    return owner[found], offset[found].astype(np.int64)


def _repeats(homes: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (blobs, bytes_) in _by_bucket(batches, "rows", "bytes"):
            if bucket < 0:
                marks = np.frombuffer(b"".join(blobs), MARK)
                yield _dealt(marks, _home(marks["hash"], homes))
                continue
            rows = np.frombuffer(b"".join(blobs), SEGMENT)
            data = b"".join(bytes_)
            ends = np.cumsum(rows["size"].astype(np.int64))
            content = [data[e - n : e] for e, n in zip(ends.tolist(), rows["size"].tolist())]
            del blobs, bytes_, data  # copies of what is held now
            stay, gone = _alone(rows, content)
            found = [_marks(rows[gone])]
            order = stay[np.argsort(rows["key"][stay], kind="stable")]
            key = rows["key"][order]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            # A minimizer with one segment left has nothing to be compared with.
            groups = [(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) if b - a > 1]
            while groups:
                batch: list[int] = []
                while groups and (not batch or len(batch) + groups[-1][1] - groups[-1][0] <= BATCH):
                    a, b = groups.pop()
                    batch += order[a:b].tolist()
                part = rows[batch]
                owner, offset = repeated_windows([content[k] for k in batch], part["doc"].astype(np.int64))
                out = np.zeros(len(owner), MARK)
                out["hash"], out["doc"], out["start"], out["n"] = part["hash"][owner], part["doc"][owner], part["start"][owner] + offset, 1
                found.append(_runs(out))
            marks = np.concatenate(found)
            if len(marks):
                yield _dealt(marks, _home(marks["hash"], homes))

    return mark


def _runs(marks: np.ndarray) -> np.ndarray:
    """Marks of single windows, neighbours joined."""
    marks = marks[np.lexsort((marks["start"], marks["doc"], marks["hash"]))]
    if not len(marks):
        return marks
    new = np.ones(len(marks), bool)
    new[1:] = (marks["doc"][1:] != marks["doc"][:-1]) | (marks["hash"][1:] != marks["hash"][:-1]) | (marks["start"][1:] > marks["start"][:-1] + 1)
    at = np.flatnonzero(new)
    out = marks[at].copy()
    out["n"] = marks["start"][np.append(at[1:], len(marks)) - 1] - out["start"] + 1
    return out


def spans(found: bytes | None, doc: int) -> np.ndarray:
    """Maximal covered runs (first byte, end) of a document's marked windows."""
    marks = np.frombuffer(found or b"", SPAN)
    marks = marks[marks["doc"] == doc]  # none of another document with this hash
    if not len(marks):
        return np.zeros((0, 2), np.int64)
    start = marks["start"].astype(np.int64)
    end = np.maximum.accumulate(start + marks["n"] + LENGTH - 1)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return np.stack([start[new], end[np.append(new[1:], len(end)) - 1]], 1)


def repeated_windows_of(df: DataFrame) -> DataFrame:
    """doc (the id, the last one for null), known (whether it has one), first, text and ``found``, the marked windows of first copies; see :func:`spans`.

    Copies of a whole text are one text: *first* is the least id that has it, and all others lose everything.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.col("doc_id").isNotNull().alias("known"), text_or_empty().alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(n, int(size // BUCKET_BYTES))
    # Each file that a task writes starts a process that shares the executor's memory for a moment: few files for little text.
    files = max(spark.sparkContext.defaultParallelism, int(size // BUCKET_BYTES))
    md5 = F.md5(F.col("text").cast("binary"))
    firsts = staged(docs.groupBy("hash", md5.alias("md5")).agg(F.min("doc").alias("first")).coalesce(files), "first-copies")
    # A bucket is a partition, so that there are more tasks for more text; marks have the bucket -1 - b and go with b.
    at = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket")).cast("int")
    dealt = docs.select("hash", "text").transform(map_arrow, _anchors(buckets), "bucket long, rows binary").repartitionById(buckets, at)
    told = dealt.transform(map_arrow, _shared(buckets), "bucket long, rows binary").repartitionById(buckets, at)
    shared = told.transform(map_arrow, _by_document(ANCHOR, KEY), "hash long, found binary")
    shared = staged(firsts.join(shared, "hash", "left").coalesce(files), "first-minimizers")
    del dealt, told
    release(spark)

    def of_texts(table: DataFrame) -> DataFrame:
        """Each document with its text's row.  One join of two exchanges, whose large partitions Spark can split, so that
        the copies of one text are no single task.  (instr, lest the optimizer make the md5 a second key.)"""
        return docs.join(table.hint("merge"), "hash").where(F.instr(md5, F.col("md5")) == 1).drop("md5")

    dealt = of_texts(shared).transform(map_arrow, _segments(buckets), "bucket long, rows binary, bytes binary").repartitionById(buckets, at)
    marks = dealt.transform(map_arrow, _repeats(buckets), "bucket long, rows binary").repartitionById(buckets, at)
    found = marks.transform(map_arrow, _by_document(MARK, SPAN), "hash long, found binary")
    found = staged(firsts.join(found, "hash", "left").coalesce(files), "first-marks")
    del dealt, marks
    release(spark)
    return of_texts(found).select("doc", "known", "first", "text", "found")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, known, first, text, found in zip(batch.column("doc").to_pylist(), batch.column("known").to_pylist(), batch.column("first").to_pylist(), batch.column("text"), batch.column("found").to_pylist()):
            data = bytes(text.as_buffer())
            runs = spans(found, doc) if doc == first else np.array([[0, len(data)]] if len(data) >= LENGTH else [], np.int64).reshape(-1, 2)
            kept, at = [], 0
            for a, b in runs.tolist():
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            rows.append((doc if known else None, len(data), len(data) - len(kept), len(runs), kept))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def cut_repeats(df: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    return repeated_windows_of(df).transform(map_arrow, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(df: DataFrame) -> DataFrame:
    return cut_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
