"""Line dedup by an exact set-similarity join.

A line is the set of its words.  A line goes if an earlier line anywhere (smaller doc_id, or higher up in the same
document), whether that one stays or not, has a Jaccard similarity of at least the threshold with it.

Lines with equal sets are one node from the start, and all but the node's first line go.  For the others, words are
ordered by rarity: words outside the table of the most frequent ones first, then the table by rising count.  Two sets
that are similar enough share a word among the first ``n - ceil(t * n) + 1`` of each (prefix filter).  Sets that meet in
a prefix word are compared by length, by the overlap that their places in the order still allow (positional filter),
and by counts of their words in 32 groups (128 for long lines), whose differences bound from below how many words
are in one set only.  What passes is connected to a family;
families are verified exactly, and the later line of each similar pair goes: in a family of more than a block of lines
each is held against the first one, and only those unlike it are compared with all others, block by block.

The order of words decides how many candidates there are, not which lines are similar: the table holds at most
``FREQUENT`` words, and counts below ``LEAST`` in one task's share of the documents are left out of it.  A prefix word
with many lines is dealt to pairs of blocks of bounded size.

Defined results: blank lines stay; null and empty texts have no lines; null ids come last, each a document of its own;
rows that share an id come by the hash of their texts, and rows that share both are one document; an empty table gives
an empty result; other columns are kept by :func:`remove_lines`, which leaves the empty text of a document that lost its
last word, or drops such documents if asked to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, discard, map_arrow, quoted, release, staged
from quillon.llm.components import components
from quillon.llm.hashing import Lookup, complete_groups, distinct, mix, word_hashes
from quillon.llm.minhash import _least, _moved, met_in_groups, similar_pairs, similar_sets
from quillon.llm.tokens import joined, slices

THRESHOLD = 0.8
#: Words in the table of frequent ones, at most, and the least count in a task that enters it.
FREQUENT, LEAST = 1 << 18, 4
SLICE = 1 << 20
#: Postings of a word that are compared in one task, about; and bytes of postings to a task.
LIST_BLOCK = 20_000
BUCKET_BYTES = 16 << 20
LAST_ID = (1 << 63) - 1
#: Copies of a text without an id that are unfolded from one row, and groups that they are first numbered in.
UNFOLD, COPY_GROUPS = 4096, 64

POSTING = np.dtype([("hi", "<u4"), ("lo", "<u2"), ("node", "<i8"), ("n", "<u4"), ("pos", "<u2"), ("side", "u1"), ("counts", "u1", 16)])
#: Longer lines also send counts of four times as many groups of words.
WIDE = 256


class Lines:
    """The lines of texts laid end to end, and the distinct words of each, sorted by line."""

    def __init__(self, texts: pa.Array):
        raw, offsets = joined(texts)
        breaks = np.flatnonzero(raw == 10)
        self.starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
        self.size = ends - self.starts
        self.first = np.searchsorted(breaks, offsets[:-1], "left") + np.arange(len(offsets) - 1)  # the first line of each text
        self.count = np.diff(np.append(self.first, len(self.starts)))
        h, start, _, _ = word_hashes(raw, np.unique(offsets))
        self.words, self.line = distinct(h, np.searchsorted(self.starts, start, "right") - 1)
        self.n = np.bincount(self.line, minlength=len(self.starts))
        self.node = self._sums(mix(self.words)) if len(self.words) else np.zeros(len(self.starts), np.uint64)
        self.node = np.where(self.n > 0, mix(self.node + self.n.astype(np.uint64)) | np.uint64(1), np.uint64(0)).view(np.int64)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        end = np.cumsum(self.n)
        return total[end] - total[end - self.n]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its lines' nodes (0: blank); at the end of the task, the counts of its frequent words."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        texts = batch.column("text")
        for a, b in slices(texts, SLICE):
            lines = Lines(texts.slice(a, b - a))
            nodes = pa.ListArray.from_arrays(pa.array(np.append(lines.first, len(lines.node)).astype(np.int32)), pa.array(lines.node))
            nulls = pa.nulls(b - a, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "digest")), nodes, nulls, nulls], names=["doc_id", "digest", "nodes", "word", "count"])
            held.append(np.unique(lines.words, return_counts=True))
            size += len(held[-1][0])
            if size > 1_000_000 and len(held) > 1:
                held = [_summed(held)]
                size = len(held[0][0]) // 2
    if held:
        word, count = _summed(held)
        some = count >= LEAST
        nulls = pa.nulls(int(some.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([nulls, nulls, pa.nulls(len(nulls), pa.list_(pa.int64())), pa.array(word[some].view(np.int64)), pa.array(count[some])], names=["doc_id", "digest", "nodes", "word", "count"])


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    word, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
    return word, np.bincount(at, np.concatenate([c for _, c in held]), len(word)).astype(np.int64)


def _prefixes(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _group_counts(words: np.ndarray, line: np.ndarray, n: int, bits: int) -> np.ndarray:
    """How many words of each line fall in each of 2**bits groups, modulo 16, two to a byte."""
    group = (mix(words) >> np.uint64(64 - bits)).astype(np.int64)
    counts = np.bincount(line << bits | group, minlength=n << bits).reshape(n, 1 << bits).astype(np.uint8) & 15
    return counts[:, ::2] | counts[:, 1::2] << 4


def _unpacked(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), 2 * packed.shape[1]), np.int8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At most so many words, in both lines together, are in one only: differences of counts, around the circle of 16."""
    d = np.abs(x - y)
    return np.minimum(d, 16 - d).sum(1, dtype=np.int64)


def _postings(threshold: float, frequent: np.ndarray, counts: np.ndarray, buckets: int):
    """Rows (bucket, postings): the prefix words of every line that can have a similar line with another set."""
    order = np.lexsort((frequent, counts))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    by_word = np.argsort(frequent)
    # Place -1, for words that the table lacks, is the last: rank and count 0.
    table, table_rank, table_count = frequent[by_word], np.append(rank[by_word], 0), np.append(counts[by_word], 0)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        places = Lookup(table)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, SLICE):
                lines = Lines(texts.slice(a, b - a))
                _, first = np.unique(lines.node, return_index=True)
                fresh = np.zeros(len(lines.node), bool)
                fresh[[k for k, x in zip(first.tolist(), lines.node[first].tolist()) if x not in seen]] = True
                # Sets of fewer words than 1 / (1 - t), less one, have no similar set but their own.
                fresh &= (lines.n + 1) * threshold <= lines.n + 1e-9
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.update(lines.node[fresh].tolist())
                keep = fresh[lines.line]
                word, line = lines.words[keep], lines.line[keep]
                if not len(word):
                    continue
                at = places(word)
                r, c = table_rank[at], table_count[at]
                starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                # By line, then rank; words of a line come sorted, and those of one rank stay so.
                own = np.cumsum(np.concatenate([[0], line[1:] != line[:-1]]))
                sort = np.argsort(own << 41 | r << 22 | np.minimum(np.arange(len(line)) - starts[own], (1 << 22) - 1))
                word, c = word[sort], c[sort]
                n = np.diff(np.append(starts, len(line)))
                own = np.repeat(np.arange(len(n)), n)
                counts = _group_counts(word, own, len(n), 5)
                long = n > WIDE
                wide = _group_counts(word[long[own]], (np.cumsum(long) - 1)[own[long[own]]], int(long.sum()), 7)
                wide_row = np.cumsum(long) - 1
                pos = np.arange(len(line)) - starts[own]
                some = np.flatnonzero(pos < _prefixes(n, threshold)[own])
                own, pos, word, c = own[some], pos[some], word[some], c[some]
                node = lines.node[line[starts]]
                blocks = -(-c // LIST_BLOCK) + (c == 0)
                mine = (mix(node[own].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                each = np.repeat(np.arange(len(own)), blocks)
                other = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                low, high = np.minimum(mine[each], other), np.maximum(mine[each], other)
                key = mix(word[each] + (low * blocks[each] + high).astype(np.uint64))
                out = np.zeros(len(each), POSTING)
                out["hi"], out["lo"] = key >> np.uint64(32), key & np.uint64(0xFFFF)
                out["side"] = np.where(low == high, 0, np.where(mine[each] == low, 1, 2))
                own = own[each]
                out["node"], out["n"], out["pos"], out["counts"] = node[own], n[own], np.minimum(pos[each], 65535), counts[own]
                bucket = ((key >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
                sort = np.argsort(bucket, kind="stable")
                bucket, out, own = bucket[sort], out[sort], own[sort]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                runs = list(zip(cut.tolist(), [*cut[1:].tolist(), len(out)]))
                blobs = [out[x:y].tobytes() for x, y in runs]
                wides = [wide[wide_row[own[x:y][long[own[x:y]]]]].tobytes() for x, y in runs]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(blobs, pa.binary()), pa.array(wides, pa.binary())], names=["bucket", "postings", "wide"])

    return emit


def _candidates(threshold: float):
    share = threshold / (1 + threshold)

    def passing(node, size, pos, side, narrow, wide, place, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of postings of one word pass the side, positional and count filters."""
        nx, ny, px, py = size[a], size[b], pos[a], pos[b]
        need = np.ceil(share * (nx + ny) - 1e-9)
        good = ((side[a] != side[b]) | (side[a] == 0)) & (node[a] != node[b])
        good &= 1 + np.minimum(px, py) + np.minimum(nx - px, ny - py) - 1 >= need
        most = nx + ny - 2 * need
        for at in range(0, len(a), 20_000):
            k = np.flatnonzero(good[at : at + 20_000]) + at
            good[k] = _apart(narrow[a[k]], narrow[b[k]]) <= most[k]
            k = k[good[k] & (nx[k] > WIDE) & (ny[k] > WIDE)]
            good[k] = _apart(wide[place[a[k]]], wide[place[b[k]]]) <= most[k]
        return good

    def connect(p: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
        place = np.cumsum(p["n"] > WIDE) - 1
        key = p["hi"].astype(np.uint64) << np.uint64(16) | p["lo"]
        order = np.lexsort((p["node"], p["n"], key))
        p, place = p[order], place[order]
        columns = (np.ascontiguousarray(p["node"]), p["n"].astype(np.int64), p["pos"].astype(np.int64), np.ascontiguousarray(p["side"]), _unpacked(p["counts"]), _unpacked(wide), place)
        test = lambda a, b: passing(*columns, a, b)
        key = p["hi"].astype(np.uint64) << np.uint64(16) | p["lo"]
        n = p["n"].astype(float)
        found, active, d = [], np.arange(len(p) - 1), 1
        while len(active) and d <= 64:
            # In a list sorted by length, what is too long for a line stays so further on.
            active = active[active + d < len(p)]
            active = active[(key[active] == key[active + d]) & (n[active] >= threshold * n[active + d] - 1e-9)]
            good = active[test(active, active + d)]
            found.append(np.stack([good, good + d], 1))
            d += 1
        ab = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if len(active):  # long lists: only lines of different parts are still to be compared
            part = _least(np.arange(len(p)), ab[:, 0], ab[:, 1])
            more = []
            for k in np.unique(key[active]):
                lo, hi = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
                own = part[lo:hi]
                main = np.bincount(own - lo).argmax() + lo
                for i in np.flatnonzero(own != main) + lo:
                    a = np.arange(lo, hi)
                    a = a[(part[a] != part[i]) & (np.minimum(n[a], n[i]) >= threshold * np.maximum(n[a], n[i]) - 1e-9) & ((part[a] == main) | (a > i))]
                    for chunk in np.array_split(a, max(1, len(a) // 100_000)):
                        good = chunk[test(np.full(len(chunk), i), chunk)]
                        if len(good):
                            _, one = np.unique(part[good], return_index=True)  # a link to each part is enough
                            more.append(np.stack([np.full(len(one), i), good[one]], 1))
            ab = np.concatenate([ab, *more])
        return _moved_nodes(p["node"], ab)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for batch in batches:
            for bucket, blob, wide in zip(*(batch.column(c).to_pylist() for c in ("bucket", "postings", "wide"))):
                blobs, wides = held.setdefault(bucket, ([], []))
                blobs.append(blob)
                wides.append(wide)
        while held:
            _, (blobs, wides) = held.popitem()
            yield connect(np.frombuffer(b"".join(blobs), POSTING), np.frombuffer(b"".join(wides), np.uint8).reshape(-1, 64))

    return candidates


def _moved_nodes(node: np.ndarray, ab: np.ndarray) -> pa.RecordBatch:
    names, place = np.unique(node, return_inverse=True)
    return _moved(names, place[ab[:, 0]], place[ab[:, 1]])


def _member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        texts = batch.column("text")
        for a, b in slices(texts, SLICE):
            part = batch.slice(a, b - a)
            lines = Lines(texts.slice(a, b - a))
            ends = np.cumsum(lines.n)
            data = lines.words.tobytes()
            rows = [[] for _ in range(7)]
            for k, (doc, digest, members) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "digest", "members")))):
                if (doc, digest) == last:  # a copy of the document before it
                    continue
                last = (doc, digest)
                for m in members:
                    at = int(lines.first[k]) + m["line"]
                    if m["line"] < lines.count[k] and lines.node[at] == m["node"]:
                        for row, x in zip(rows, (m["node"], m["family"], m["n"], doc, digest, m["line"], data[8 * int(ends[at] - lines.n[at]) : 8 * int(ends[at])])):
                            row.append(x)
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names=["node", "family", "n", "doc_id", "digest", "line", "words"])


def _verify(threshold: float):
    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in complete_groups(batches, ["family", "pair"]):
            sets = [np.frombuffer(x, "<u8") for x in rows.column("words").to_pylist()]
            ab = similar_pairs(sets, rows.column("side").to_numpy(), group, threshold)
            doc, digest, line, node = (rows.column(c).to_numpy() for c in ("doc_id", "digest", "line", "node"))
            order = np.lexsort((line, digest, doc))
            place = np.empty(len(order), np.int64)
            step = np.diff(doc[order]) != 0
            step |= (np.diff(digest[order]) != 0) | (np.diff(line[order]) != 0)
            place[order] = np.cumsum(np.concatenate([[0], step]))[: len(order)]
            a, b = ab.T
            after, before = place[a] > place[b], place[a] < place[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([node[a[after]], node[b[before]]])))], names=["node"])

    return later


def _own_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def _digest() -> Column:
    """Tells rows of one id apart by their texts; of rows without an id it is not negative, so that they come last."""
    h = F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 1)
    return F.when(F.col("doc_id").cast("long").isNull(), h).otherwise(-1 - h)


def _found(df: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The survey of the documents, and a row (doc_id, digest, removed) for each that loses lines; null ids are LAST_ID."""
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.select("doc_id", _digest().alias("digest"), "text")
    surveyed = staged(keyed.transform(map_arrow, _survey, "doc_id long, digest long, nodes array<long>, word long, count long"), "lines")
    top = surveyed.where("word is not null").groupBy("word").agg(F.sum("count").alias("count"))
    table = top.orderBy(F.desc("count"), "word").limit(FREQUENT).toArrow()
    frequent, counts = table.column("word").to_numpy().view(np.uint64), table.column("count").to_numpy()
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * n, int(bytes_ // BUCKET_BYTES))
    postings = docs.transform(map_arrow, _postings(threshold, frequent, counts, buckets), "bucket long, postings binary, wide binary")
    met = postings.repartitionById(buckets, F.col("bucket").cast("int")).transform(map_arrow, _candidates(threshold), "a long, b long")
    families = staged(components(met).withColumnRenamed("component", "family"), "line-families")
    del postings, met
    release(spark)
    lines = surveyed.where("nodes is not null").select(_own_id().alias("doc_id"), "digest", F.posexplode("nodes").alias("line", "node")).where("node <> 0")
    firsts = staged(lines.groupBy("node").agg(F.min(F.struct("doc_id", "digest", "line")).alias("first")), "line-firsts")
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    members = families.join(sizes, "family").join(firsts, "node").select("node", "family", "n", "first.doc_id", "first.digest", "first.line")
    members = members.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("node", "family", "n", "line")).alias("members"))
    texts = keyed.select(_own_id().alias("doc_id"), "digest", "text").join(members.hint("merge"), ["doc_id", "digest"])
    sets = texts.transform(map_arrow, _member_sets, "node long, family long, n long, doc_id long, digest long, line int, words binary")
    sets = staged(sets, "line-sets")
    star, dealt = met_in_groups(sets, "family", "n", ["doc_id", "digest", "line"], "words", similar_sets(threshold))
    later = dealt.transform(map_arrow, _verify(threshold), "node long").unionByName(star.select("node")).distinct()
    later = staged(later, "later-nodes").withColumn("later", F.lit(True))
    discard(sets)
    known = firsts.join(later, "node", "left").select("node", "first", F.coalesce("later", F.lit(False)).alias("later"))
    gone = lines.join(known, "node").where(F.col("later") | (F.struct("doc_id", "digest", "line") != F.col("first")))
    return surveyed.where("nodes is not null"), gone.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def removed_lines(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, n_lines, n_removed, removed (line numbers from 0, rising)."""
    surveyed, gone = _found(df, threshold)
    none = F.array().cast("array<int>")
    rows = surveyed.where("doc_id is not null").select("doc_id", "digest", F.size("nodes").cast("long").alias("n_lines"), none.alias("all"), F.lit(1).cast("long").alias("n"))
    # Of equal texts without an id all but one lose every line that is not blank.
    worded = F.filter(F.transform("nodes", lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    alone = surveyed.where("doc_id is null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("nodes").alias("nodes"))
    alone = alone.select(F.lit(None).cast("long").alias("doc_id"), "digest", F.size("nodes").cast("long").alias("n_lines"), worded.alias("all"), "n")
    rows = rows.unionByName(alone).withColumnRenamed("doc_id", "_id").withColumn("doc_id", F.coalesce("_id", F.lit(LAST_ID)))
    out = rows.join(gone, ["doc_id", "digest"], "left").withColumn("removed", F.coalesce("removed", none))
    once = F.struct("removed", F.lit(1).cast("long").alias("n"))
    again = F.transform(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / UNFOLD)),
        lambda b: F.struct(F.col("all").alias("removed"), F.least(F.lit(UNFOLD).cast("long"), F.col("n") - 1 - b * UNFOLD).alias("n")),
    )
    out = out.select("_id", "n_lines", F.explode(F.when(F.col("n") > 1, F.concat(F.array(once), again)).otherwise(F.array(once))).alias("part"))
    out = out.select("_id", "n_lines", "part.removed", F.explode(F.sequence(F.lit(1).cast("long"), F.col("part.n"))))
    return out.select(F.col("_id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def _with_copies(df: DataFrame) -> DataFrame:
    """*df* with _quillon_copy: whether the row has no id and another such row, the only one without the mark, has its text."""
    ids = F.col("doc_id").cast("long")
    alone = df.where(ids.isNull()).withColumn("_quillon_group", F.pmod(F.monotonically_increasing_id(), F.lit(COPY_GROUPS)))
    # Numbered in groups first, so that a hot text is not one task's.
    first = F.row_number().over(Window.partitionBy("_quillon_digest", "_quillon_group").orderBy(F.lit(0))) == 1
    alone = alone.withColumn("_quillon_first", first).withColumn("_quillon_group", F.when(F.col("_quillon_first"), -1).otherwise(F.col("_quillon_group")))
    number = F.row_number().over(Window.partitionBy("_quillon_digest", "_quillon_group").orderBy(F.lit(0)))
    alone = alone.withColumn("_quillon_copy", ~F.col("_quillon_first") | (number > 1)).drop("_quillon_first", "_quillon_group")
    return df.where(ids.isNotNull()).withColumn("_quillon_copy", F.lit(False)).unionByName(alone)


def remove_lines(df: DataFrame, threshold: float = THRESHOLD, drop_emptied: bool = False) -> DataFrame:
    """*df* with those lines taken out of text; n_chars, where there is one, follows the text.

    With *drop_emptied*, documents that had words and have none left go; those that never had any stay.
    """
    _, gone = _found(df, threshold)
    keys = ["_quillon_id", "_quillon_digest"]
    gone = gone.select(F.col("doc_id").alias(keys[0]), F.col("digest").alias(keys[1]), F.col("removed").alias("_quillon_gone"))
    out = _with_copies(df.withColumns({keys[0]: _own_id(), keys[1]: _digest()})).join(gone.hint("merge"), keys, "left")
    copy, word = F.col("_quillon_copy"), f"[^{SPACE}]"
    lost = F.col("_quillon_gone").isNotNull() | copy & F.coalesce(F.col("text").rlike(word), F.lit(False))
    stays = lambda s, i: F.when(copy, ~s.rlike(word)).otherwise(~F.array_contains("_quillon_gone", i))
    kept = F.array_join(F.filter(F.transform(F.split("text", "\n", -1), lambda s, i: F.when(stays(s, i), s)), lambda s: s.isNotNull()), "\n")
    out = out.withColumn("_quillon_lost", lost).withColumn("text", F.when(F.col("_quillon_lost"), kept).otherwise(F.col("text")))
    lost = F.col("_quillon_lost")
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length("text")).otherwise(F.col("n_chars")).cast(df.schema["n_chars"].dataType))
    if drop_emptied:
        out = out.where(~lost | F.coalesce(F.col("text").rlike(word), F.lit(False)))
    return out.select(*quoted(df.columns))
