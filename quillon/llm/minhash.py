"""MinHash near-duplicates with DartMinHash signatures.

A text is the set of its five-word shingles, each with a weight: how often the text holds it, or 1 for plain sets.  A
weighted set is the region of all points (element, weight, rank) below the elements' weights.  Darts are a Poisson process on that plane, seeded by the element alone: in each dyadic band of
weights, arrivals along the rank axis at the rate of the band's width.  A set of total weight W looks at ranks up to
t / W, so about t darts fall below its weights whatever its size, and for each coordinate the dart with the least rank
is kept.  Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.  A set with an
empty coordinate looks twice as far.

Signatures of 32 bands of 6 coordinates are joined band by band.  At similarity 0.8 a pair meets in no band with
probability 6e-5, at 0.9 with 3e-11.  Within a band's bucket signatures are compared in blocks, and texts that agree in
less than 0.66 of all coordinates (more than 4 deviations below 0.8) are parted again.  What is still connected is a family;
its texts are compared exactly, block by block, by their weighted shingle sets, and links of at least the threshold
make the classes.  In buckets and families of more than a block, texts are held against the first one before any others; only
those unlike it meet all others.  Tasks give out one link per text and block, never all pairs.  Equal shingle sets are one text from the start.

Defined results: a null, empty or blank text has no shingles and is a class of its own; a text of one to four words is
one shingle; rows that share an id but not the text are told apart by their texts, and those of one class or one text
are one document; a null id gives a null class that is kept; an empty table gives an empty result; other columns are
kept by :func:`keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, map_arrow, staged
from quillon.llm.components import components
from quillon.llm.hashing import complete_groups, counted, mix, shingle_hashes
from quillon.llm.tokens import SLICE_BYTES, joined, slices

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
#: Signatures that agree in a smaller share of their coordinates are no candidates.
MARGIN = 0.66
SEED = np.uint64(0x5EED_DA27)
STRIDE = 0x5851F42D4C957F2D
BLOCK = 512
SMALL = 6
#: Arrivals of darts that are looked at together.
TOGETHER = 4096

_EMPTY = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, n_sets: int, k: int = BANDS * ROWS) -> np.ndarray:
    """A row of *k* darts for each set, as (rank, id) packed in 64 bits; sets without elements have none.

    *elements* are hashes, *weights* positive, *sets* the set of each element.
    """
    out = np.full((n_sets, k), _EMPTY, np.uint64)
    total = np.bincount(sets, weights, n_sets)
    far = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(n_sets), where=total > 0)
    seeds = mix(elements ^ SEED)
    bands = np.maximum(0, np.ceil(np.log2(np.maximum(weights, 1e-300)))).astype(int)
    todo = np.arange(len(elements))
    while len(todo):
        flat = out.reshape(-1)
        for band in range(int(bands[todo].max()) + 1):
            at = todo[bands[todo] >= band]
            low, width = (0.0, 1.0) if band == 0 else (2.0 ** (band - 1), 2.0 ** (band - 1))
            rank = np.zeros(len(at))
            n = 0
            while len(at):
                some = max(1, TOGETHER // len(at))  # arrivals of an element at a time; few elements have many left
                steps = np.array([((band << 32) + n + i + 1) * STRIDE & (1 << 64) - 1 for i in range(some)], np.uint64)
                h = mix(seeds[at][:, None] + steps)
                ranks = np.log1p((h >> np.uint64(11)) * -(2.0**-53)) / -width
                ranks[:, 0] += rank
                if some > 1:
                    np.cumsum(ranks, axis=1, out=ranks)
                near = ranks <= far[sets[at]][:, None]
                own, _ = np.nonzero(near)
                dart = mix(h[near] + np.uint64(1))
                below = low + width * (mix(dart) >> np.uint64(11)) * 2.0**-53 < weights[at[own]]
                dart = dart[below]
                place = sets[at[own[below]]] * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
                packed = ranks[near][below].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | dart & np.uint64(0xFFFFFFFF)
                np.minimum.at(flat, place, packed)
                n += some
                at, rank = at[near[:, -1]], ranks[near[:, -1], -1]
        short = (out == _EMPTY).any(1) & (total > 0)
        far[short] *= 2
        todo = todo[short[sets[todo]]]
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, k = signatures.shape
    odd = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((mix(signatures) * odd).reshape(n, bands, k // bands).sum(2, dtype=np.uint64)).view(np.int64)


def _elements(texts: pa.Array, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, text): the distinct shingles of each text, sorted, weighing how often they come, or 1."""
    h, own, times = counted(*shingle_hashes(*joined(texts), WORDS))
    return h, times if weighted else np.ones(len(h), np.int64), own


def _signed(weighted: bool):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, SLICE_BYTES):  # darts are thrown for many texts at once, few enough for a small worker
                n = b - a
                h, weight, own = _elements(texts.slice(a, n), weighted)
                signatures = dart_signatures(h, weight.astype(float), own, n)
                keys = band_keys(signatures)
                ends = np.searchsorted(own, np.arange(n + 1))
                some = np.diff(ends) > 0
                data = np.stack([h, weight.astype(np.uint64)], 1).tobytes()
                digests = [hashlib.md5(data[16 * x : 16 * y]).digest() if y > x else None for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                sketch = (mix(signatures) >> np.uint64(48)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), batch.column("text_hash").slice(a, n), pa.array(digests, pa.binary()), pa.array([r.tobytes() if s else None for r, s in zip(sketch, some)], pa.binary()), pa.array([r.tobytes() if s else None for r, s in zip(keys, some)], pa.binary())],
                    names=["doc_id", "text_hash", "digest", "sketch", "bands"],
                )

    return signed


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<i8")
        node = np.repeat(batch.column("node").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node)], names=["key", "node"])


def _least(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each is connected with by the links a-b."""
    least = node.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        if (least == before).all():
            return least


def _moved(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    least = _least(node, a, b)
    moved = np.flatnonzero(least != node)
    return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(least[moved])], names=["a", "b"])


def _by_sketch(margin: float):
    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in complete_groups(batches, ["key", "pair"]):
            node, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
            raw = rows.column("sketch").to_pylist()
            sketch = np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), -1)
            k, sizes, found = sketch.shape[1], np.bincount(group), [np.zeros((0, 2), np.int64)]
            some = np.flatnonzero(sizes[group] <= SMALL)
            for d in range(1, SMALL):
                a, b = some[:-d], some[d:]
                both = (group[a] == group[b]) & ((side[a] != side[b]) | (side[a] == 0))
                a, b = a[both], b[both]
                near = (sketch[a] == sketch[b]).sum(1) >= margin * k
                found.append(np.stack([a[near], b[near]], 1))
            for g in np.flatnonzero(sizes > SMALL):
                at = np.flatnonzero(group == g)
                own, s = sketch[at], side[at]
                for i in range(len(at) - 1):
                    near = np.flatnonzero((own[i + 1 :] == own[i]).sum(1) >= margin * k) + i + 1
                    near = near[(s[near] != s[i]) | (s[near] == 0)]
                    found.append(np.stack([np.full(len(near), at[i]), at[near]], 1))
            ab = np.concatenate(found)
            yield _moved(node, ab[:, 0], ab[:, 1])

    return agree


def _sets(weighted: bool):
    """The elements of each text; one that weighs w is w elements, so that sets of them have the weighted similarity."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                h, weight, own = _elements(texts.slice(a, b - a), weighted)
                again = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                h, own = np.repeat(h, weight), np.repeat(own, weight)
                h = np.where(again > 0, mix(h + again.astype(np.uint64) * np.uint64(STRIDE)), h)
                ends = np.searchsorted(own, np.arange(b - a + 1))
                data = h.tobytes()
                rows = [data[8 * x : 8 * y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("node", "family", "n")), pa.array(rows, pa.binary())], names=["node", "family", "n", "shingles"])

    return sets


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, group: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (a, b) of a group, of different sides or both of side 0, whose Jaccard similarity is at least *threshold*."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    value = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    sizes = np.bincount(group, minlength=1)
    found = []
    few = sizes[group[owner]] <= SMALL
    order = np.lexsort((owner[few], value[few], group[owner[few]]))
    v, o = value[few][order], owner[few][order]
    codes = []
    for d in range(1, SMALL):
        same = (v[d:] == v[:-d]) & (group[o[d:]] == group[o[:-d]]) if len(v) > d else np.zeros(0, bool)
        codes.append(o[:-d][same] * n + o[d:][same])
    code, shared = np.unique(np.concatenate(codes), return_counts=True)
    found.append(np.stack([code // n, code % n, shared], 1))
    for g in np.flatnonzero(sizes > SMALL):
        at = np.flatnonzero(group == g)
        mine = np.isin(owner, at)
        place = np.searchsorted(at, owner[mine])
        _, column, df = np.unique(value[mine], return_inverse=True, return_counts=True)
        place, column = place[df[column] > 1], column[df[column] > 1]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        place, column = place[order], column[order]
        shared = np.zeros((len(at), len(at)), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [first, first + 4096])
            part = np.zeros((len(at), 4096), np.float32)
            part[place[a:b], column[a:b] - first] = 1
            shared += part @ part.T
        a, b = np.nonzero(np.triu(shared, 1))
        found.append(np.stack([at[a], at[b], shared[a, b].astype(np.int64)], 1))
    a, b, both = np.concatenate(found).astype(np.int64).T
    # |a & b| >= threshold * |a | b|, in whole numbers up to the threshold's own rounding
    good = (both >= threshold * (size[a] + size[b] - both) - 1e-9) & ((side[a] != side[b]) | (side[a] == 0))
    return np.stack([a[good], b[good]], 1)


def _exactly(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in complete_groups(batches, ["family", "pair"]):
            sets = [np.frombuffer(x, "<u8") for x in rows.column("shingles").to_pylist()]
            ab = similar_pairs(sets, rows.column("side").to_numpy(), group, threshold)
            yield _moved(rows.column("node").to_numpy(), ab[:, 0], ab[:, 1])

    return verify


def met_in_groups(df: DataFrame, key: str, size: str, order: list[str], payload: str, near) -> tuple[DataFrame, DataFrame]:
    """(star, dealt) of a staged table of groups *key* of *size* rows: who is like a group's first, and rows still to meet.

    Groups of up to BLOCK rows are dealt as they are, side 0.  In a larger one each row is first held against the
    group's first row by *order* alone (*near*, on two arrays of payloads); *star* has (key, node, first) of those that
    are like it.  Only the others are still to meet, and they meet all rows of the group: block i of theirs, side 1,
    meets block j of all, side 2, in pair (i, j).  So a group of copies costs a pass, not a square.
    """
    spark, columns = df.sparkSession, df.columns
    small = df.where(F.col(size) <= BLOCK).withColumns({"pair": F.lit(0).cast("long"), "side": F.lit(0)})
    large = df.where(F.col(size) > BLOCK)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if large.isEmpty():
        none = spark.createDataFrame([], f"{key} long, node long, first long")
        return none, small.select(*columns, "pair", "side").repartition(n, key, "pair").sortWithinPartitions(key, "pair")
    first = large.groupBy(key).agg(F.min(F.struct(*order, "node", payload)).alias("_first"))
    first = first.select(key, F.col("_first.node").alias("first"), F.col(f"_first.{payload}").alias("_payload"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = near(batch.column(payload).to_pylist(), batch.column("_payload").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("node"), batch.column("first"), pa.array(like, pa.bool_())], names=[key, "node", "first", "like"])

    against = large.select(key, "node", payload).join(first, key).where("node <> first")
    against = staged(against.transform(map_arrow, held, f"{key} long, node long, first long, like boolean"), "stars")
    others = against.where("not like").select(key, "node")
    counts = others.groupBy(key).agg(F.count(F.lit(1)).alias("_others"))
    mine, theirs = F.ceil(F.col("_others") / BLOCK), F.ceil(F.col(size) / BLOCK)
    rows = large.join(counts, key)
    block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = rows.join(others, [key, "node"]).withColumns({"_i": block(mine, 7), "_n": theirs, "side": F.lit(1)}).withColumn("_j", every(theirs))
    right = rows.withColumns({"_j": block(theirs, 11), "_n": theirs, "side": F.lit(2)}).withColumn("_i", every(mine))
    meet = left.unionByName(right, allowMissingColumns=True).withColumn("pair", F.col("_i") * F.col("_n") + F.col("_j"))
    dealt = small.select(*columns, "pair", "side").unionByName(meet.select(*columns, "pair", "side"))
    return against.where("like").select(key, "node", "first"), dealt.repartition(n, key, "pair").sortWithinPartitions(key, "pair")


def _agreeing(margin: float):
    def near(a: list[bytes], b: list[bytes]) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(z), "<u2").reshape(len(z), -1) for z in (a, b))
        return (x == y).sum(1) >= margin * x.shape[1]

    return near


def similar_sets(threshold: float):
    """Whether two sets, as bytes of their sorted elements, have a Jaccard similarity of at least *threshold*; for each two of two lists."""

    def near(a: list[bytes], b: list[bytes]) -> list[bool]:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9 else 0
            out.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
        return out

    return near


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _found(df: DataFrame, threshold: float, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """A row (doc_id, text_hash, digest) for each document, and (digest, first) with the first document of each class.

    A node is the number that a distinct weighted set gets when the table of sets is written; *first* is a struct of
    doc_id and text_hash.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    signed = staged(docs.transform(map_arrow, _signed(weighted), "doc_id long, text_hash long, digest binary, sketch binary, bands binary"), "signatures")
    # Equal sets have equal signatures: any of them will do.
    reps = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands"))
    reps = staged(reps.withColumn("node", F.monotonically_increasing_id()), "signed-texts")
    firsts = reps.select("digest", "node", "first")
    banded = reps.select("node", "bands").transform(map_arrow, _bands, "key long, node long")
    buckets = staged(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    mates = staged(banded.join(buckets, "key"), "bucket-mates")
    met = mates.join(reps.select("node", "sketch"), "node")
    star, dealt = met_in_groups(met, "key", "n", [], "sketch", _agreeing(MARGIN))
    agreed = dealt.transform(map_arrow, _by_sketch(MARGIN), "a long, b long").unionByName(star.select(F.col("node").alias("a"), F.col("first").alias("b")))
    families = staged(components(agreed).withColumnRenamed("component", "family"), "families")
    discard(mates, buckets)
    families = families.join(families.groupBy("family").agg(F.count(F.lit(1)).alias("n")), "family")
    keys = ["doc_id", "text_hash"]
    wanted = families.join(firsts.select("node", "first.doc_id", "first.text_hash"), "node")
    # The merge hint makes the plan the same at every size: members grow with the input and are never broadcast.
    members = docs.join(wanted.hint("merge"), keys).dropDuplicates(keys).select("node", "family", "n", "text")
    sets = staged(members.transform(map_arrow, _sets(weighted), "node long, family long, n long, shingles binary"), "member-sets")
    star, dealt = met_in_groups(sets, "family", "n", [], "shingles", similar_sets(threshold))
    links = dealt.transform(map_arrow, _exactly(threshold), "a long, b long").unionByName(star.select(F.col("node").alias("a"), F.col("first").alias("b")))
    found = staged(components(links), "components")
    discard(sets)
    leads = found.join(firsts, "node").groupBy("component").agg(F.min("first").alias("lead"))
    leads = found.join(leads, "component").select("node", "lead")
    return signed.select(*keys, "digest"), firsts.join(leads, "node", "left").select("digest", F.coalesce("lead", "first").alias("first"))


def classes(df: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """A row per document: doc_id, class_id (the least id of its class), kept."""
    signed, found = _found(df, threshold, weighted)
    out = signed.join(found, "digest", "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id")))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """The first document of each class, all columns; rows of one id and one text are one document, null ids all stay."""
    signed, found = _found(df, threshold, weighted)
    wordless = signed.where("digest is null and doc_id is not null").select("doc_id", "text_hash")
    kept = found.select("first.doc_id", "first.text_hash").unionByName(wordless).distinct()
    keys = ["_quillon_id", "_quillon_text"]
    kept = kept.select(*[F.col(c).alias(k) for c, k in zip(kept.columns, keys)])
    own = df.where("doc_id is not null").withColumns({keys[0]: F.col("doc_id").cast("long"), keys[1]: _text_hash()})
    first = own.join(kept.hint("merge"), keys).dropDuplicates(keys).drop(*keys)
    return first.unionByName(df.where("doc_id is null"))
