"""Merkle fingerprints over phrases, paragraphs and sections (native).

A text is split into sections at blank lines, sections into paragraphs at line ends, paragraphs into phrases of up to
eight words with the white space after them, so that the phrases hold every character.  A leaf is the first 8 hex
digits of a phrase's md5; a paragraph's hash is the md5 of its leaves, a section's that of its paragraphs, the root that
of its sections.  The fingerprint is ``root/section:paragraph=leaves;...|...``: equal roots test equality, and where
two trees differ the differing branches locate the edit.

The likeness of two fingerprints is 1 if their roots are equal, else Dice's coefficient of their leaf sets.

Defined results: a null text is the empty text, whose tree has one empty paragraph; rows with equal ids follow each
other by the md5 of their texts, however many they are; a null id comes before all others; a table of one document is its own next document;
an empty table gives an empty result; other columns are ignored by :func:`fingerprint_edits` and kept by
:func:`fingerprint`, but for one that has the name of its result, which the result replaces.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, text_or_empty

PHRASE_WORDS = 8
PHRASE = f"[{SPACE}]*(?:[^{SPACE}]+[{SPACE}]*){{1,{PHRASE_WORDS}}}|[{SPACE}]+"
#: Text to a range of ids; a range and the first document of the next one are sorted in one task.
RANGE_BYTES = 16 << 20
MIN_RANGES, MAX_RANGES = 256, 16_384
STEP = 128
#: Copies of one row that a task unfolds at once.
COPIES = 4096


def leaves(text: Column) -> Column:
    """Nested arrays: sections of paragraphs of leaf hashes."""
    return F.transform(
        F.split(text, "\n\n", -1),
        lambda section: F.transform(
            F.split(section, "\n", -1),
            lambda paragraph: F.transform(
                F.regexp_extract_all(paragraph, F.lit(PHRASE), F.lit(0)), lambda phrase: F.substring(F.md5(phrase.cast("binary")), 1, 8)
            ),
        ),
    )


def _with_tree(df: DataFrame, text: str, out: str) -> DataFrame:
    """*df* with ``out`` (the fingerprint) and ``_quillon_out_leaves`` (its leaf set)."""
    md5 = lambda parts: F.md5(F.array_join(parts, "").cast("binary"))
    df = df.withColumn("_quillon_l", leaves(F.col(text)))
    df = df.withColumn("_quillon_p", F.transform("_quillon_l", lambda s: F.transform(s, md5)))
    df = df.withColumn("_quillon_s", F.transform("_quillon_p", md5))
    written = F.transform(
        F.sequence(F.lit(0), F.size("_quillon_s") - 1),
        lambda i: F.concat(
            F.substring(F.get("_quillon_s", i), 1, 8),
            F.lit(":"),
            F.array_join(
                F.zip_with(F.get("_quillon_p", i), F.get("_quillon_l", i), lambda p, l: F.concat(F.substring(p, 1, 8), F.lit("="), F.array_join(l, ""))), ";"
            ),
        ),
    )
    df = df.withColumn(out, F.concat(md5(F.col("_quillon_s")), F.lit("/"), F.array_join(written, "|")))
    return df.withColumn(f"_quillon_{out}_leaves", F.array_distinct(F.flatten(F.flatten("_quillon_l")))).drop("_quillon_l", "_quillon_p", "_quillon_s")


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    shared = F.size(F.array_intersect(leaves_a, leaves_b)) * 2.0
    total = F.size(leaves_a) + F.size(leaves_b)
    return F.when(root_a == root_b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(shared / total)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """*df* with the fingerprint of *text* (null: empty) in *out*."""
    return _with_tree(df.withColumn("_quillon_text", text_or_empty(text)), "_quillon_text", out).drop("_quillon_text", f"_quillon_{out}_leaves")


def differing_sections(a: str, b: str) -> Column:
    """Indices from 0 of the sections of fingerprint column *a* that *b* does not hold: where the edit lies."""
    sections = lambda c: F.transform(F.split(F.element_at(F.split(F.col(c), "/"), 2), r"\|"), lambda s: F.substring_index(s, ":", 1))
    return F.filter(
        F.transform(sections(a), lambda s, i: F.when(~F.array_contains(sections(b), s), i)), lambda i: i.isNotNull()
    )


def _range_of(key: Column, starts: list[int]) -> Column:
    """The number of the range that holds *key*: the last start not above it, found in two steps."""
    coarse = F.size(F.filter(F.array(*[F.lit(x) for x in starts[::STEP]]), lambda s: s <= key)) - 1
    within = F.filter(F.slice(F.array(*[F.lit(x) for x in starts]), coarse * STEP + 1, F.lit(STEP)), lambda s: s <= key)
    return coarse * STEP + F.size(within) - 1


def _shares(docs: DataFrame) -> tuple[list[int], list[int]]:
    """Range starts, which are ids, and for each the ranges its id calls for: above 1 where one id fills several."""
    n = int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    n = max(MIN_RANGES, min(MAX_RANGES, n))
    got = docs.agg(F.percentile_approx("_k", [i / n for i in range(n)], 10 * n), F.min("_k")).first()
    share = Counter(got[0] or [0])
    if got[0]:
        share[got[1]] += got[1] not in share
    starts = sorted(share)
    return starts, [share[k] for k in starts]


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), at + 1)


def _split_hot(docs: DataFrame, starts: list[int], shares: list[int]) -> tuple[DataFrame, list[int], list[str | None]]:
    """*docs* with ``_own`` (range), and the id and least md5 (None: any text) that open each range which holds rows.

    The rows of an id that fills several ranges are cut by their texts' md5, so that no id is one task; its copies of
    one text are one row, whose ``_n`` counts them.
    """
    base = [0]
    for m in shares:
        base.append(base[-1] + (m + 1 if m > 1 else 1))  # a hot id's ranges, and one for the ids after it
    docs = docs.withColumn("_at", _range_of(F.col("_k"), starts))
    hot = (_pick(shares, F.col("_at")) > 1) & (_pick(starts, F.col("_at")) == F.col("_k"))
    one = docs.where(~hot).withColumn("_n", F.lit(1).cast("long"))
    many = docs.where(hot).groupBy("doc_id", "text", "_k", "_at").agg(F.count(F.lit(1)).alias("_n"))
    docs = one.unionByName(many)
    m, from_ = _pick(shares, F.col("_at")), _pick(base, F.col("_at"))
    prefix = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    part = F.when(m == 1, 0).when(F.col("_k") > _pick(starts, F.col("_at")), m).otherwise(F.shiftright(prefix * m, 32).cast("int"))
    docs = docs.withColumn("_h", F.md5(F.col("text").cast("binary"))).withColumn("_own", (from_ + part).cast("int"))
    found = docs.where(m > 1).groupBy("_own").agg(F.min(F.struct("_k", "_h")).alias("f")).collect()  # at most 2 n rows
    opens = {r["_own"]: (r["f"]["_k"], r["f"]["_h"]) for r in found}
    opens |= {base[i]: (starts[i], None) for i, m in enumerate(shares) if m == 1}
    number = {own: k for k, own in enumerate(sorted(opens))}
    dense = [number.get(k, -1) for k in range(base[-1])]
    docs = docs.withColumn("_own", _pick(dense, F.col("_own"))).drop("_at")
    firsts = [opens[own] for own in sorted(opens)]
    return docs, [k for k, _ in firsts], [h for _, h in firsts]


def with_next(df: DataFrame) -> DataFrame:
    """doc_id, text and ``_next`` (text, fingerprint and leaves), by ascending id; the first follows the last.

    Ids are cut into ranges at quantiles that are ids themselves, and an id that fills several ranges is cut further by
    its texts' md5.  A range's first document also goes to the range before it as a guard, so each range is sorted on
    its own and no window spans the table.  If there is a column ``_times``, it says for how many equal rows a row stands.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("_k", key)
    starts, shares = _shares(docs)
    hot = max(shares) > 1
    if hot:
        docs, starts, least = _split_hot(docs, starts, shares)
    else:
        docs = docs.withColumn("_own", _range_of(F.col("_k"), starts)).withColumn("_n", F.lit(1).cast("long"))
    last = len(starts) - 1
    opens = _pick(starts, F.col("_own")) == F.col("_k")
    if hot:
        first = _pick(least, F.col("_own")).cast("string")
        opens = opens & (first.isNull() | (first == F.col("_h")))
    guard = F.when(F.col("_own") == 0, F.lit(last)).otherwise(F.col("_own") - 1)
    places = F.when(opens, F.array(F.struct(F.col("_own").alias("r"), F.lit(0).alias("g")), F.struct(guard.alias("r"), F.lit(1).alias("g")))).otherwise(
        F.array(F.struct(F.col("_own").alias("r"), F.lit(0).alias("g")))
    )
    dealt = docs.withColumn("_at", F.explode(places)).select("doc_id", "text", "_k", "_n", F.col("_at.r").alias("_r"), F.col("_at.g").alias("_g"))
    dealt = _with_tree(dealt.repartition("_r"), "text", "fingerprint")
    order = Window.partitionBy("_r").orderBy("_g", "_k", F.md5(F.col("text").cast("binary")))
    own = F.struct("text", "fingerprint", "_quillon_fingerprint_leaves")
    rows = dealt.withColumn("_next", F.lead(own).over(order)).where("_g = 0").drop("_g", "_r", "_k")
    if not hot:
        return rows.drop("_n")
    # All copies but the last are followed by a copy of themselves.
    both = F.array(F.struct(F.col("_next").alias("next"), F.lit(1).cast("long").alias("times")), F.struct(own.alias("next"), (F.col("_n") - 1).alias("times")))
    rows = rows.withColumn("_both", F.explode(F.filter(both, lambda x: x["times"] > 0)))
    return rows.withColumn("_next", F.col("_both.next")).withColumn("_times", F.col("_both.times")).drop("_both", "_n")


def _unfolded(df: DataFrame) -> DataFrame:
    """*df* with each row ``_times`` times, in blocks, so that no task writes all copies of a hot row."""
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / COPIES))
    df = df.withColumn("_block", F.explode(blocks)).repartition("doc_id", "edited_sha256", "_block")
    left = F.least(F.col("_times") - F.col("_block") * COPIES, F.lit(COPIES)).cast("int")
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), left))).drop("_copy", "_block", "_times")


def fingerprint_edits(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document.
    """
    rows = with_next(df).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.col("_next.text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    rows = _with_tree(rows, "edited", "edited_fingerprint")
    root = lambda c: F.substring(c, 1, 32)
    own = (root(F.col("fingerprint")), F.col("_quillon_fingerprint_leaves"))
    found = rows.select(
        *([] if "_times" not in rows.columns else ["_times"]), "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(*own, root(F.col("edited_fingerprint")), F.col("_quillon_edited_fingerprint_leaves")).alias("near_edited"),
        likeness(*own, root(F.col("_next.fingerprint")), F.col("_next._quillon_fingerprint_leaves")).alias("near_next"),
    )
    return _unfolded(found) if "_times" in found.columns else found
