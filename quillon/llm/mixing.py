"""Time-varying curriculum mixing (native).

Each source has a weight schedule over training time t in [0, 1], here a ramp w * (1 + r * (2t - 1)) whose mean is
its weight w.  The integral of the schedule, scaled to the source's target, is the number of words the training run
demands from the source up to t.  A source's documents, in seeded order and laid end to end as often as needed, meet
that demand: a copy whose middle lies at c words gets the position t at which the demand reaches c (the inverse of
the integral), and the run is the range-sort of all copies by position.

The run takes the words of this tape up to the target, rounded to whole words.  The document at the cut is taken up to
there, in its last copy, so every source meets its target exactly, however few documents it has.

Defined results: a null text has size 0; a text without words is never drawn; null is a source of its own, after all
others; a source without words has target 0; repeated rows are numbered and mixed one by one; an empty table gives an
empty result; every other column is ignored by :func:`mix` and kept by :func:`training_order`, also where rows differ
in nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, null_safe_join, numbered, staged, text_or_empty

SEED = 1729
MAX_REPEATS = 3
#: Weights of the sources in code point order, repeating, and the ramp r of each one's schedule.
WEIGHTS = (1, 2, 3)
RAMPS = (-0.5, 0.0, 0.5)
#: Documents to a slice of the seeded order, about; the words before a document are summed in two levels.
SLICE_ROWS = 1000
#: Up to so many sources the table of sources is sent to all tasks; beyond, it is joined by shuffling, with the same rows.
BROADCAST_SOURCES = 50_000
_KEYS = ["doc_id", "source", "size", "text_md5"]


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(f"[^{SPACE}]+")).cast("long")


def _rest(df: DataFrame) -> Column:
    """A hash of the columns that do not count for the mix; it tells rows apart that are equal otherwise."""
    others = [c for c in df.columns if c not in ("doc_id", "source", "text")]
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]))) if others else F.lit(0).cast("long")


def _documents(df: DataFrame, rest: Column | None) -> DataFrame:
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(text_or_empty()).alias("size"),
        F.md5(text_or_empty().cast("binary")).alias("text_md5"),
        *([] if rest is None else [rest.alias("rest")]),
    )
    return numbered(rows, _KEYS) if rest is None else numbered(rows, _KEYS, "rest")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_REPEATS) -> DataFrame:
    """*sizes* (source, source_size) with rank, weight and target; targets stop at *most* times the source's size.

    The excess goes to the other sources by weight until none is above: each round fixes the sources above their cap
    and recomputes the level from two sums, so the driver holds two numbers.  One row per source meets in one window
    for the ranks; that table is as long as there are sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = staged(ranked.withColumn("weight", pick), "mix-sources")
    cap = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        below = F.col("weight") * level <= cap if capped >= 0 else F.lit(True)
        free, fixed, n = ranked.agg(
            F.sum(F.when(below, F.col("weight"))), F.sum(F.when(~below, cap)), F.count(F.when(~below, 1))
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (total - (fixed or 0)) / free
    return ranked.withColumn("target", F.least(F.col("weight") * level, cap.cast("double")))


def mix(
    df: DataFrame, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, seed: int = SEED, most: int = MAX_REPEATS
) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, and source, copies, first_position, text_md5, copy.

    *copies* is how often the run draws the document, *first_position* its first place in [0, 1] (null if none).
    """
    return _mixed(df, None, weights, ramps, seed, most)


def _mixed(df: DataFrame, rest: Column | None, weights: tuple[float, ...], ramps: tuple[float, ...], seed: int, most: int) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_md5", F.col("copy").cast("string")))
    docs = staged(_documents(df, rest).withColumn("key", key), "mix-documents")
    n_slices = max(1, docs.count() // SLICE_ROWS)
    docs = docs.withColumn("slice", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n_slices / (1 << 32)))
    slices = docs.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    slices = staged(slices, "mix-slices")
    sources = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = slices.select("source", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "slice").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    laid = docs.withColumn("start", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    laid = null_safe_join(laid, bases, ["source", "slice"]).withColumn("start", F.col("base") + F.col("start")).drop("base", "slice")
    laid = null_safe_join(laid, F.broadcast(sources) if few else sources, ["source"])
    words = [_words(F.lit(r)) for r in range(most)]
    laid = laid.withColumns({"taken": reduce(lambda a, b: a + b, words), "copies": reduce(lambda a, b: a + b, [(w > 0).cast("long") for w in words])})
    ramp = F.element_at(F.array(*[F.lit(float(r)) for r in ramps]), (F.pmod("rank", F.lit(len(ramps))) + 1).cast("int"))
    laid = laid.withColumn("ramp", ramp)
    return laid.select(
        "doc_id", "size", "source_size", "target", "taken",
        "source", "copies", F.when(F.col("copies") > 0, position(F.lit(0))).alias("first_position"), "text_md5", "copy", "start", "ramp", *([] if rest is None else ["rest"]),
    )


def _words(repeat: Column) -> Column:
    """How many words of this copy of the document lie before the cut."""
    cut = F.floor(F.col("target") + 0.5)
    return F.greatest(F.lit(0), F.least(F.col("size"), cut - F.col("start") - repeat * F.col("source_size"))).cast("long")


def position(repeat: Column) -> Column:
    """The training time at which the demand for the source reaches the middle of this copy of the document.

    The share of the target drawn up to t is (1 - r) * t + r * t^2; *u* is the share at the middle of the copy.
    """
    middle = F.col("start") + _words(repeat) / 2 + repeat * F.col("source_size")
    u = F.when(F.col("target") > 0, F.least(F.lit(1.0), middle / F.col("target"))).otherwise(F.lit(0.0))
    r = F.col("ramp")
    root = F.sqrt(F.pow(1 - r, F.lit(2)) + 4 * r * u)
    return F.when(r == 0, u).otherwise(F.try_divide(root - (1 - r), 2 * r))


def first_words(text: Column, n: Column) -> Column:
    """The first *n* words of *text*, with the white space before them."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def training_order(
    df: DataFrame, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, seed: int = SEED, most: int = MAX_REPEATS
) -> DataFrame:
    """The run itself: a row of *df* for each drawn copy, with ``_quillon_position``, range-sorted by it.

    The copy at a source's cut has the words before the cut; n_chars, where there is one, follows the text.
    """
    drawn = _mixed(df, _rest(df), weights, ramps, seed, most).where("copies > 0")
    drawn = drawn.withColumn("_repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    name = lambda i, s, m, r: F.md5(F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), F.base64(F.coalesce(s.cast("binary"), F.lit("?").cast("binary"))), s.isNull().cast("string"), m, r.cast("string")))
    words = _words(F.col("_repeat"))
    drawn = drawn.select(
        name(F.col("doc_id"), F.col("source"), F.col("text_md5"), F.col("rest")).alias("_quillon_row"), position(F.col("_repeat")).alias("_quillon_position"),
        F.when(words < F.col("size"), words).alias("_quillon_cut"),
    )
    own = name(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.md5(text_or_empty().cast("binary")), _rest(df))
    # Rows that are equal in every column are drawn one by one, so one of them stands for all; both steps deal the texts out by one key.
    own = df.withColumn("_quillon_row", own).dropDuplicates(["_quillon_row"])
    run = own.join(drawn.hint("merge"), "_quillon_row").drop("_quillon_row")
    cut = F.col("_quillon_cut").isNotNull()
    run = run.withColumn("text", F.when(cut, first_words(F.col("text").cast("string"), F.col("_quillon_cut"))).otherwise(F.col("text")))
    if "n_chars" in df.columns:
        run = run.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(df.schema["n_chars"].dataType))
    return run.drop("_quillon_cut").orderBy("_quillon_position")
