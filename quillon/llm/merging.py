"""Three-way merge of document branches as a semilattice reduction.

A document is a set of units: its columns, its lines and the gaps after its lines.  Every version names states of units:
the base all of them, a branch those that it changes.  States of one unit and version are ordered, and two of them
combine to the greater one, which is associative, commutative and idempotent; so a grouped aggregation folds all states
of a unit into its version triple (base, left, right) in any order, partly before rows move.  A triple is finalised on
its own: a change on one side or the same on both is clean, others are one conflict that keeps the base's state.
Merged units are combined to fragments of FAN neighbours, fragments to larger ones, and these to documents.

Texts move once: rows are folded by document, and all further levels group by the document and something more, so they
stay where they are.  Sorts spill; a task holds a fragment, or the merged text of one document, at a time.

Units are tables of UNIT_SCHEMA.  ``place`` orders a document's units: ROW, SOURCE and LANG are negative, line k is
2k and the gap after it 2k + 1.  ``value`` null says that the unit is absent: a line or a row that is dropped.

Defined results: nulls in text, lang and source are empty; a text without lines is one empty line.  Rows that share an
id are states of one document: equal ones count once, of different ones the greatest (text, lang, source) is the base,
and rows without an id are one document.  A row added under an id that base holds is an insert-insert conflict, and
base's row is merged as if nothing were added.  The right branch adds nothing to the id 2^63 - 1, as no id is two below
its complement, and no branch adds a row to the document without an id.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of the units that are no lines.
ROW, SOURCE, LANG = -3, -2, -1
BASE, LEFT, RIGHT = "B", "L", "R"
#: Units in a fragment of the lowest level, and fragments in one of the next.
FAN = 256
UNIT_SCHEMA = "doc_id long, place long, branch string, value string"
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def _state(branch: str, value: Column) -> Column:
    """A state that the fold orders: absence is less than any text."""
    return F.struct(F.lit(branch).alias("branch"), value.cast("string").alias("value"))


def _at(place: Column | int, *states: Column) -> Column:
    place = F.lit(place) if isinstance(place, int) else place
    return F.struct(place.cast("long").alias("place"), F.array(*states).alias("states"))


def base_rows(docs: DataFrame) -> DataFrame:
    """One row of doc_id, text, lang, source for each id: the join of all rows that share it."""
    full = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*full).alias("row"))
    return rows.groupBy("doc_id").agg(F.max("row").alias("row")).select("doc_id", "row.*")


def base_units(docs: DataFrame) -> DataFrame:
    """The base version of :func:`base_rows` as units."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, k: _at(2 * k, _state(BASE, x)))
    fixed = F.array(_at(ROW, _state(BASE, F.lit(""))), _at(SOURCE, _state(BASE, F.col("source"))), _at(LANG, _state(BASE, F.col("lang"))))
    return _unfolded(base_rows(docs).select("doc_id", F.concat(fixed, lines).alias("units")))


def _unfolded(rows: DataFrame) -> DataFrame:
    one = rows.select("doc_id", F.explode("units").alias("unit")).select("doc_id", "unit.place", F.explode("unit.states").alias("state"))
    return one.select("doc_id", "place", "state.*")


def triples(units: DataFrame) -> DataFrame:
    """The fold: doc_id, place, block and for each version the greatest of its states, null where it names none."""
    held = lambda b: F.max(F.when(F.col("branch") == b, F.struct("value")))
    block = F.greatest(F.floor(F.col("place") / (2 * FAN)), F.lit(0))
    return units.withColumn("block", block).groupBy("doc_id", "block", "place").agg(*[held(b).alias(b) for b in (BASE, LEFT, RIGHT)])


def _finalised(folded: DataFrame) -> DataFrame:
    """Each triple's merged value, whether a side changes it, and its part of the counts."""
    base, left, right = (F.col(b) for b in (BASE, LEFT, RIGHT))
    change = lambda side: side.isNotNull() & ~side["value"].eqNullSafe(base["value"])  # noqa: E731  a gap's base is absent
    by_left, by_right = change(left), change(right)
    both, same = by_left & by_right, left["value"].eqNullSafe(right["value"])
    conflict = both & ~same
    gap = base.isNull()
    deleted = left["value"].isNull() | right["value"].isNull()
    kind = F.when(gap, "n_insert_insert").when(deleted, "n_edit_delete").otherwise("n_edit_edit")
    merged = F.when(conflict, base["value"]).when(by_left, left["value"]).when(by_right, right["value"]).otherwise(base["value"])
    return folded.select(
        "doc_id", "block", "place", merged.alias("value"), base["value"].alias("base_value"), by_left.alias("by_left"), by_right.alias("by_right"),
        F.when(conflict, kind).when(by_left | by_right, "n_clean").alias("counted"),
        (by_left & left["value"].isNull()).alias("gone_left"), (by_right & right["value"].isNull()).alias("gone_right"),
    )


def _joined_text(parts: str) -> Column:
    """Texts of the ordered structs in *parts*, less those that hold no line, by line ends; null where no line is left."""
    kept = F.filter(F.array_sort(parts), lambda x: x["text"].isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: x["text"]), "\n"))


def merge(units: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """The merged documents: doc_id, present, text, lang, source and the COUNTS.

    *units* are the base's units and those that the branches change; *added* (doc_id, branch, text, lang, source) the
    rows that a branch adds.  A branch that drops a row has a state of ROW without a value: that counts alone, as a
    conflict which keeps the base's row where the other branch keeps and changes it.
    """
    done = _finalised(triples(units))
    line = F.col("place") >= 0
    of = lambda place, what: F.max(F.when(F.col("place") == place, F.col(what)))
    text = lambda what: F.collect_list(F.when(line, F.struct("place", F.col(what).alias("text"))))
    counts = [F.count_if(F.col("counted").eqNullSafe(c) & (F.col("place") != ROW)).alias(c) for c in COUNTS]
    touched = lambda side: F.max(F.col(side) & (F.col("place") != ROW))
    levels = done.groupBy("doc_id", "block").agg(
        text("value").alias("lines"), text("base_value").alias("base_lines"), touched("by_left").alias("by_left"), touched("by_right").alias("by_right"), *counts,
        *[of(place, what).alias(f"{what}{-place}") for place in (SOURCE, LANG) for what in ("value", "base_value")],
        *[of(ROW, what).alias(what) for what in ("gone_left", "gone_right", "base_value")],
    )
    some = lambda c: F.coalesce(F.max(c), F.lit(False)).alias(c)
    sums = [F.sum(c).alias(c) for c in COUNTS]
    flags = [some(c) for c in ("by_left", "by_right", "gone_left", "gone_right")]
    fixed = [F.max(c).alias(c) for c in ("value1", "base_value1", "value2", "base_value2", "base_value")]
    fragment = levels.select(
        "doc_id", "block", _joined_text("lines").alias("text"), _joined_text("base_lines").alias("base_text"), *[c for c in levels.columns if c not in ("doc_id", "block", "lines", "base_lines")]
    )
    parts = lambda order, c: F.collect_list(F.struct(order, F.col(c).alias("text")))
    # Fragments to spans of FAN fragments, and spans to the document.
    for order, keys in (("block", ["doc_id", "span"]), ("span", ["doc_id"])):
        grown = fragment.withColumn("span", F.floor(F.col("block") / FAN)) if order == "block" else fragment
        both = grown.groupBy(*keys).agg(parts(order, "text").alias("t"), parts(order, "base_text").alias("b"), *flags, *sums, *fixed)
        fragment = both.withColumns({"text": _joined_text("t"), "base_text": _joined_text("b")}).drop("t", "b")

    gone = F.col("gone_left") | F.col("gone_right")
    fought = (F.col("gone_left") & ~F.col("gone_right") & F.col("by_right")) | (F.col("gone_right") & ~F.col("gone_left") & F.col("by_left"))
    present = ~gone | fought
    alone = {"n_clean": F.when(fought, 0).otherwise(1), "n_edit_edit": F.lit(0), "n_edit_delete": F.when(fought, 1).otherwise(0), "n_insert_insert": F.lit(0)}
    pick = lambda new, old: F.when(~gone, F.coalesce(F.col(new), F.lit(""))).when(fought, F.coalesce(F.col(old), F.lit("")))
    merged = fragment.select(
        "doc_id", present.alias("present"), pick("text", "base_text").alias("text"), pick(f"value{-LANG}", f"base_value{-LANG}").alias("lang"), pick(f"value{-SOURCE}", f"base_value{-SOURCE}").alias("source"),
        *[F.when(gone, alone[c]).otherwise(F.col(c)).cast("long").alias(c) for c in COUNTS],
    )
    return merged if added is None else _with_added(merged, merge_added(added))


def merge_added(added: DataFrame) -> DataFrame:
    """Rows that branches add, folded by their ids: a, the row that is added, null where the branches disagree."""
    state = F.struct("text", "lang", "source")
    sides = added.groupBy("doc_id").agg(*[F.max(F.when(F.col("branch") == b, state)).alias(b) for b in (LEFT, RIGHT)])
    one = F.when(F.col(LEFT).isNull() | F.col(RIGHT).isNull() | (F.col(LEFT) == F.col(RIGHT)), F.coalesce(LEFT, RIGHT))
    return sides.select("doc_id", one.alias("a"))


def _with_added(merged: DataFrame, rows: DataFrame) -> DataFrame:
    """Both tables by id; they share few ids or none, and the rows that are added are short."""
    rows = rows.select(F.col("doc_id").alias("_new"), "a")
    every = merged.join(rows, F.col("doc_id") == F.col("_new"), "full_outer")
    old, new, clean = F.col("present").isNotNull(), F.col("_new").isNotNull(), F.col("a").isNotNull()
    column = lambda c: F.when(old, F.col(c)).otherwise(F.col("a")[c]).alias(c)
    return every.select(
        F.when(new, F.col("_new")).otherwise(F.col("doc_id")).alias("doc_id"), F.coalesce("present", clean).alias("present"), column("text"), column("lang"), column("source"),
        (F.coalesce("n_clean", F.lit(0)) + (new & clean & ~old).cast("long")).alias("n_clean"), F.coalesce("n_edit_edit", F.lit(0)).cast("long").alias("n_edit_edit"),
        F.coalesce("n_edit_delete", F.lit(0)).cast("long").alias("n_edit_delete"), (F.coalesce("n_insert_insert", F.lit(0)) + (new & (old | ~clean)).cast("long")).alias("n_insert_insert"),
    )


def digest(merged: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_sha256 and the counts; an absent document has nulls."""
    return merged.select("doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), *COUNTS)


def _code(branch: str, name: Column) -> Column:
    return F.crc32(F.concat_ws(":", F.lit(branch), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), name.cast("string")).cast("binary")) % 11


def _edited(code: Column, value: Column, dropped: Column) -> Column:
    return F.when(code == 0, dropped).when(code == 1, F.concat(value, F.lit("!"))).when(code == 2, F.concat(value, F.lit("?")))


def coded_branches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The base's units with those that two made-up branches change, and the rows that these add.

    A branch's change of a unit follows from crc32 of ``branch:doc_id:name`` modulo 11: 0 drops (a column: empties), 1 appends
    ``!`` and 2 ``?``, 3 and 4 insert such a line after a line, or add such a row beside a row.
    """
    base, sides = base_rows(docs), (LEFT, RIGHT)
    nothing = F.lit(None).cast("string")

    def column(place: int, name: str) -> Column:
        value = F.col(name)
        codes = [_code(b, F.lit(name)) for b in sides]
        changed = [F.when(c.isin(0, 1, 2), _state(b, _edited(c, value, F.lit("")))) for b, c in zip(sides, codes)]
        return _at(place, _state(BASE, value), *changed)

    # Codes of a line are found once; a state is null where the branch leaves the unit alone.
    lines = F.transform(F.split("text", "\n", -1), lambda x, k: F.struct(x.alias("x"), k.alias("k"), *[_code(b, k).alias(b) for b in sides]))
    as_units = F.transform(lines, lambda u: _at(2 * u["k"], _state(BASE, u["x"]), *[F.when(u[b] <= 2, _state(b, _edited(u[b], u["x"], nothing))) for b in sides]))
    inserted = lambda c: F.when(c == 3, "!").when(c == 4, "?")
    gaps = F.transform(F.filter(lines, lambda u: u[LEFT].isin(3, 4) | u[RIGHT].isin(3, 4)), lambda u: _at(2 * u["k"] + 1, *[F.when(u[b].isin(3, 4), _state(b, inserted(u[b]))) for b in sides]))
    row = _at(ROW, _state(BASE, F.lit("")), *[F.when(_code(b, F.lit("row")) == 0, _state(b, nothing)) for b in sides])
    units = _unfolded(base.select("doc_id", F.concat(F.array(row, column(SOURCE, "source"), column(LANG, "lang")), as_units, gaps).alias("units"))).where("branch is not null")

    low = F.lit(-(2**63))
    ids = {LEFT: F.bitwise_not("doc_id"), RIGHT: F.when(F.bitwise_not("doc_id") > low, F.bitwise_not("doc_id") - 1)}
    new = [F.when(_code(b, F.lit("row")).isin(3, 4), F.struct(ids[b].alias("doc_id"), F.lit(b).alias("branch"), inserted(_code(b, F.lit("row"))).alias("text"), "lang", "source")) for b in sides]
    added = base.select(F.explode(F.array(*new)).alias("n")).where("n.doc_id is not null").select("n.*")
    return units, added


def merge_coded(docs: DataFrame) -> DataFrame:
    """The digest of *docs* merged with both branches of :func:`coded_branches`."""
    return digest(merge(*coded_branches(docs)))
