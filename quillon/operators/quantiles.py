"""Exact quantiles of groups of any size.

A KLL sketch of each group bounds the values that hold a wanted rank; a second pass counts the rows below the bounds and
sketches those between.  Where these are still more than INSIDE, the bounds are narrowed again, each time to a share of a
hundredth or so.  What is left is counted by value and its running count gives the value of the rank.  Sketches, counts
and bounds are partial aggregations; a group's values are never gathered, and equal values are one row before they move.

Bounds are checked against the counts: where a sketch has missed a rank, its bounds are widened and the pass repeated.

Defined results: null and NaN values are left out; a group without others has no row.  Values are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.layout import beside, sent
from quillon.sources.tables import staged

#: Size of a sketch, the share of ranks that bounds leave on either side, rows between bounds, and rounds of narrowing.
SKETCH, SLACK, INSIDE, ROUNDS = 800, 0.01, 100_000, 6
#: Shares at which a sketch is asked.
GRID = 200

LINEAR, LOWER = "linear", "lower"


def _wanted(probs: list[float], kind: str) -> Column:
    """(i, half, r): ranks from 0 that the probabilities need in a group of n; linear ones lie between two."""
    out = []
    for i, p in enumerate(probs):
        if kind == LOWER:
            out.append(F.struct(F.lit(i).alias("i"), F.lit(0).alias("half"), F.greatest(F.ceil(F.lit(float(p)) * F.col("n")) - 1, F.lit(0)).cast("long").alias("r")))
        else:
            at = F.lit(float(p)) * (F.col("n") - 1)
            out += [F.struct(F.lit(i).alias("i"), F.lit(h).alias("half"), f(at).cast("long").alias("r")) for h, f in ((0, F.floor), (1, F.ceil))]
    return F.array(*out)


def _bounds(sketch: Column, r: Column, n: Column, slack: float) -> tuple[Column, Column]:
    """Values of the sketch at the marks of a fixed grid of shares beside the rank."""
    marks = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]))
    low, high = F.floor((r / n - slack) * GRID), F.ceil(((r + 1) / n + slack) * GRID)
    at = lambda k: F.get(marks, k.cast("int"))
    return F.when(low <= 0, float("-inf")).otherwise(at(low)), F.when(high >= GRID, float("inf")).otherwise(at(high))


def _meet(rows: DataFrame, bounds: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each row beside the bounds of its group; these are sent to the tasks while they are few, so a group may hold all rows."""
    if not keys:
        return rows.crossJoin(F.broadcast(bounds))  # as many rows as ranks
    return beside(rows, sent(bounds), *keys)


def quantiles(df: DataFrame, value: str | Column, probs: list[float], *keys: str, kind: str = LINEAR, out: str = "quantiles", inside: int = INSIDE) -> DataFrame:
    """keys and *out*: the exact quantiles of *value* in each group, in the order of *probs*.

    ``linear`` interpolates between neighbouring ranks at p (n - 1), ``lower`` takes the first value whose share of rows
    up to it reaches p.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    sketched = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_x", F.lit(SKETCH)).alias("_s"))
    many = sketched.where("n > 0").select(*keys, "n", "_s", F.explode(_wanted(probs, kind)).alias("w")).select(*keys, "n", "_s", "w.*")
    low, high = _bounds(F.col("_s"), F.col("r"), F.col("n"), SLACK)
    bounds = staged(many.select(*keys, "n", "i", "half", "r", low.alias("a"), high.alias("b")), "bounds")
    slack = SLACK
    for _ in range(ROUNDS):
        between = F.col("_x").between(F.col("a"), F.col("b"))
        met = _meet(rows, bounds, keys).groupBy(*keys, "i", "half").agg(
            *[F.first(c).alias(c) for c in ("n", "r", "a", "b")], F.count_if(F.col("_x") < F.col("a")).alias("below"), F.count_if(between).alias("inside"),
            F.kll_sketch_agg_double(F.when(between, F.col("_x")), F.lit(SKETCH)).alias("_s"),
        )
        met = staged(met, "bounds")
        missed = (F.col("r") < F.col("below")) | (F.col("r") >= F.col("below") + F.col("inside"))
        wide = (F.col("inside") > inside) & (F.col("a") < F.col("b"))
        n_missed, n_wide = met.agg(F.count_if(missed), F.count_if(~missed & wide)).first()
        bounds = met
        if not n_missed and not n_wide:
            break
        low, high = _bounds(F.col("_s"), F.col("r") - F.col("below"), F.greatest(F.col("inside"), F.lit(1)), slack)
        narrow = lambda new, old: F.when(missed, None).when(wide & ~F.isnull(new), new).otherwise(old)
        a, b = F.greatest(narrow(low, F.col("a")), F.col("a")), F.least(narrow(high, F.col("b")), F.col("b"))
        slack *= 2
        bounds = staged(met.select(*keys, "n", "i", "half", "r", F.when(missed, float("-inf")).otherwise(a).alias("a"), F.when(missed, float("inf")).otherwise(b).alias("b")), "bounds")
    if "below" not in bounds.columns:  # the last round has narrowed once more
        met = _meet(rows, bounds, keys).groupBy(*keys, "i", "half").agg(*[F.first(c).alias(c) for c in ("n", "r", "a", "b")], F.count_if(F.col("_x") < F.col("a")).alias("below"))
        bounds = staged(met, "bounds")
    counted = _meet(rows, bounds.select(*keys, "i", "half", "n", "r", "a", "b", "below"), keys).where(F.col("_x").between(F.col("a"), F.col("b")))
    counted = counted.groupBy(*keys, "i", "half", "_x").agg(F.count(F.lit(1)).alias("_c"), F.first("n").alias("n"), F.first("r").alias("r"), F.first("below").alias("below"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "i", "half").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("_upto", F.col("below") + upto)
    found = placed.where((F.col("_upto") > F.col("r")) & (F.col("_upto") - F.col("_c") <= F.col("r")))
    part = F.lit(0.0) if kind == LOWER else F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1) * (F.col("n") - 1) - F.floor(F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1) * (F.col("n") - 1))
    pick = lambda h: F.max(F.when(F.col("half") == h, F.col("_x")))
    each = found.groupBy(*keys, "i").agg(pick(0).alias("x0"), pick(1).alias("x1"), F.max(part).alias("f"))
    value_at = F.col("x0") if kind == LOWER else F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("f")
    listed = each.select(*keys, "i", value_at.alias("q")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("_q"))
    return listed.select(*keys, F.col("_q.q").alias(out))
