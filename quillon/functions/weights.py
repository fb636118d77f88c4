"""Token weights: formulas, normalisations, methods, sum modes and importance mixing.

Registries map names to column builders; an unknown name raises ``ValueError`` when the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import at_least, sigmoid

SLOPE = 1.0
TEMPERATURE = 0.1


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


#: WF1-WF12 over c (cosine), p (dot) and pn (dot over the largest absolute dot of its example).
FORMULAS = {
    "token_scale": lambda c, p, pn: _clamped((1 - c) / 2),
    "exp_half": lambda c, p, pn: F.exp(1 - c) / 2,
    "exp_m1": lambda c, p, pn: F.exp(1 - c) - 1,
    "dist_sq": lambda c, p, pn: (1 - c) * (1 - c) / 2,
    "sigmoid_c": lambda c, p, pn: sigmoid(-SLOPE * c),
    "one_minus_c": lambda c, p, pn: 1 - c,
    "raw_cos": lambda c, p, pn: c,
    "raw_dot": lambda c, p, pn: p,
    "norm_dot": lambda c, p, pn: pn,
    "neg_dot": lambda c, p, pn: -p,
    "dot_scale": lambda c, p, pn: _clamped((1 - pn) / 2),
    "sigmoid_dot": lambda c, p, pn: sigmoid(-SLOPE * pn),
}

NORMS = ("none", "softmax", "l1")

#: Named pairs of a formula and a normalisation.
METHODS = {name: (name, "none") for name in FORMULAS if name not in ("one_minus_c", "neg_dot")} | {
    "sigmoid": ("sigmoid_c", "none"),
    "altcos": ("one_minus_c", "softmax"),
    "altdot": ("neg_dot", "softmax"),
}

SUM_MODES = ("normalize", "token_count", "reward_match", "token_scale", "ignore")


def lookup(registry, name: str):
    if name not in registry:
        raise ValueError(f"unknown name {name!r}; known: {', '.join(registry)}")
    return registry[name] if isinstance(registry, dict) else name


def formula(name: str, c: str = "c", p: str = "p", pn: str = "pn") -> Column:
    return lookup(FORMULAS, name)(F.col(c), F.col(p), F.col(pn))


def normalised(raw: str, norm: str, *keys: str, temperature: float = TEMPERATURE) -> Column:
    """*raw* normalised within *keys* (W4, W5); the l1 sum is signed and clamped."""
    lookup(NORMS, norm)
    x, w = F.col(raw), Window.partitionBy(*keys)
    if norm == "softmax":
        e = F.exp((x - F.max(x).over(w)) / temperature)
        return e / F.sum(e).over(w)
    return x / at_least(F.sum(x).over(w)) if norm == "l1" else x


def with_scores(df: DataFrame, *keys: str, p: str = "p", out: str = "pn") -> DataFrame:
    """The dot over the largest absolute dot of its example."""
    return df.withColumn(out, F.col(p) / at_least(F.max(F.abs(F.col(p))).over(Window.partitionBy(*keys))))


def method(df: DataFrame, name: str, *keys: str, out: str = "w") -> DataFrame:
    kind, norm = lookup(METHODS, name)
    return df.withColumn("_raw", formula(kind)).withColumn(out, normalised("_raw", norm, *keys)).drop("_raw")


def methods(df: DataFrame, names: list[str], *keys: str, out: str = "w", name: str = "method") -> DataFrame:
    """A row for every row of *df* and every method, in one pass: formulas are columns, and all norms share one window's sort."""
    kinds = [lookup(METHODS, n) for n in names]
    df = df.withColumns({f"_raw_{kind}": formula(kind) for kind, _ in kinds})
    df = df.withColumns({f"_w_{i}": normalised(f"_raw_{kind}", norm, *keys) for i, (kind, norm) in enumerate(kinds)})
    each = F.explode(F.array(*[F.struct(F.lit(n).alias(name), F.col(f"_w_{i}").alias(out)) for i, n in enumerate(names)]))
    kept = [c for c in df.columns if not c.startswith(("_raw_", "_w_"))]
    return df.select(*kept, each.alias("_x")).select(*kept, f"_x.{name}", f"_x.{out}")


def sum_mode(df: DataFrame, mode: str, *keys: str, w: str = "w", reward: str = "r", mask: str = "is_completion", out: str = "wm") -> DataFrame:
    """Weights rescaled within *keys* over completion tokens (SM1-SM5); other tokens weigh 0."""
    lookup(SUM_MODES, mode)
    over = Window.partitionBy(*keys)
    own = F.when(F.col(mask), F.col(w)).otherwise(0.0)
    on = F.when(F.col(mask), F.lit(1.0)).otherwise(0.0)
    share = own / F.greatest(F.sum(own).over(over), F.lit(1e-8))
    if mode == "ignore":
        return df.withColumn(out, on)
    if mode == "token_scale":
        return df.withColumn(out, own)
    if mode == "normalize":
        return df.withColumn(out, share)
    if mode == "token_count":
        return df.withColumn(out, share * F.sum(on).over(over))
    df = df.withColumn("_share", share)
    below = F.sum(F.col("_share") * F.col(reward)).over(over)
    whole = F.sum(on * F.col(reward)).over(over)
    safe = F.when(below >= 0, F.greatest(below, F.lit(1e-6))).otherwise(F.least(below, F.lit(-1e-6)))
    factor = F.when(F.abs(below) < 1e-6, F.lit(1.0)).otherwise(whole / safe)
    return df.withColumn(out, F.col("_share") * factor).drop("_share")


def force_chosen_one(w: str = "w", side: str = "side", mask: str = "is_completion") -> Column:
    """SM6: chosen tokens weigh their mask; applied last."""
    return F.when(F.col(side) == "c", F.col(mask).cast("double")).otherwise(F.col(w))


def importance_mix(df: DataFrame, share: float, *keys: str, score: str = "score", t: str = "t", out: str = "w", divisor: float = 4.0) -> DataFrame:
    """Importance mixed with a Gaussian prior over the span and brought to mean 1.

    The prior is centred on the span with a deviation of its length over *divisor*, at least 1.
    """
    span, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(t)
    df = df.withColumns({"_n": F.count(F.lit(1)).over(span).cast("double"), "_at": (F.row_number().over(order) - 1).cast("double")})
    sigma = F.greatest(F.lit(1.0), F.col("_n") / divisor)
    off = (F.col("_at") - (F.col("_n") - 1) / 2) / sigma
    df = df.withColumns({"_g": F.exp(-0.5 * off * off), "_raw": F.greatest(F.col(score), F.lit(0.0))})
    prior = F.col("_g") / F.sum("_g").over(span)
    total = F.sum("_raw").over(span)
    mixed = F.when((F.lit(share) <= 0) | (total <= 0), prior).otherwise(share * F.col("_raw") / F.greatest(total, F.lit(1e-300)) + (1 - share) * prior)
    df = df.withColumn("_m", mixed)
    df = df.withColumn(out, F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.col("_m") * F.col("_n") / F.sum("_m").over(span)))
    return df.drop("_n", "_at", "_g", "_raw", "_m")


def align(weights: str | Column, n: str | Column) -> Column:
    """P10: weights cut to *n* tokens, or filled up with their mean (1 if there are none)."""
    w, n = (F.col(x) if isinstance(x, str) else x for x in (weights, n))
    mean = F.when(F.size(w) == 0, F.lit(1.0)).otherwise(F.aggregate(w, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(w), F.lit(1)))
    return F.when(F.size(w) >= n, F.slice(w, 1, n)).otherwise(F.concat(w, F.array_repeat(mean, n - F.size(w))))


def place(weights: str, n_prompt: str | Column, total: str | Column) -> Column:
    """Zeros over the prompt, then the weights, cut or filled up with zeros to *total* tokens."""
    prompt, total = (F.col(x) if isinstance(x, str) else x for x in (n_prompt, total))
    full = F.concat(F.array_repeat(F.lit(0.0), prompt), F.col(weights))
    return F.slice(F.concat(full, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), total - F.size(full)))), 1, total)
