"""Sequence sums, rewards, weight statistics and the sort-matched losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.losses import smoothed
from quillon.functions.vectors import at_least, entropy
from quillon.operators.layout import prefix_sums, ranked
from quillon.operators.quantiles import LOWER, quantiles

# Tolerances of reproduction checks.
REL_TOL, CORR_TOL = 1e-2, 0.999


def sequences(tokens: DataFrame, *keys: str, w: str | None = None) -> DataFrame:
    """Sums over completion tokens of policy and reference log-probabilities, weighted ones too, and their count."""
    on = F.col("is_completion").cast("double")
    sums = [F.sum(F.col(c) * on).alias(c) for c in ("logp", "ref_logp")] + [F.sum(on).alias("n")]
    if w:
        sums += [F.sum(F.col(c) * F.col(w) * on).alias(f"w_{c}") for c in ("logp", "ref_logp")]
    return tokens.groupBy(*keys).agg(*sums)


def paired(sides: DataFrame, values: list[str], key: str = "pair_id", side: str = "side") -> DataFrame:
    """Chosen and rejected sides in one row, c_ and r_, by one conditional aggregation."""
    pick = lambda v, s: F.max(F.when(F.col(side) == s, F.col(v))).alias(f"{s}_{v}")
    return sides.groupBy(key).agg(*[pick(v, s) for s in ("c", "r") for v in values])


def mean_logp(sums: str = "logp", n: str = "n") -> Column:
    """Length-normalised log-probability; an empty completion divides by one."""
    return F.col(sums) / F.greatest(F.col(n), F.lit(1.0))


def reward_metrics(pairs: DataFrame, beta: float = 0.1, prefix: str = "") -> DataFrame:
    """Means of both rewards, accuracy (strictly greater) and margin."""
    c = beta * (F.col(f"c_{prefix}logp") - F.col(f"c_{prefix}ref_logp"))
    r = beta * (F.col(f"r_{prefix}logp") - F.col(f"r_{prefix}ref_logp"))
    return pairs.agg(F.avg(c).alias("chosen"), F.avg(r).alias("rejected"), F.avg((c > r).cast("double")).alias("accuracy"), F.avg(c - r).alias("margin"))


def weight_stats(tokens: DataFrame, w: str = "w", side: str = "side") -> DataFrame:
    """Statistics of the weights of rejected completion tokens; one token has deviation 0."""
    x = F.col(w)
    return tokens.where((F.col(side) == "r") & F.col("is_completion")).agg(F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.max(x).alias("max"), F.min(x).alias("min"))


def token_accuracy(tokens: DataFrame) -> DataFrame:
    """Share of completion tokens whose greatest logit is the target's; 0 without tokens."""
    hit = (F.array_position("z", F.array_max("z")) - 1 == F.col("target")).cast("double")
    return tokens.where("is_completion").agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"))


def batch_metrics(tokens: DataFrame, side: str = "side") -> DataFrame:
    """Entropy over all completion tokens, the mean logit of each side's and the chosen side's accuracy; 0 without tokens."""
    z = F.col("z")
    mean = F.aggregate(z, F.lit(0.0), lambda s, x: s + x) / F.size(z)
    hit = (F.array_position(z, F.array_max(z)) - 1 == F.col("target")).cast("double")
    of = lambda s, x: F.coalesce(F.avg(F.when(F.col(side) == s, x)), F.lit(0.0))
    return tokens.where("is_completion").agg(
        F.coalesce(F.avg(entropy("z")), F.lit(0.0)).alias("entropy"), of("c", mean).alias("logits_chosen"), of("r", mean).alias("logits_rejected"), of("c", hit).alias("mean_token_accuracy")
    )


def running_tokens(steps: DataFrame, order: str, n: str) -> DataFrame:
    """Tokens seen so far by the order of any column."""
    return prefix_sums(steps, order, n, "_before").withColumn("tokens_seen", F.col("_before") + F.col(n)).drop("_before")


def throughput(runs: DataFrame, rows: str, seconds: str, total: int, shards: int = 8) -> DataFrame:
    """Rows a second over all runs, and the hours that *total* rows take, by one worker and by *shards*."""
    sums = runs.agg(F.sum(rows).alias("rows"), F.sum(seconds).alias("seconds"))
    each = F.col("seconds") / F.greatest(F.col("rows"), F.lit(1))
    hours = each * total / 3600
    return sums.select("rows", "seconds", each.alias("seconds_a_row"), (F.col("rows") / at_least("seconds", 1e-9)).alias("rows_a_second"), hours.alias("hours"), (hours / shards).alias("hours_by_shards"))


def sort_matched(pairs: DataFrame, left: Column, right: Column, batch: str, key: str = "pair_id", beta: float = 0.1, eps: float = 0.0) -> DataFrame:
    """Within each batch both columns sorted and matched rank by rank (W11); ties by key, pairs without a side last."""
    base = pairs.select(batch, key, left.alias("_l"), right.alias("_r"))
    rank = lambda c: F.row_number().over(Window.partitionBy(batch).orderBy(F.asc_nulls_last(c), key))
    a = base.select(batch, "_l", rank("_l").alias("rank"))
    b = base.select(batch, "_r", rank("_r").alias("rank"))
    return a.join(b, [batch, "rank"]).select(batch, "rank", smoothed(beta * (F.col("_l") - F.col("_r")), eps).alias("loss"))


def compare(df: DataFrame, *keys: str, got: str = "got", ref: str = "ref", order: str = "i") -> DataFrame:
    """Agreement of computed and saved values of each channel.

    The median is the lower one, the slope goes through the origin, ranks are ordinal with ties by *order* (unique in a
    channel), and correlations need more than one value and some spread (else NaN).  Ranks come from scans over all channels and
    medians from bounded sketches, so a channel may hold all rows; what *df* is made of is read once.
    """
    g, r = F.col(got), F.col(ref)
    rel = F.abs(g - r) / F.greatest(F.abs(r), F.lit(1e-12))
    placed = ranked(ranked(df.select(*keys, order, got, ref), [got, order], "_rg", keys), [ref, order], "_rr", keys, drop=(order,)).withColumn("_rel", rel)
    many = (F.count(F.lit(1)) > 1) & (F.stddev_samp(g) > 0) & (F.stddev_samp(r) > 0)
    guard = lambda c: F.when(many, c).otherwise(F.lit(float("nan")))
    corr = lambda a, b: F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))  # noqa: E731  corr() divides by no spread
    out = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(g - r)).alias("max_abs"), F.max("_rel").alias("rel_max"),
        (F.sum(g * r) / F.greatest(F.sum(r * r), F.lit(1e-30))).alias("slope"), guard(corr(g, r)).alias("corr"), guard(corr(F.col("_rg"), F.col("_rr"))).alias("spearman"),
    )
    medians = quantiles(placed.select(*keys, "_rel"), "_rel", [0.5], *keys, kind=LOWER, out="_q").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.get("_q", F.lit(0)).alias("rel_median"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    both = out.join(medians, on, "left") if keys else out.crossJoin(F.broadcast(medians))
    out = both.select(*keys, "n", "max_abs", "rel_median", "rel_max", "slope", "corr", "spearman")
    return out.withColumn("ok", (F.col("rel_median") < REL_TOL) & ((F.col("n") == 1) | (~F.isnan("corr") & (F.col("corr") > CORR_TOL))))


def confidence(tokens: DataFrame, *keys: str) -> DataFrame:
    """Exp of the mean over completion tokens of log-probability less the log of the summed squared probabilities."""
    from quillon.functions.vectors import collision

    on = F.col("is_completion").cast("double")
    aligned = (F.col("logp") - F.log(collision("z"))) * on
    return tokens.groupBy(*keys).agg(F.exp(F.sum(aligned) / F.greatest(F.sum(on), F.lit(1.0))).alias("confidence"))


def sft_loss(tokens: DataFrame, side: str = "side") -> DataFrame:
    """The mean loss of all chosen completion tokens of the batch, one row."""
    return tokens.where((F.col(side) == "c") & F.col("is_completion")).agg(F.avg(-F.col("logp")).alias("sft"))


def mixed_loss(pairs: DataFrame, losses_and_weights: dict[str, float], multiplier: Column | None = None, **options) -> DataFrame:
    """The batch loss: the mean of each loss (times *multiplier* of each pair), weighted and summed."""
    from quillon.functions.losses import loss

    scale = F.lit(1.0) if multiplier is None else multiplier
    each = [w * F.avg(loss(n, F.col("cs"), F.col("rs"), F.col("c_n"), F.col("r_n"), **options) * scale) for n, w in losses_and_weights.items()]
    total = each[0]
    for x in each[1:]:
        total = total + x
    return pairs.agg(total.alias("loss"))
