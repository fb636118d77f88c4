"""The reference queries: each a function of (spark, sf_dir), registered with its SQL in :mod:`quillon.plans.oracles`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import losses, weights
from quillon.functions.hashing import hash32, uniform
from quillon.functions.vectors import (
    at_least, collision, dot, entropy, nll, norm, norm1_weight, norm2_weight, position_kl, rounded, sanitize, scale, sigmoid, token_probability, unit,
)
from quillon.operators import batching, clustering, directions, identity, inspection, metrics, preferences, sketch
from quillon.operators.layout import spread
from quillon.operators.quantiles import quantiles
from quillon.plans.registry import QUERIES, query, round_columns, union
from quillon.plans.surrogates import (
    DIM, centroids, chat_pairs, conversations, document_pairs, logits, mean_direction, own_directions, single, sketches, table, token_logps, weighted_tokens,
)
from quillon.sources.tables import staged
from quillon.streaming.incremental import pending, windowed_counts

_round, _union = round_columns, union


def _pairs(s: DataFrame) -> DataFrame:
    """A row per pair with c_ and r_ sums of log-probabilities, and the scores cs and rs."""
    sums = metrics.sequences(token_logps(s), "pair_id", "side")
    wide = metrics.paired(sums, ["logp", "ref_logp", "n"])
    return wide.withColumns({"cs": F.col("c_logp") - F.col("c_ref_logp"), "rs": F.col("r_logp") - F.col("r_ref_logp")})


@query
def q01_token_alignment(spark, sf):
    s = sketches(spark, sf)
    best = directions.nearest_centroid(s.withColumn("v", F.col("raw")), centroids(s), out="best_label", best="best_cos")
    scored = best.join(F.broadcast(centroids(s).select(F.col("k").alias("best_label"), "center")), "best_label")
    return _round(scored.select("vec_id", "best_label", "best_cos", dot("raw", "center").alias("best_dot")), "best_cos", "best_dot")


@query
def q02_mean_direction(spark, sf):
    m = mean_direction(sketches(spark, sf))
    return _round(m.select(F.posexplode("center").alias("i", "value"), norm("center").alias("length")), "value", "length")


def _long_centroids(s, kind):
    return _round(centroids(s, kind).select("k", "n_averaged", F.posexplode("center").alias("i", "value")), "value")


@query
def q03_cluster_centroids_mean(spark, sf):
    return _long_centroids(sketches(spark, sf), "mean")


@query
def q04_cluster_centroids_meannorm(spark, sf):
    return _long_centroids(sketches(spark, sf), "meannorm")


@query
def q05_dot_scale_modes(spark, sf):
    s = sketches(spark, sf)
    c = centroids(s).select("k", norm("center").alias("own")).crossJoin(F.broadcast(mean_direction(s).select(norm("center").alias("mean"))))
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), directions.dot_scale(m, "own", "mean").alias("factor")) for m in directions.DOT_SCALES])
    return _round(c.select("k", F.explode(modes).alias("m")).select("k", "m.mode", "m.factor"), "factor")


def _named(s, name):
    """Scores of a direction by its name: each token's own and mean directions are columns beside it, in one pass."""
    own, mean = (d.withColumnRenamed("center", "unweighted") for d in (own_directions(s), mean_direction(s)))
    return directions.direction_scores(name, s.withColumn("g_norm", norm("raw")), own, mean, {("mean", 10): centroids(s)}, "idx", "raw", "g_norm")


@query
def q06_max_direction(spark, sf):
    s = sketches(spark, sf)
    return _round(_named(s, "max_unweighted").select("idx", "t", "dot", "cos"), "dot", "cos")


def _clusters(s):
    tokens = s.withColumn("g_norm", norm("raw"))
    return directions.cluster_scores(tokens, centroids(s), "raw", "g_norm", factor=directions.dot_scale("unit", norm("center"), F.lit(1.0)))


@query
def q07_clusteronly(spark, sf):
    return _round(_clusters(sketches(spark, sf)).select("idx", "t", "dot", "cos"), "dot", "cos")


@query
def q08_maxclu(spark, sf):
    s = sketches(spark, sf)
    return _round(_named(s, "maxclu_mean_K10").select("idx", "t", "dot", "cos"), "dot", "cos")


@query
def q09_weight_formulas(spark, sf):
    s = single(sketches(spark, sf))
    each = [F.struct(F.lit(n).alias("formula"), weights.formula(n, "cos", "dot", "pn").alias("w")) for n in weights.FORMULAS]
    return _round(s.select("idx", "t", F.explode(F.array(*each)).alias("x")).select("idx", "t", "x.formula", "x.w"), "w")


@query
def q10_weight_norms(spark, sf):
    s = single(sketches(spark, sf)).withColumn("raw", weights.formula("sigmoid_dot", "cos", "dot", "pn"))
    s = s.withColumns({n: weights.normalised("raw", n, "idx") for n in weights.NORMS})
    each = [F.struct(F.lit(n).alias("norm"), F.col(n).alias("w")) for n in weights.NORMS]
    return _round(s.select("idx", "t", F.explode(F.array(*each)).alias("x")).select("idx", "t", "x.norm", "x.w"), "w")


def _weighted_tokens(s):
    return weighted_tokens(s, weights.formula("sigmoid_dot", "cos", "dot", "pn"))


@query
def q11_sum_modes(spark, sf):
    s = _weighted_tokens(sketches(spark, sf))
    for m in weights.SUM_MODES:
        s = weights.sum_mode(s, m, "idx", out=m)
    s = s.withColumn("chosen_one", weights.force_chosen_one("token_count"))
    each = [F.struct(F.lit(m).alias("mode"), F.col(m).alias("w")) for m in (*weights.SUM_MODES, "chosen_one")]
    return _round(s.select("idx", "t", F.explode(F.array(*each)).alias("x")).select("idx", "t", "x.mode", "x.w"), "w")


@query
def q12_ti_mix(spark, sf):
    s = single(sketches(spark, sf)).select("idx", "t", F.col("dot").alias("score"))
    short = s.where("idx = 0 and t = 0").withColumn("idx", F.lit(-1).cast("bigint"))  # a span of one token
    s = s.unionByName(short)
    return _round(_union([weights.importance_mix(s, x, "idx").select(F.lit(x).alias("share"), "idx", "t", "w") for x in (0.0, 0.7, 1.0)]), "w")


@query
def q13_logit_weights(spark, sf):
    z = logits(sketches(spark, sf)).withColumn("loss", nll("z", "target")).withColumns({"p": token_probability("loss"), "squares": collision("z"), "h": entropy("z")})
    z = z.withColumns({"w1": norm1_weight("p"), "w2": norm2_weight("p", "squares")})
    return _round(z.select("vec_id", "loss", "p", "squares", "h", "w1", "w2"), "loss", "p", "squares", "h", "w1", "w2")


@query
def q14_pairwise_losses(spark, sf):
    p = _pairs(sketches(spark, sf))
    each = [F.struct(F.lit(n).alias("loss"), losses.loss(n, F.col("cs"), F.col("rs"), F.col("c_n"), F.col("r_n")).alias("value")) for n in losses.LOSSES]
    kinds = ("reverse_kl", "forward_kl", "js_divergence", "alpha_divergence")
    d = lambda k: losses.divergence(F.col("cs"), k) - losses.divergence(F.col("rs"), k)
    each += [F.struct(F.lit(f"sigmoid_{k}").alias("loss"), losses.smoothed(0.1 * d(k)).alias("value")) for k in kinds[1:]]
    return _round(p.select("pair_id", F.explode(F.array(*each)).alias("x")).select("pair_id", "x.loss", "x.value"), "value")


@query
def q15_aot_losses(spark, sf):
    p = _pairs(sketches(spark, sf)).withColumn("batch", F.floor(F.col("pair_id") / 8))
    paired = metrics.sort_matched(p, F.col("c_logp") - F.col("r_logp"), F.col("c_ref_logp") - F.col("r_ref_logp"), "batch").withColumn("kind", F.lit("aot"))
    unpaired = metrics.sort_matched(p, F.col("cs"), F.col("rs"), "batch").withColumn("kind", F.lit("aot_unpaired"))
    return _round(paired.unionByName(unpaired), "loss")


@query
def q16_tdpo_losses(spark, sf):
    z = token_logps(sketches(spark, sf)).withColumn("kl", position_kl("ref_z", "z"))
    on = F.col("is_completion").cast("double")
    sums = z.groupBy("pair_id", "side").agg(F.sum((F.col("logp") - F.col("ref_logp")) * on).alias("m"), F.sum(F.col("kl") * on).alias("kl"))
    p = metrics.paired(sums, ["m", "kl"])
    value = lambda a: losses.tdpo(F.col("c_m") - F.col("r_m"), F.col("c_kl"), F.col("r_kl"), alpha=a)
    return _round(p.select("pair_id", "c_kl", "r_kl", value(1.0).alias("tdpo1"), value(0.5).alias("tdpo2"), value(0.0).alias("no_kl")), "c_kl", "r_kl", "tdpo1", "tdpo2", "no_kl")


@query
def q17_simpo_avg_logp(spark, sf):
    z = token_logps(sketches(spark, sf)).withColumn("is_completion", F.col("is_completion") & (F.col("idx") != 1))  # one empty completion
    p = metrics.paired(metrics.sequences(z, "pair_id", "side").withColumn("mean", metrics.mean_logp()), ["mean", "n"])
    out = p.select("pair_id", "c_mean", "r_mean", "r_n", losses.simpo(F.col("c_mean"), F.col("r_mean")).alias("loss"))
    return _round(out, "c_mean", "r_mean", "loss")


@query
def q18_reward_metrics(spark, sf):
    s = weights.sum_mode(_weighted_tokens(sketches(spark, sf)), "token_count", "idx", out="wm")
    sums = metrics.sequences(s, "pair_id", "side", w="wm")
    p = metrics.paired(sums, ["logp", "ref_logp", "w_logp", "w_ref_logp"])
    out = metrics.reward_metrics(p).withColumn("kind", F.lit("plain")).unionByName(metrics.reward_metrics(p, prefix="w_").withColumn("kind", F.lit("weighted")))
    return _round(out, "chosen", "rejected", "accuracy", "margin")


@query
def q19_weight_stats(spark, sf):
    s = _weighted_tokens(sketches(spark, sf))
    out = metrics.weight_stats(s).crossJoin(metrics.token_accuracy(s.where("side = 'c'")))
    return _round(out, "mean", "std", "max", "min", "accuracy")


@query
def q20_format_pairs(spark, sf):
    return preferences.format_pairs(chat_pairs(spark, sf))


@query
def q21_unpair(spark, sf):
    return preferences.unpair(preferences.format_pairs(chat_pairs(spark, sf)))


@query
def q22_reverse_pairs(spark, sf):
    p = document_pairs(spark, sf)
    flip = F.pmod("rank", F.lit(2)) == 0
    both = F.when(flip, F.struct(F.col("rejected_id").alias("c"), F.col("chosen_id").alias("r"))).otherwise(F.struct(F.col("chosen_id").alias("c"), F.col("rejected_id").alias("r")))
    return p.select("lang", "rank", both.alias("b")).select("lang", "rank", F.col("b.c").alias("chosen_id"), F.col("b.r").alias("rejected_id"))


@query
def q23_filter_degenerate(spark, sf):
    judged = preferences.format_pairs(chat_pairs(spark, sf)).withColumn("reason", F.coalesce(preferences.skip_reason(), F.lit("kept")))
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def q24_last_messages(spark, sf):
    last = preferences.last_message
    return chat_pairs(spark, sf).select("idx", last("chosen", "user").alias("prompt"), last("chosen").alias("chosen"), last("rejected").alias("rejected"))


@query
def q25_align_weights(spark, sf):
    s = single(sketches(spark, sf)).withColumn("w", weights.formula("sigmoid_dot", "cos", "dot", "pn"))
    lists = s.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "w"))), lambda x: x["w"]).alias("w"))
    lists = lists.withColumn("n", (F.pmod("idx", F.lit(16))).cast("int")).withColumn("w", F.when(F.pmod("idx", F.lit(7)) == 3, F.array().cast("array<double>")).otherwise(F.col("w")))
    out = lists.select("idx", F.posexplode(weights.align("w", "n")).alias("t", "w"))
    return _round(out, "w")


@query
def q26_coverage_gaps(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return preferences.coverage(docs, labels, "doc_id").withColumn("first_gaps", F.array_join("first_gaps", ","))


@query
def q27_availability(spark, sf):
    s = sketches(spark, sf).select("idx", "t", "vec_id")
    have = s.where("vec_id % 3 <> 0 or idx % 2 = 0").withColumn("direction", F.concat(F.lit("d"), F.pmod("t", F.lit(3)).cast("string"))).where("not (idx % 5 = 1 and direction = 'd2')")
    return preferences.available(s.select("idx").distinct(), have, ["d0", "d1", "d2"])


@query
def q28_eta_squared(spark, sf):
    d = table(spark, sf, "documents").select("lang", "n_chars")
    return _round(inspection.eta_squared(d, F.log(F.greatest("n_chars", F.lit(1)).cast("double")), "lang"), "eta_squared")


@query
def q29_distinctive_terms(spark, sf):
    docs = spread(table(spark, sf, "documents").select("text", "lang"))
    return _round(inspection.distinctive_terms(docs, "text", "lang"), "logodds")


def _labelled(s):
    c = centroids(s, "meannorm").select(F.col("k").alias("label"), "center")
    cos = dot("u", "center") / (at_least(norm("u")) * at_least(norm("center")))
    return s.join(F.broadcast(c), "label").select("vec_id", "label", "u", cos.alias("cos"))


@query
def q30_medoids(spark, sf):
    return _round(inspection.medoids(_labelled(sketches(spark, sf)), "label", "cos", "vec_id").select("label", "rank", "vec_id", "cos"), "cos")


@query
def q31_nearest_centroid(spark, sf):
    return _round(inspection.nearest_other(centroids(sketches(spark, sf), "meannorm")), "cos")


@query
def q32_agreement(spark, sf):
    s = sketches(spark, sf)
    near = directions.nearest_centroid(s.withColumn("v", F.col("u")), centroids(s, "meannorm"))
    return _round(inspection.agreement(near, "label", "cluster"), "agreement")


@query
def q33_cluster_eval(spark, sf):
    s = sketches(spark, sf)
    return _round(clustering.evaluate(s, centroids(s, "meannorm"), "u", "label", 10), "cohesion", "separation", "nearest_other", "cohesion_min")


@query
def q34_pairwise_cosine(spark, sf):
    c = staged(clustering.pair_cosines(sketches(spark, sf), "raw", "vec_id"), "cosines")
    q = c.agg(F.count(F.lit(1)).alias("n"), F.avg("cos").alias("mean"), F.stddev_samp("cos").alias("std")).crossJoin(F.broadcast(quantiles(c, "cos", list(clustering.PAIR_QUANTILES), out="q")))
    return _round(q.select("n", "mean", "std", *[F.get("q", F.lit(k)).alias(f"q{k}") for k in range(5)]), "mean", "std", *[f"q{k}" for k in range(5)])


@query
def q35_countsketch(spark, sf):
    s = sketch.count_sketch(sketches(spark, sf).select("vec_id", "raw"), "raw", DIM, 16)
    return _round(s.select("vec_id", "sketch_norm", F.posexplode("sketch").alias("b", "value")), "value", "sketch_norm")


@query
def q36_sketch_quality(spark, sf):
    s = sketch.count_sketch(sketches(spark, sf).select("vec_id", "raw"), "raw", DIM, 16)
    return _round(sketch.quality_report(s, "vec_id", "raw", "sketch", 100), "mean_error", "max_error", "corr")


def _start(s, k):
    firsts = s.orderBy("vec_id").limit(k).select((F.row_number().over(Window.orderBy("vec_id")) - 1).alias("k"), F.col("u").alias("center"))
    return firsts


def _steps(spark, sf, n, k=4):
    s = sketches(spark, sf)
    c, objective = _start(s, k), None
    for _ in range(n):
        c, objective = clustering.step(s, c, "u", DIM, "vec_id")
    return _round(c.select("k", F.lit(float(objective)).alias("objective"), F.posexplode("center").alias("i", "value")), "value", "objective")


@query
def q37_kmeans_step(spark, sf):
    return _steps(spark, sf, 1)


@query
def q38_kmeans_3iter(spark, sf):
    return _steps(spark, sf, 3)


@query
def q39_spherical_kmeans(spark, sf):
    s = sketches(spark, sf).select("vec_id", "u")
    assigned, _, objective = clustering.spherical_kmeans(s, "u", "vec_id", DIM, 4)
    return _round(clustering.sizes(assigned, 4).withColumn("objective", F.lit(float(objective))), "objective")


@query
def q40_k_sweep(spark, sf):
    return _round(clustering.k_sweep(sketches(spark, sf).select("vec_id", "u"), "u", "vec_id", DIM), "objective")


def _prints(s, factor=None):
    if factor is not None:
        s = s.withColumn("raw", scale("raw", factor))
    return identity.fingerprint(s.withColumn("name", F.col("label").cast("string")), "name", "raw")


@query
def q41_fingerprint(spark, sf):
    return _round(_prints(sketches(spark, sf)), "sum", "sumsq")


@query
def q42_fingerprint_verify(spark, sf):
    s = sketches(spark, sf)
    saved = _prints(s)
    drifted = {"equal": F.lit(1.0), "negated": F.when(F.col("label") == 3, -1.0).otherwise(1.0), "drifted": F.lit(1.001), "doubled": F.lit(2.0)}
    each = []
    for name, factor in drifted.items():
        now = _prints(s, factor)
        bad = identity.verify(saved, now, "name").agg(F.count_if(F.col("status") != "ok").alias("n_bad"))
        each.append(identity.classify_mismatch(saved, now, "name").select(F.lit(name).alias("copy"), "kind").crossJoin(bad))
    return _union(each)


@query
def q43_reproduction_compare(spark, sf):
    s = sketches(spark, sf).select("vec_id", "label", "gnorm", F.get("u", F.lit(0)).alias("x"), F.get("u", F.lit(1)).alias("y"))
    channels = [("same", F.col("x")), ("scaled", F.col("x") * -0.5), ("noisy", F.col("x") + 0.1 * F.col("y"))]
    long = s.select("vec_id", "x", F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), c.alias("got")) for n, c in channels])).alias("c")).select("c.channel", F.col("vec_id").alias("i"), "c.got", F.col("x").alias("ref"))
    one = s.where("vec_id = 7").select(F.lit("one").alias("channel"), F.col("vec_id").alias("i"), F.col("x").alias("got"), F.col("x").alias("ref"))
    out = metrics.compare(long.unionByName(one), "channel")
    return _round(out, "max_abs", "rel_median", "rel_max", "slope", "corr", "spearman")


@query
def q44_batch_pack(spark, sf):
    return batching.budget_batches(table(spark, sf, "documents").select("lang", "doc_id", "n_chars"), "lang", "doc_id", "n_chars")


@query
def q45_seeded_sample(spark, sf):
    s = _labelled(sketches(spark, sf)).select("vec_id", "label", "cos")
    top = inspection.medoids(s, "label", "cos", "vec_id", 3)
    return inspection.sample(s, "label", "vec_id", 5, without=top).select("label", "rank", "vec_id")


@query
def q46_compaction_check(spark, sf):
    from quillon.sources.tables import difference

    s = sketches(spark, sf).select("idx", "vec_id", "gnorm")
    missing, extra = difference(s, s.repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id"))
    return spark.createDataFrame([(missing, extra, s.count())], "missing bigint, extra bigint, n bigint")


@query
def q47_resume_antijoin(spark, sf):
    work = sketches(spark, sf).select(F.col("vec_id").alias("idx"), "label")
    return pending(work, work.where("idx < 100 or idx between 200 and 249"))


@query
def q48_summary_quantiles(spark, sf):
    spread = lambda df, key, x: df.groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"percentile_disc(0.5) within group (order by {x})").cast("double").alias("lower_median"),
        F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.5).cast("bigint").alias("whole_median"), F.min(x).cast("double").alias("low"), F.max(x).cast("double").alias("high"),
    )
    out = _union([spread(table(spark, sf, "documents"), "lang", "n_chars"), spread(table(spark, sf, "events"), "event_type", "value")])
    return _round(out, "lower_median", "median", "low", "high")


@query
def q49_event_windows(spark, sf):
    e = windowed_counts(table(spark, sf, "events").select("ts", "event_type", "value"), "ts", "event_type", width="1 day")
    return _round(e.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), "total")


@query
def q52_running_tokens(spark, sf):
    steps = token_logps(sketches(spark, sf)).where("is_completion").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    return metrics.running_tokens(steps, "pair_id", "n")


@query
def q53_reproduction_verdict(spark, sf):
    s = sketches(spark, sf).select("vec_id", F.get("u", F.lit(0)).alias("x"), F.get("u", F.lit(1)).alias("y"))
    cases = {"exact": (F.col("x"), F.col("y")), "reparameterised": (F.col("x"), F.col("y") * -0.5), "drifted": (F.col("x") * 1.02, F.col("y")), "different": (F.col("y"), F.col("x"))}
    channel = lambda copy, c, got, ref: F.struct(F.lit(copy).alias("copy"), F.lit(c).alias("channel"), got.alias("got"), F.col(ref).alias("ref"))
    each = [x for copy, (clean, basis) in cases.items() for x in (channel(copy, "norms", clean, "x"), channel(copy, "products", basis, "y"))]
    long = s.select(F.col("vec_id").alias("i"), F.explode(F.array(*each)).alias("c")).select("i", "c.*")
    stats = metrics.compare(long, "copy", "channel").withColumns({"clean": F.col("channel") == "norms", "basis_sensitive": F.col("channel") == "products"})
    return identity.classify_reproduction(stats, "copy").select("copy", "verdict")


@query
def q54_uniform_control(spark, sf):
    s = sketches(spark, sf).select("idx", "t", "vec_id", F.lit(0.5).alias("constant"), (0.25 + 0.5 * uniform("vec_id", "w", 1234)).alias("random"), F.lit(1.0).alias("one"))
    return _round(s.select("vec_id", "constant", "random", "one"), "random")


@query
def q55_confidence_weighting(spark, sf):
    t = token_logps(sketches(spark, sf))
    both = metrics.paired(metrics.confidence(t, "pair_id", "side"), ["confidence"]).crossJoin(F.broadcast(metrics.sft_loss(t)))
    return _round(both.select("pair_id", "c_confidence", "r_confidence", "sft"), "c_confidence", "r_confidence", "sft")


@query
def q56_mixed_loss(spark, sf):
    s = sketches(spark, sf)
    weight = metrics.paired(metrics.confidence(token_logps(s), "pair_id", "side"), ["confidence"])
    p = _pairs(s).join(weight, "pair_id")
    mix = {"sigmoid": 0.8, "hinge": 0.2, "bco_pair": 1.0}
    plain = metrics.mixed_loss(p, mix).withColumn("kind", F.lit("plain"))
    scaled = metrics.mixed_loss(p, mix, F.col("c_confidence") * F.col("r_confidence")).withColumn("kind", F.lit("weighted"))
    return _round(plain.unionByName(scaled), "loss")


@query
def q57_cluster_report(spark, sf):
    """What the report says of each cluster: size, share, median norm and the nearest other cluster."""
    s = sketches(spark, sf)
    s = s.withColumnRenamed("label", "k")
    medians = quantiles(s, "gnorm", [0.5], "k").select("k", F.get("quantiles", F.lit(0)).alias("median_norm"))
    rows = s.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("gnorm").alias("low"), F.max("gnorm").alias("high")).join(medians, "k")
    rows = rows.join(F.broadcast(inspection.nearest_other(centroids(s.withColumnRenamed("k", "label"), "meannorm"))), "k", "left")
    rows = rows.withColumn("ratio", F.col("high") / at_least("low")).withColumn("name", F.format_string("k%02d", F.col("k")))
    return _round(rows.select("name", "n", "median_norm", "ratio", "other", "cos"), "median_norm", "ratio", "cos")


@query
def q58_token_split_whole(spark, sf):
    """P6, P7 on surrogate ids: numbers for words, the header being one frequent word; whole texts, cut at the fixed length."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "[ \n]+").alias("words"))
    ids = d.select("doc_id", F.transform("words", lambda w: F.when(w == "the", 7).otherwise(F.length(w) + 100)).alias("ids"))
    split = ids.withColumn("s", preferences.split_ids("ids", [7], preferences.MAX_SEQ_LENGTH))
    start, n = F.col("s.comp_start"), F.size("s.completion_ids")
    mask = preferences.label_mask(F.slice("ids", 1, start + n), start)
    return split.select("doc_id", F.size("ids").alias("n"), start.alias("comp_start"), F.when(start.isNotNull(), n).alias("n_completion"), F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"))


@query
def q59_covariance_whole(spark, sf):
    """A9 over all coordinates."""
    return _round(clustering.covariance(sketches(spark, sf), "raw", DIM), "cov")


from quillon.plans import method_queries, storage_queries, structure_queries  # noqa: E402,F401  (they register their queries)
