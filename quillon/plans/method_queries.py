"""Queries of methods that the first list leaves out: batching, directions by name, losses, blocks, projections, starts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import losses, weights
from quillon.functions.controls import control_weights
from quillon.functions.vectors import collision, dot, nll, norm, norm1_weight, norm2_weight, token_probability
from quillon.operators import batching, clustering, directions, inspection, layout, metrics, preferences, sketch
from quillon.plans.registry import query, round_columns as _round, union as _union
from quillon.plans.surrogates import DIM, centroids, conversations, logits, single, sketches, table, token_logps

WEIGHTINGS = ("unweighted", "weighted_norm1", "weighted_norm2")
NAMES = ("single_weighted_norm1", "aggregated_weighted_norm2", "max_weighted_norm1", "clusteronly_mean_K10", "maxclu_meannorm_K10")
#: Blocks of a 64-dimensional vector.
BLOCKS = [("a", 10), ("b", 20), ("c", 30), ("d", 4)]


@query
def q80_pad_batches(spark, sf):
    """Chats in batches of four, padded on the left to the longest of their batch."""
    words = lambda m: F.filter(F.split(m["content"], r"\s+"), lambda w: w != "")
    c = conversations(spark, sf).select("conv_id", F.transform(F.flatten(F.transform("messages", words)), lambda w: F.length(w)).alias("ids"))
    c = batching.fixed_batches(c, "conv_id")
    widths = c.groupBy("batch").agg(F.max(F.size("ids")).alias("width"))
    padded = c.join(widths, "batch").withColumn("padded", preferences.pad_left("ids", "width"))
    mask = F.transform("padded", lambda x: (x != 0).cast("int"))
    total = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return padded.select("conv_id", "batch", F.size("padded").alias("width"), total("padded").alias("sum"), total(mask).alias("n"), (F.array_position(mask, 1) - 1).alias("pad"))


@query
def q81_place_weights(spark, sf):
    """Weights behind a prompt of zeros, cut or filled up to the length of the sequence."""
    s = single(sketches(spark, sf)).withColumn("w", weights.formula("sigmoid_dot", "cos", "dot", "pn"))
    lists = s.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "w"))), lambda x: x["w"]).alias("w"))
    placed = weights.place("w", (F.col("idx") % 5).cast("int"), (F.lit(8) + F.col("idx") % 9).cast("int"))
    return _round(lists.select("idx", F.posexplode(placed).alias("i", "w")), "w")


@query
def q82_resolve_names(spark, sf):
    """What each direction's name stands for, and whether a set of products has all it needs."""
    names = [*directions.BASES, *(directions.direction_name(p, kind, k) for p in ("clusteronly", "maxclu") for kind in directions.KINDS for k in (2, 8))]
    rows = [(n, r["family"], r["kind"], r["K"], r["bases"]) for n in names for r in [directions.resolve(n)]]
    found = spark.createDataFrame(rows, "name string, family string, kind string, K int, bases array<string>")
    have = F.array(*[F.lit(x) for x in ("single_unweighted", "aggregated_unweighted")])
    return found.select("name", "family", "kind", "K", F.array_join("bases", ",").alias("bases"), (F.size(F.array_except("bases", have)) == 0).alias("ready"))


def token_weights(s):
    """s with a column for each weighting of its token."""
    z = logits(s).withColumn("loss", nll("z", "target")).withColumns({"p": token_probability("loss"), "squares": collision("z")})
    z = z.select("vec_id", F.lit(1.0).alias("unweighted"), norm1_weight("p").alias("weighted_norm1"), norm2_weight("p", "squares").alias("weighted_norm2"))
    return s.join(z, "vec_id")


@query
def q83_weighted_means(spark, sf):
    """A1: the mean direction under three weightings in one pass."""
    s = token_weights(sketches(spark, sf))
    m = directions.weighted_means(s, "u", {w: F.col(w) for w in WEIGHTINGS}, DIM)
    long = m.select("n_averaged", F.explode(F.array(*[F.struct(F.lit(w).alias("weighting"), F.col(w).alias("v")) for w in WEIGHTINGS])).alias("x"))
    return _round(long.select("n_averaged", "x.weighting", F.posexplode("x.v").alias("i", "value")), "value")


@query
def q84_direction_scores(spark, sf):
    """D6, D7, N-3: scores of directions given by name."""
    s = sketches(spark, sf)
    w = token_weights(s)
    named = {x: F.col(x) for x in WEIGHTINGS}
    own, mean = directions.weighted_means(w, "u", named, DIM, "idx"), directions.weighted_means(w, "u", named, DIM)
    clusters = {(kind, 10): centroids(s, kind) for kind in directions.KINDS}
    tokens = s.select("idx", "t", "raw", norm("raw").alias("g_norm"))
    scored = directions.named_scores(list(NAMES), tokens, own, mean, clusters, "idx", "raw", "g_norm").select("direction", "idx", "t", "dot", "cos")
    return _round(weights.with_scores(scored, "direction", "idx", p="dot"), "dot", "cos", "pn")


@query
def q85_batch_metrics(spark, sf):
    """Entropy, mean logits of both sides and accuracy of a batch."""
    return _round(metrics.batch_metrics(logits(sketches(spark, sf))), "entropy", "logits_chosen", "logits_rejected", "mean_token_accuracy")


@query
def q86_ratio_losses(spark, sf):
    """Losses of log-ratios, whatever divergence their scores come from."""
    sums = metrics.sequences(token_logps(sketches(spark, sf)), "pair_id", "side")
    p = metrics.paired(sums, ["logp", "ref_logp", "n"])
    cr, rr = F.col("c_logp") - F.col("c_ref_logp"), F.col("r_logp") - F.col("r_ref_logp")
    each = [
        F.struct(F.lit(n).alias("loss"), F.lit(d).alias("divergence"), losses.loss(n, losses.divergence(cr, d), losses.divergence(rr, d), F.col("c_n"), F.col("r_n"), cr=cr, rr=rr).alias("value"))
        for n in losses.RATIO_LOSSES for d in ("reverse_kl", "forward_kl", "js_divergence", "alpha_divergence")
    ]
    return _round(p.select("pair_id", F.explode(F.array(*each)).alias("x")).select("pair_id", "x.*"), "value")


@query
def q87_prospect_loss(spark, sf):
    """Labelled completions against the batch's KL estimate."""
    sums = metrics.sequences(token_logps(sketches(spark, sf)), "pair_id", "side").withColumn("ratio", F.col("logp") - F.col("ref_logp"))
    batch = sums.agg(F.avg("ratio").alias("kl"))
    return _round(sums.crossJoin(F.broadcast(batch)).select("pair_id", "side", losses.kto(F.col("ratio"), F.col("side") == "c", F.col("kl"), undesirable_weight=0.5).alias("loss")), "loss")


@query
def q88_blocks(spark, sf):
    """Blocks laid end to end, a missing one as zeros, and cut again at their offsets."""
    s, at = sketches(spark, sf).select("vec_id", "raw"), 1
    for name, n in BLOCKS:
        s = s.withColumn(name, F.slice("raw", at, n))
        at += n
    s = s.withColumn("b", F.when(F.col("vec_id") % 3 != 0, F.col("b")))
    flat = layout.unflatten(layout.flatten_blocks(s, BLOCKS).select("vec_id", "flat"), "flat", BLOCKS)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    long = flat.select("vec_id", norm("flat").alias("length"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), total(n).alias("total")) for n, _ in BLOCKS])).alias("x"))
    spec = layout.blocks(spark.createDataFrame([(k, n, m) for k, (n, m) in enumerate(BLOCKS)], "ord bigint, name string, numel bigint"), "ord", "numel")
    return _round(long.select("vec_id", "length", "x.*").join(F.broadcast(spec), "name").select("vec_id", "name", "offset", "numel", "total", "length"), "total", "length")


@query
def q89_shift_and_last(spark, sf):
    """Labels shifted by one, and the last place that a mask holds; none at all counts as the last of all."""
    z = logits(sketches(spark, sf)).withColumn("on", F.col("is_completion") & (F.col("t") < 10 - F.col("idx") % 3) & (F.col("idx") % 8 != 5))
    lists = z.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("t", "target", "on"))).alias("x"))
    lists = lists.select("idx", F.transform("x", lambda r: r["target"]).alias("labels"), F.transform("x", lambda r: r["on"]).alias("mask"))
    shifted, mask = preferences.shifted("labels"), preferences.shifted("mask")
    total = F.aggregate(F.zip_with(shifted, mask, lambda l, m: F.when(m, l + 1).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return lists.select("idx", F.size(shifted).alias("n"), preferences.last_true("mask").alias("last"), preferences.last_true(mask).alias("last_shifted"), total.alias("label_sum"))


@query
def q90_zip(spark, sf):
    """Arrays that are aligned by position, as rows."""
    s = sketches(spark, sf).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "gnorm"))).alias("x"))
    s = s.select("label", F.transform("x", lambda r: r["vec_id"]).alias("ids"), F.transform("x", lambda r: r["gnorm"]).alias("norms"))
    return _round(preferences.zipped(s, "ids", "norms").select("label", "i", F.col("ids").alias("vec_id"), F.col("norms").alias("gnorm")), "gnorm")


@query
def q91_centroid_pairs(spark, sf):
    """Every two centroids, in the exact and in the sketched space."""
    c = sketch.make_projection("hashed")(centroids(sketches(spark, sf)).select("k", "center"), "center", DIM, 16)
    return _round(sketch.all_pairs(c, "k", "center", "sketch"), "cos_center", "cos_sketch")


@query
def q92_mean_cosines(spark, sf):
    """A10: cosines to the mean direction."""
    return _round(clustering.mean_cosines(sketches(spark, sf), "raw", DIM), "mean_dir_mean", "mean_dir_min")


@query
def q93_centered(spark, sf):
    """Vectors less their mean, on the sphere."""
    moved, _ = clustering.centered(sketches(spark, sf).select("vec_id", "raw"), "raw", DIM)
    return _round(moved.select("vec_id", F.posexplode("raw").alias("i", "value")), "value")


@query
def q94_block_plan(spark, sf):
    """M1: the blocks of the longest vector there is."""
    return sketch.block_plan(spark, 159_907_840, 1 << 22, 7)


@query
def q95_dense_projections(spark, sf):
    """M3, N-7: projections by name."""
    s = sketches(spark, sf).select("vec_id", "raw")
    each = [sketch.make_projection(m)(s, "raw", DIM, 8, out="y").select(F.lit(m).alias("method"), "vec_id", F.posexplode("y").alias("b", "value")) for m in ("rademacher", "gaussian")]
    return _round(_union(each), "value")


@query
def q96_sketch_self_test(spark, sf):
    """M5: errors of inner products beside their bound, and of the exact norms."""
    s = sketch.count_sketch(sketches(spark, sf).select("vec_id", "raw"), "raw", DIM, 16)
    return _round(sketch.self_test(s, "vec_id", "raw", "sketch", "sketch_norm", 16), "mean_error", "max_error", "norm_error", "bound")


@query
def q97_weight_methods(spark, sf):
    """N-2: every named pair of formula and normalisation."""
    s = single(sketches(spark, sf)).select("idx", "t", F.col("cos").alias("c"), F.col("dot").alias("p"), "pn")
    return _round(weights.methods(s, list(weights.METHODS), "idx").select("idx", "t", "method", "w"), "w")


@query
def q98_reseeded_step(spark, sf):
    """A step from centroids two of which are equal: the empty one gets the worst-fit point."""
    s = sketches(spark, sf)
    first = s.orderBy("vec_id").limit(3).select("vec_id", F.col("u").alias("center"))
    rank = layout.ranked(first, "vec_id", "k").select(F.col("k").cast("int").alias("k"), "center")
    start = rank.unionByName(rank.where("k = 0").withColumn("k", F.lit(3)))
    moved, objective = clustering.step(s, start, "u", DIM, "vec_id")
    return _round(moved.select("k", F.lit(float(objective)).alias("objective"), F.posexplode("center").alias("i", "value")), "value", "objective")


@query
def q99_plus_plus(spark, sf):
    """M6: the starting points of k-means, drawn by squared distance."""
    s = sketches(spark, sf).select("vec_id", "u")
    return spark.createDataFrame([(k, i) for k, (i, _) in enumerate(clustering.plus_plus_ids(s, "u", "vec_id", 5, 0))], "rank int, vec_id bigint")


@query
def q100_inverse_cdf(spark, sf):
    """Rows at given shares of the cumulative weight."""
    return _round(layout.inverse_cdf(sketches(spark, sf), "vec_id", "gnorm", [0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999]), "u")


@query
def q101_best_restarts(spark, sf):
    """The best of three starts for each K, the first among equals."""
    s, runs = sketches(spark, sf).select("vec_id", "u"), []
    for k in (2, 4):
        for r in range(3):
            points = layout.ranked(s, "vec_id", "place").where(F.col("place").between(r * k, r * k + k - 1))
            start = points.select((F.col("place") - r * k).cast("int").alias("k"), F.col("u").alias("center"))
            runs.append(directions.nearest_centroid(s, start, "u").agg(F.avg("cos").alias("objective")).select(F.lit(k).alias("K"), F.lit(r).alias("restart"), "objective"))
    return _round(inspection.best_restarts(_union(runs)), "objective")


@query
def q102_sorted_ids(spark, sf):
    """The ids of medoids and sampled members, once each, in order."""
    s = sketches(spark, sf)
    c = centroids(s, "meannorm").select(F.col("k").alias("label"), "center")
    near = s.join(F.broadcast(c), "label").select("vec_id", "label", (dot("u", "center") / norm("center")).alias("cos"))
    ids = inspection.medoids(near, "label", "cos", "vec_id", 3).select("vec_id").unionByName(inspection.sample(near, "label", "vec_id", 5).select("vec_id"))
    return layout.ranked(ids.distinct(), "vec_id").orderBy("rank")


@query
def q103_upstream_filter(spark, sf):
    """single texts of one language and bounded length."""
    return preferences.upstream_filter(table(spark, sf, "documents")).select("doc_id", F.length("text").alias("n"))


@query
def q104_round_half_even(spark, sf):
    """Halves rounded to the even neighbour."""
    return sketches(spark, sf).select("vec_id", F.bround((F.col("vec_id") + 0.5).cast("double"), 0).alias("whole"), F.bround((F.col("vec_id") / 8).cast("double"), 2).alias("hundredths"))


@query
def q105_throughput(spark, sf):
    """Rows a second of a run's parts, and the hours that the whole would take."""
    runs = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return _round(metrics.throughput(runs, "n", "s", 210_000), "seconds", "seconds_a_row", "rows_a_second", "hours", "hours_by_shards")


@query
def q106_inspection_bundle(spark, sf):
    """What the report says of each cluster, in one row each."""
    s = sketches(spark, sf)
    c = centroids(s, "meannorm")
    cos = dot("u", "center") / (norm("u") * norm("center"))
    near = s.join(F.broadcast(c.select(F.col("k").alias("label"), "center")), "label").select("vec_id", "label", "gnorm", cos.alias("cos"))
    out = inspection.bundle(near, c, "label", "cos", "vec_id", "gnorm")
    return _round(out.select("label", "n", "share", "median_size", "eta_log_size", "other", "cos", "medoids", "others"), "share", "median_size", "eta_log_size", "cos")


@query
def q107_control_weights(spark, sf):
    """Uniform control weights from Python's own generator, one for each example; no SQL has it."""
    n = sketches(spark, sf).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    return control_weights(n, "idx", "n", 0.0, 1.0, 1234).select("idx", F.posexplode("weights").alias("t", "w"))
