"""Queries of long vectors and of what a clustering means: block means and sketches, components, the diagnostic, the report, the guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.vectors import dot, let, norm, unit
from quillon.operators import clustering, dense, directions, identity, inspection, layout, metrics, sketch
from quillon.operators.principal import principal, project
from quillon.plans.registry import query, round_columns as _round
from quillon.plans.surrogates import centroids, sketches, table
from quillon.sources import tables

#: Coordinates of a vector for components, of one whose mean is a dense state, of one in blocks, and of its blocks.
WIDE, DENSE, LONG, BLOCK = 128, 320, 2048, 512
#: Each coordinate of a short vector fades by this factor from one to the next, so that components differ in variance.
FADE = 0.85


def _coordinates(first, last):
    """Coordinates from *first* to *last* of a long vector, from the 64 of a short one."""
    one = lambda raw, j: F.get(raw, (j % 64).cast("int")) * F.pow(F.lit(FADE), j % 64) * (1 + (j * 31 % 97) / 97.0)
    return let(F.col("raw"), lambda raw: F.transform(F.sequence(first, last), lambda j: one(raw, j)))


def wide(s, n=WIDE):
    """s with x: *n* coordinates in one row."""
    return s.withColumn("x", _coordinates(F.lit(0), F.lit(n - 1)))


def long_blocks(s):
    """vec_id, label, gnorm, offset, x: LONG coordinates, a row for each block."""
    cut = s.withColumn("offset", F.explode(F.array(*[F.lit(a) for a in range(0, LONG, BLOCK)])))
    return cut.withColumn("x", _coordinates(F.col("offset"), F.least(F.col("offset") + BLOCK, F.lit(LONG)) - 1)).select("vec_id", "label", "gnorm", "offset", "x")


@query
def q108_structure_diagnostic(spark, sf):
    """Cosines of pairs and to the mean direction, principal shares, and the advice that follows."""
    s = layout.spread(wide(sketches(spark, sf)).select("vec_id", "x"))
    d = clustering.diagnose(s, "x", "vec_id", WIDE, top=4)
    out = d.select("mean_cos", "std_cos", *[F.get("quantiles", F.lit(k)).alias(f"q{k}") for k in range(5)], "mean_dir_mean", "mean_dir_min", *[F.get("pc_shares", F.lit(k)).alias(f"share{k + 1}") for k in range(4)], "pc_cumulative", "advice")
    return _round(out, *[c for c in out.columns if c != "advice"])


@query
def q109_principal_points(spark, sf):
    """Every point on the two leading axes, and the axes' shares.

    An axis has no direction of its own: here the point of the least id lies on the positive side.
    """
    s = layout.spread(wide(sketches(spark, sf)).select("vec_id", "label", "x"))
    found = principal(s, "x", WIDE, 2)
    placed = project(s, "x", found).drop("x")
    first = placed.agg(*[F.min_by(F.signum(f"pc{k}"), "vec_id").alias(f"_s{k}") for k in (1, 2)])
    shares = [F.lit(float(x)).alias(f"share{k + 1}") for k, x in enumerate(found.shares)]
    out = placed.crossJoin(F.broadcast(first)).select("vec_id", "label", *[(F.col(f"pc{k}") * F.col(f"_s{k}")).alias(f"pc{k}") for k in (1, 2)], *shares)
    return _round(out, "pc1", "pc2", "share1", "share2")


@query
def q110_block_means(spark, sf):
    """A1-A4: means of long vectors in blocks by cluster, under two weightings in one pass: each block's sum, squares and first coordinate."""
    m = dense.means(long_blocks(sketches(spark, sf)), "x", "label", weights={"plain": F.lit(1.0), "by_norm": F.col("gnorm")}, offset="offset")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    each = [F.struct(F.lit(w).alias("weighting"), F.size(w).alias("numel"), total(w).alias("total"), squares(w).alias("squares"), F.get(w, F.lit(0)).alias("first")) for w in ("plain", "by_norm")]
    return _round(m.select("label", "offset", "n", F.explode(F.array(*each)).alias("w")).select("label", "offset", "n", "w.*"), "total", "squares", "first")


@query
def q111_wide_centroids(spark, sf):
    """Cluster means of vectors too long for a column each in the plan, of vectors and of unit vectors, through the operator that directions use."""
    s = layout.spread(wide(sketches(spark, sf), DENSE).select("label", "x"))
    units = s.withColumn("x", unit("x"))
    kinds = [directions.vector_mean(v, "x", DENSE, "label").withColumn("kind", F.lit(k)) for v, k in ((s, "mean"), (units, "meannorm"))]
    out = kinds[0].unionByName(kinds[1]).select("kind", "label", "n_averaged", F.posexplode("center").alias("i", "value"))
    return _round(out, "value")


@query
def q112_block_sketch(spark, sf):
    """Count sketches and exact norms of long vectors that come in blocks."""
    k = sketch.block_sketch(long_blocks(sketches(spark, sf)), "vec_id", "offset", "x", 64, seed=7)
    return _round(k.select("vec_id", "n_blocks", "sketch_norm", F.posexplode("sketch").alias("b", "value")), "value", "sketch_norm")


def _report_inputs(spark, sf):
    """Points with their own cluster's cosine, and the texts that stand for their messages: parts of the document of their id."""
    s = sketches(spark, sf)
    c = centroids(s, "meannorm")
    cos = dot("u", "center") / (norm("u") * norm("center"))
    points = s.join(F.broadcast(c.select(F.col("k").alias("label"), "center")), "label").select("vec_id", "label", "gnorm", cos.alias("cos"))
    n = F.length("text")
    part = lambda a, b: F.substring(F.col("text"), a, b)
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull())
    texts = docs.select(F.col("doc_id").alias("vec_id"), part(F.lit(1), F.floor(n / 4).cast("int")).alias("prompt"), part(F.floor(n / 4).cast("int") + 1, n).alias("chosen"), part(F.lit(1), F.floor(n / 2).cast("int")).alias("rejected"))
    return points, texts, c


@query
def q113_inspection_report(spark, sf):
    """M12 in full: members, cohesion, nearest cluster, medians, three effect sizes, terms, and medoids and others with their texts."""
    points, texts, c = _report_inputs(spark, sf)
    out = inspection.report(points, texts, c, "label", "cos", "vec_id", "gnorm")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["vec_id"].cast("string"), F.coalesce(x["n_chosen"].cast("string"), F.lit("-")), F.coalesce(x["n_rejected"].cast("string"), F.lit("-")), F.md5(F.concat_ws("|", x["prompt"], x["chosen"], x["rejected"])))), ",")
    terms = F.coalesce(F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["count"].cast("string"))), ","), F.lit(""))
    numbers = ("share", "cohesion", "nearest_cos", "median_size", "eta_log_chosen", "eta_log_size", "eta_log_prompt")
    return _round(out.select("label", "n", "nearest", "median_chars", *numbers, terms.alias("terms"), shown("medoids").alias("medoids"), shown("others").alias("others")), *numbers)


@query
def q114_provenance_guard(spark, sf):
    """Products of one run are added to those in a folder; those of another run are refused and change nothing, unless told to overwrite."""
    s = sketches(spark, sf).select(F.col("vec_id").alias("idx"), "label", F.element_at("raw", 1).alias("dot"))
    path = tables.workspace(spark, "products")
    steps = [("full", 0, False), ("full", 1, False), ("sampled", 2, False), ("sampled", 3, True), ("full", 4, False), ("sampled", 5, False)]
    seen = []
    for source, part, overwrite in steps:
        rows = s.where(F.pmod("idx", F.lit(6)) == part).withColumn("source_id", F.lit(source))
        seen.append((part, source, identity.add_products(rows, path, overwrite=overwrite)))
    log = spark.createDataFrame(seen, "step int, source_id string, accepted boolean")
    held = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_held"), F.sum("dot").alias("dot_held"), F.min("source_id").alias("source_held"), F.count_distinct("source_id").alias("sources_held"))
    return _round(log.crossJoin(F.broadcast(held)), "dot_held")


@query
def q115_order_scans(spark, sf):
    """Running sums and ranks by keys that are sparse, negative, strings or pairs, over whole tables."""
    cents = F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("long")
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", cents.alias("cents"), F.md5(F.col("event_id").cast("string")).alias("name"))
    by_name = layout.prefix_sums(e, "name", "cents", "before_name", drop=("name",))
    by_pair = layout.prefix_sums(by_name, ["user_id", "event_id"], "cents", "before_pair", drop=("user_id",))
    placed = layout.ranked(by_pair, ["cents", "event_id"], "place", keys=("event_type",), drop=("cents",))
    return placed.select("event_id", "event_type", "before_name", "before_pair", "place")


@query
def q116_huge_channel(spark, sf):
    """Agreement of two channels, one of which holds nearly all rows; ranks are scanned, medians selected."""
    l = table(spark, sf, "lineitem").select(F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("i"), F.when(F.col("l_orderkey") % 100 == 0, "small").otherwise("huge").alias("channel"), F.col("l_extendedprice").alias("ref"), "l_quantity")
    l = l.withColumn("got", F.col("ref") * (1 + F.col("l_quantity") / 10000))
    out = metrics.compare(l, "channel")
    return _round(out.select("channel", "n", "max_abs", "rel_median", "rel_max", "slope", "corr", "spearman", "ok"), "max_abs", "rel_median", "rel_max", "slope", "corr", "spearman")


@query
def q117_exact_quantiles(spark, sf):
    """Exact quantiles of groups of any size, interpolated and lower, by sketches and a counting pass."""
    from quillon.operators.quantiles import LINEAR, LOWER, quantiles

    l = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    each = [quantiles(l, "l_extendedprice", probs, "l_returnflag", kind=k).withColumn("kind", F.lit(k)) for k in (LINEAR, LOWER)]
    return _round(each[0].unionByName(each[1]).select("kind", "l_returnflag", *[F.get("quantiles", F.lit(k)).alias(f"q{k}") for k in range(5)]), *[f"q{k}" for k in range(5)])
