"""What a clustering means: effect sizes, distinctive terms, medoids, neighbours, a report."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.hashing import hash32
from quillon.functions.vectors import at_least, dot, norm
from quillon.operators import principal as components
from quillon.operators.principal import principal
from quillon.operators.quantiles import quantiles

# Words that are no terms.
STOPWORDS = """
a an the and or but if then than that this these those of to in on for with as at by
from is are was were be been being it its i you he she they we me him her them my your his their our
not no do does did doing done have has had having will would can could should may might must s t
what which who whom when where why how all any both each few more most other some such only own same
so too very just about into through during before after above below up down out off over under again
there here also
""".split()
TERM = "[a-z][a-z']+"
MIN_TERM_LENGTH, MIN_TERM_COUNT, TOP_TERMS, TOP_MEDOIDS = 3, 15, 12, 10
DISPLAY_CHARS, SCATTER_POINTS = 1200, 4000

#: The C library's logarithm.  Odds that are equal but for their last bit come in the order of their logarithms' last bits,
#: and F.log rounds some of these another way.
_log = F.udf(math.log, T.DoubleType())


def eta_squared(df: DataFrame, value, cluster: str) -> DataFrame:
    """The share of the spread of *value* that lies between clusters; 0 without spread.  One pass of sums."""
    x = value
    sums = df.groupBy(cluster).agg(F.count(x).cast("double").alias("n"), F.sum(x).alias("s"), F.avg(x).alias("m"))
    grand = sums.agg((F.sum("s") / F.sum("n")).alias("grand"))
    between = sums.crossJoin(F.broadcast(grand)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"))
    within = df.select(x.alias("_x")).crossJoin(F.broadcast(grand)).agg(F.sum(F.pow(F.col("_x") - F.col("grand"), 2)).alias("total"))
    return between.crossJoin(within).select(F.when(F.col("total") > 0, F.col("between") / F.col("total")).otherwise(0.0).alias("eta_squared"))


def term_counts(docs: DataFrame, text: str, cluster: str) -> DataFrame:
    """(cluster, term, count).  Counted in one pass; every total follows from this table."""
    words = docs.select(cluster, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term"))
    words = words.where((F.length("term") >= MIN_TERM_LENGTH) & ~F.col("term").isin(STOPWORDS))
    return words.groupBy(cluster, "term").agg(F.count(F.lit(1)).alias("c"))


def distinctive_terms(docs: DataFrame, text: str, cluster: str, top: int = TOP_TERMS, least: int = MIN_TERM_COUNT) -> DataFrame:
    """Terms by smoothed log-odds against the corpus, the *top* of each cluster (O3)."""
    counts = term_counts(docs, text, cluster)
    corpus = counts.groupBy("term").agg(F.sum("c").alias("tot"))
    own = counts.groupBy(cluster).agg(F.sum("c").alias("n_k"))
    whole = corpus.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("v"), F.greatest(F.coalesce(F.sum("tot"), F.lit(0)), F.lit(1)).alias("n_all"))
    odds = _log(((F.col("c") + 1) / (F.col("n_k") + F.col("v"))) / ((F.col("tot") + 1) / (F.col("n_all") + F.col("v"))))
    scored = counts.where(F.col("c") >= least).join(corpus, "term").join(F.broadcast(own), cluster).crossJoin(F.broadcast(whole)).withColumn("logodds", odds)
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("logodds"), F.desc("term"), F.desc("c")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(cluster, "rank", "term", "c", "logodds")


def medoids(points: DataFrame, cluster: str, cos: str, id: str, top: int = TOP_MEDOIDS) -> DataFrame:
    """O2: the members nearest to their centroid."""
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(cos), id))
    return points.withColumn("rank", rank).where(F.col("rank") <= top)


def sample(points: DataFrame, cluster: str, id: str, n: int, seed: int = 1234, without: DataFrame | None = None) -> DataFrame:
    """A seeded sample of each cluster without replacement, disjoint from *without*; a place in hash order."""
    if without is not None:
        points = points.join(without.select(id).distinct(), id, "left_anti")
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(hash32(id, "sample", seed), id))
    return points.withColumn("rank", rank).where(F.col("rank") <= n)


def agreement(points: DataFrame, a: str, b: str) -> DataFrame:
    """How often two labels agree."""
    return points.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def nearest_other(centroids: DataFrame, k: str = "k", center: str = "center") -> DataFrame:
    """Each centroid's nearest other one; as many rows as clusters on both sides."""
    a = centroids.select(F.col(k).alias("k"), F.col(center).alias("_a"))
    b = centroids.select(F.col(k).alias("other"), F.col(center).alias("_b"))
    both = a.join(F.broadcast(b), F.col("k") != F.col("other")).withColumn("cos", dot("_a", "_b") / (at_least(norm("_a")) * at_least(norm("_b"))))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("cos"), "other"))
    return both.withColumn("_r", rank).where("_r = 1").select("k", "other", "cos")


def pca_2d(points: DataFrame, v: str, dim: int) -> tuple[list[list[float]], list[float]]:
    """The two leading axes from the covariance of all rows, and their shares."""
    found = principal(points, v, dim, 2)
    return found.axes.tolist(), found.shares.tolist()


def project(points: DataFrame, v: str, axes: list[list[float]]) -> DataFrame:
    """Coordinates of each point on given axes."""
    return points.withColumns({f"pc{k + 1}": dot(F.col(v), F.array(*[F.lit(float(x)) for x in axis])) for k, axis in enumerate(axes)})


def _median(points: DataFrame, cluster: str, value, out: str) -> DataFrame:
    return quantiles(points, value, [0.5], cluster, out="_q").select(cluster, F.get("_q", F.lit(0)).alias(out))


def bundle(points: DataFrame, centroids: DataFrame, cluster: str, cos: str, id: str, size: str, top: int = 3, seed: int = 1234) -> DataFrame:
    """M12 without texts: a row for each cluster: members, share, effect size and median of *size*, nearest other cluster, medoids and others."""
    eta = eta_squared(points, F.log(F.col(size)), cluster).withColumnRenamed("eta_squared", "eta_log_size")
    n = points.agg(F.count(F.lit(1)).alias("_n"))
    rows = points.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).join(_median(points, cluster, size, "median_size"), cluster, "left")
    best = medoids(points, cluster, cos, id, top)
    some = sample(points, cluster, id, top, seed, without=best)
    ids = lambda df, out: df.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", id))), lambda x: x[id].cast("string")), ",").alias(out))
    near = nearest_other(centroids).withColumnRenamed("k", cluster)
    rows = rows.join(F.broadcast(near), cluster, "left").join(ids(best, "medoids"), cluster, "left").join(ids(some, "others"), cluster, "left")
    return rows.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(eta)).withColumn("share", F.col("n") / F.col("_n")).drop("_n")


def log_size(value: Column) -> Column:
    """The logarithm of a length or norm, none below that of 1."""
    return F.log(F.greatest(value.cast("double"), F.lit(1.0)))


def report(points: DataFrame, texts: DataFrame, centroids: DataFrame, cluster: str, cos: str, id: str, size: str, top: int = TOP_MEDOIDS, seed: int = 1234) -> DataFrame:
    """M12 in full: a row for each cluster.

    *points* (id, cluster, cos, size) meet *texts* (id, prompt, chosen, rejected) once, all of them for the statistics: size, share,
    cohesion, nearest other cluster, medians of the chosen text's length and of *size*, the three effect sizes (logarithms of chosen
    length, of *size* and of prompt length; equal in all rows), the distinctive terms of the chosen texts, and the *top* medoids
    and as many other members with their texts as displayed.  Texts are null where *texts* lacks an id: such points count
    for members, cohesion and *size* alone.
    """
    met = points.select(id, cluster, cos, size).join(texts.select(id, "prompt", "chosen", "rejected"), id, "left")
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    lengths = met.where(F.col("chosen").isNotNull()).withColumns({"_chosen": length("chosen"), "_prompt": length("prompt")})
    etas = [eta_squared(lengths, log_size(F.col(c)), cluster).withColumnRenamed("eta_squared", out) for c, out in (("_chosen", "eta_log_chosen"), (size, "eta_log_size"), ("_prompt", "eta_log_prompt"))]
    n = points.agg(F.count(F.lit(1)).alias("_n"))
    rows = points.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(cos).alias("cohesion"))
    rows = rows.join(_median(points, cluster, size, "median_size"), cluster, "left").join(_median(lengths, cluster, F.col("_chosen"), "median_chars"), cluster, "left")
    terms = distinctive_terms(met.select(cluster, "chosen"), "chosen", cluster)
    terms = terms.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", "term", F.col("c").alias("count"), "logodds"))).alias("terms"))
    best = medoids(points, cluster, cos, id, top)
    some = sample(points, cluster, id, top, seed, without=best)
    shown = best.select(id, "rank", F.lit("medoids").alias("_kind")).unionByName(some.select(id, "rank", F.lit("others").alias("_kind")))
    cut = [F.substring(c, 1, DISPLAY_CHARS).alias(c) for c in ("prompt", "chosen", "rejected")]
    packed = met.join(F.broadcast(shown), id).select(cluster, "_kind", F.struct("rank", id, F.col(cos).alias("cos"), F.col(size).alias("size"), F.length("chosen").alias("n_chosen"), F.length("rejected").alias("n_rejected"), *cut).alias("x"))
    listed = packed.groupBy(cluster).agg(*[F.array_sort(F.collect_list(F.when(F.col("_kind") == kind, F.col("x")))).alias(kind) for kind in ("medoids", "others")])
    near = nearest_other(centroids).select(F.col("k").alias(cluster), F.col("other").alias("nearest"), F.col("cos").alias("nearest_cos"))
    for extra in (F.broadcast(near), terms, listed):
        rows = rows.join(extra, cluster, "left")
    for one in (n, *etas):
        rows = rows.crossJoin(F.broadcast(one))
    return rows.withColumns({"share": F.col("n") / F.col("_n"), "median_chars": F.floor("median_chars")}).drop("_n")


def scatter(points: DataFrame, v: str, dim: int, id: str, cluster: str, most: int = SCATTER_POINTS, seed: int = 1234) -> tuple[DataFrame, components.Components]:
    """At most *most* seeded points with their places on the two leading axes of all points, and these."""
    found = principal(points, v, dim, 2)
    some = points.select(id, cluster, v).orderBy(hash32(id, "scatter", seed), id).limit(most)
    return components.project(some, v, found).drop(v), found


def best_restarts(runs: DataFrame, k: str = "K", restart: str = "restart", objective: str = "objective") -> DataFrame:
    """For each K the run of the greatest objective, the first among equals."""
    place = F.row_number().over(Window.partitionBy(k).orderBy(F.desc(objective), restart))
    return runs.withColumn("_place", place).where("_place = 1").drop("_place")


def html_report(summary: DataFrame, title: str = "Clusters") -> str:
    """K9: a page of its own with the rows of *summary* (a row per cluster) as JSON that cannot end its script element."""
    rows = [json.loads(r[0]) for r in summary.select(F.to_json(F.struct(*summary.columns))).collect()]
    data = json.dumps(rows, ensure_ascii=False).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    title = title.replace("&", "&amp;").replace("<", "&lt;")
    return (
        f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><table id=t></table><script>const rows={data};"
        "const cells=(r,tag)=>'<tr>'+r.map(x=>{const d=document.createElement('div');d.textContent=typeof x==='object'?JSON.stringify(x):x;"
        "return `<${tag}>${d.innerHTML}</${tag}>`}).join('')+'</tr>';if(rows.length){const k=Object.keys(rows[0]);"
        "document.getElementById('t').innerHTML=cells(k,'th')+rows.map(r=>cells(k.map(c=>r[c]??''),'td')).join('')}</script>"
    )
