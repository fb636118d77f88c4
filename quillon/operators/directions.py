"""Reference directions and the scores of token vectors against them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import at_least, cosine, dot, norm
from quillon.operators import dense

DOT_SCALES = ("raw", "unit", "aggregated")
KINDS = ("mean", "meannorm")
BASES = tuple(f"{kind}_{weighting}" for kind in ("single", "aggregated", "max") for weighting in ("unweighted", "weighted_norm1", "weighted_norm2"))
#: Coordinates up to which a mean has a column for each in the plan.
PLAN_COORDINATES = 256
_CLUSTER = re.compile(r"(clusteronly|maxclu)_(mean|meannorm)_K(\d+)")


def vector_mean(df: DataFrame, v: str, dim: int, *keys: str, out: str = "center", count: str | None = "n_averaged") -> DataFrame:
    """The mean vector of each group.

    Up to PLAN_COORDINATES one average per coordinate, so partial sums are combined before the shuffle; longer vectors
    have dense states of blocks (:mod:`quillon.operators.dense`), and the plan has one size for all of them.
    """
    if dim > PLAN_COORDINATES:
        return dense.whole(dense.means(df, v, *keys), *keys, count=count).withColumnRenamed("mean", out)
    means = [F.avg(F.get(F.col(v), F.lit(i))) for i in range(dim)]
    counts = [F.count(F.lit(1)).alias(count)] if count else []
    return df.groupBy(*keys).agg(F.array(*means).alias(out), *counts)


def vector_mean_long(df: DataFrame, v: str, *keys: str, out: str = "value") -> DataFrame:
    """The same means as rows (keys, i, value), for readers that want coordinates."""
    blocks = dense.means(df, v, *keys)
    return blocks.select(*keys, "offset", F.posexplode("mean").alias("_i", out)).select(*keys, (F.col("offset") + F.col("_i")).cast("int").alias("i"), out)


def weighted_means(df: DataFrame, v: str, weights: dict[str, Column], dim: int, *keys: str) -> DataFrame:
    """A1: the mean of weight times vector for several weightings in one pass: keys, n_averaged and a vector for each name."""
    if dim > PLAN_COORDINATES:
        return dense.whole(dense.means(df, v, *keys, weights=weights), *keys, names=tuple(weights))
    each = [F.array(*[F.avg(w * F.get(F.col(v), F.lit(i))) for i in range(dim)]).alias(name) for name, w in weights.items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_averaged"), *each)


def resolve(name: str) -> dict:
    """What a direction is made of: base directions to load, and kind and K of the clusters if any; unknown names raise."""
    if m := _CLUSTER.fullmatch(name):
        single = m[1] == "maxclu"
        return {"family": m[1], "kind": m[2], "K": int(m[3]), "bases": ["single_unweighted"] if single else []}
    if name not in BASES:
        raise ValueError(f"unknown direction {name!r}")
    family, _, weighting = name.partition("_")
    return {"family": family, "kind": None, "K": None, "bases": [f"single_{weighting}", f"aggregated_{weighting}"] if family == "max" else [name]}


def direction_name(prefix: str, kind: str, k: int) -> str:
    return f"{prefix}_{kind}_K{k}"


def dot_scale(mode: str, own_norm: str | Column, mean_norm: str | Column) -> Column:
    """The factor of a cluster's dots: 1, 1 / |c|, or |mean| / |c|."""
    own, mean = (F.col(c) if isinstance(c, str) else c for c in (own_norm, mean_norm))
    if mode == "raw":
        return F.lit(1.0)
    if mode == "unit":
        return 1 / at_least(own)
    if mode == "aggregated":
        return mean / at_least(own)
    raise ValueError(f"unknown dot scale {mode!r}; known: {', '.join(DOT_SCALES)}")


def centroid_array(centroids: DataFrame, k: str = "k", center: str = "center", factor: Column | None = None) -> DataFrame:
    """All centroids as one row with an array, to be sent to every task: as many as there are clusters."""
    one = F.struct(F.col(k).alias("k"), F.col(center).alias("center"), at_least(norm(center)).alias("norm"), (F.lit(1.0) if factor is None else factor).alias("factor"))
    return centroids.agg(F.array_sort(F.collect_list(one)).alias("_centroids"))


def nearest_centroid(points: DataFrame, centroids: DataFrame, v: str = "v", out: str = "cluster", best: str = "cos") -> DataFrame:
    """*points* with the centroid of greatest cosine, the least k among equals, without a shuffle of the points."""
    scored = points.crossJoin(F.broadcast(centroid_array(centroids)))
    own = at_least(norm(v))
    scores = F.transform("_centroids", lambda c: F.struct((dot(F.col(v), c["center"]) / (own * c["norm"])).alias("s"), (-c["k"]).alias("minus_k")))
    return scored.withColumn("_best", F.array_max(scores)).select(*points.columns, (-F.col("_best.minus_k")).alias(out), F.col("_best.s").alias(best))


def cluster_scores(tokens: DataFrame, centroids: DataFrame, v: str, g_norm: str, factor: Column | None = None) -> DataFrame:
    """The greatest scaled dot and the greatest cosine over all centroids, each for itself."""
    scored = tokens.crossJoin(F.broadcast(centroid_array(centroids, factor=factor)))
    dots = F.transform("_centroids", lambda c: dot(F.col(v), c["center"]) * c["factor"])
    cosines = F.transform("_centroids", lambda c: dot(F.col(v), c["center"]) / (c["norm"] * at_least(g_norm)))
    return scored.withColumns({"dot": F.array_max(dots), "cos": F.array_max(cosines)}).drop("_centroids")


def single_scores(tokens: DataFrame, own: DataFrame, key: str, v: str, g_norm: str) -> DataFrame:
    """Dot and cosine with the example's own direction (a join on the example, never all pairs)."""
    joined = tokens.join(own.select(key, F.col("center").alias("_c")), key)
    return joined.withColumn("dot", dot(v, "_c")).withColumn("cos", cosine("dot", g_norm, norm("_c"))).drop("_c")


def aggregated_scores(tokens: DataFrame, mean: DataFrame, v: str, g_norm: str) -> DataFrame:
    """Dot and cosine with the mean direction of the data set, one broadcast row."""
    joined = tokens.crossJoin(F.broadcast(mean.select(F.col("center").alias("_c"))))
    return joined.withColumn("dot", dot(v, "_c")).withColumn("cos", cosine("dot", g_norm, norm("_c"))).drop("_c")


def larger_scores(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Dots and cosines of two directions, each maximised for itself."""
    other = b.select(*keys, F.col("dot").alias("_dot"), F.col("cos").alias("_cos"))
    joined = a.join(other, list(keys))
    return joined.withColumns({"dot": F.greatest("dot", "_dot"), "cos": F.greatest("cos", "_cos")}).drop("_dot", "_cos")


def all_scores(tokens: DataFrame, directions: DataFrame, v: str, g_norm: str, name: str = "direction") -> DataFrame:
    """A row for every token and every direction; the directions are one broadcast row, as many as have names."""
    one = F.struct(F.col(name).alias("name"), F.col("center").alias("center"), norm("center").alias("norm"))
    table = directions.agg(F.array_sort(F.collect_list(one)).alias("_d"))
    every = tokens.crossJoin(F.broadcast(table)).withColumn("_one", F.explode("_d"))
    scored = every.withColumn("dot", dot(F.col(v), F.col("_one.center"))).withColumn("cos", cosine("dot", g_norm, F.col("_one.norm")))
    return scored.withColumn(name, F.col("_one.name")).drop("_d", "_one")


def direction_scores(
    name: str, tokens: DataFrame, own: DataFrame, mean: DataFrame, clusters: dict[tuple[str, int], DataFrame], key: str, v: str, g_norm: str,
    dot_scale_mode: str = "unit", cluster_base: str = "unweighted",
) -> DataFrame:
    """D6, N-3: the plan that a direction's name stands for: tokens with dot and cos.

    *own* has a vector column for each weighting by example, *mean* one row of the same columns, *clusters* the
    centroids of each (kind, K).  One pass over the tokens, whose own and mean directions are columns beside them.
    """
    spec = resolve(name)
    if spec["K"] is not None:
        table = clusters.get((spec["kind"], spec["K"]))
        if table is None:
            raise ValueError(f"no centroids for {name!r}")
        factor = dot_scale(dot_scale_mode, norm("center"), F.lit(1.0))
        scored = cluster_scores(tokens, table, v, g_norm, factor=factor)
        if not spec["bases"]:
            return scored
        scored = scored.join(own.select(key, F.col(cluster_base).alias("_o")), key)
        single = dot(v, "_o")
        return scored.withColumns({"dot": F.greatest("dot", single), "cos": F.greatest("cos", cosine(single, g_norm, norm("_o")))}).drop("_o")
    _, _, weighting = name.partition("_")
    vectors = []
    if spec["family"] != "aggregated":
        tokens = tokens.join(own.select(key, F.col(weighting).alias("_o")), key)
        vectors.append("_o")
    if spec["family"] != "single":
        tokens = tokens.crossJoin(F.broadcast(mean.select(F.col(weighting).alias("_m"))))
        vectors.append("_m")
    dots = [dot(v, c) for c in vectors]
    cosines = [cosine(d, g_norm, norm(c)) for d, c in zip(dots, vectors)]
    most = lambda xs: xs[0] if len(xs) == 1 else F.greatest(*xs)
    return tokens.withColumns({"dot": most(dots), "cos": most(cosines)}).drop(*vectors)


def named_scores(
    names: list[str], tokens: DataFrame, own: DataFrame, mean: DataFrame, clusters: dict[tuple[str, int], DataFrame], key: str, v: str, g_norm: str,
    dot_scale_mode: str = "unit", cluster_base: str = "unweighted", out: str = "direction",
) -> DataFrame:
    """:func:`direction_scores` of many names in one plan: a row (tokens' columns, *out*, dot, cos) for each token and name.

    The tokens meet their own vectors by one join and the means and centroids as broadcast rows; each vector's dot is one column,
    whatever number of names looks at it.
    """
    specs = {name: resolve(name) for name in names}
    weighting = lambda name: name.partition("_")[2]
    with_own = {cluster_base if s["family"] == "maxclu" else weighting(n) for n, s in specs.items() if s["family"] in ("single", "max", "maxclu")}
    with_mean = {weighting(n) for n, s in specs.items() if s["family"] in ("aggregated", "max")}
    tables = sorted({(s["kind"], s["K"]) for s in specs.values() if s["K"] is not None})
    if missing := [t for t in tables if clusters.get(t) is None]:
        raise ValueError(f"no centroids for {missing}")
    kept, scored, columns = tokens.columns, tokens, {}
    if with_own:
        scored = scored.join(own.select(key, *[F.col(w).alias(f"_o_{w}") for w in sorted(with_own)]), key)
    if with_mean:
        scored = scored.crossJoin(F.broadcast(mean.select(*[F.col(w).alias(f"_m_{w}") for w in sorted(with_mean)])))
    for side, found in (("o", with_own), ("m", with_mean)):
        for w in found:
            columns |= {f"_d{side}_{w}": dot(v, f"_{side}_{w}"), f"_n{side}_{w}": norm(f"_{side}_{w}")}
    for i, table in enumerate(tables):
        scored = scored.crossJoin(F.broadcast(centroid_array(clusters[table], factor=dot_scale(dot_scale_mode, norm("center"), F.lit(1.0))).withColumnRenamed("_centroids", f"_c_{i}")))
        dots = F.transform(f"_c_{i}", lambda c: F.struct((dot(F.col(v), c["center"]) * c["factor"]).alias("dot"), (dot(F.col(v), c["center"]) / (c["norm"] * at_least(g_norm))).alias("cos")))
        columns[f"_s_{i}"] = dots
    scored = scored.withColumns(columns)

    def score(name: str) -> Column:
        s, parts = specs[name], []
        if s["K"] is not None:
            i = tables.index((s["kind"], s["K"]))
            parts.append((F.array_max(F.col(f"_s_{i}")["dot"]), F.array_max(F.col(f"_s_{i}")["cos"])))
        for side, used in (("o", s["family"] in ("single", "max", "maxclu")), ("m", s["family"] in ("aggregated", "max"))):
            if used:
                w = cluster_base if s["family"] == "maxclu" else weighting(name)
                parts.append((F.col(f"_d{side}_{w}"), cosine(f"_d{side}_{w}", g_norm, f"_n{side}_{w}")))
        most = lambda xs: xs[0] if len(xs) == 1 else F.greatest(*xs)
        return F.struct(F.lit(name).alias(out), most([d for d, _ in parts]).alias("dot"), most([c for _, c in parts]).alias("cos"))

    return scored.select(*kept, F.explode(F.array(*[score(n) for n in names])).alias("_x")).select(*kept, f"_x.{out}", "_x.dot", "_x.cos")
