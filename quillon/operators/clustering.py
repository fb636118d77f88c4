"""Spherical k-means, its diagnostics and evaluation.

The driver holds the centroids alone: K rows of one dimension.  Points are never shuffled; each iteration is one pass
that assigns by an array of centroids sent to the tasks and sums members by cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.hashing import uniform
from quillon.functions.vectors import at_least, dot, norm, subtract, unit
from quillon.operators.directions import nearest_centroid, vector_mean
from quillon.operators.layout import ranked
from quillon.operators.principal import principal
from quillon.operators.quantiles import quantiles
from quillon.sources.tables import staged

MIN_CLUSTER_SIZE = 200
ITERATIONS, TOLERANCE, RESTARTS = 50, 1e-5, 3
#: Of k-means||: rounds, candidates a round (twice the greatest K, where that is more), and tries at reclustering them.
ROUNDS, DRAWN, SETTLED = 5, 256, 3
# The numbers of clusters of a sweep, and the pairs of a cosine diagnostic.
K_SWEEP = (2, 4, 8, 16, 32, 64, 128)
PAIR_SAMPLE = 200_000
#: Points that a task holds against the centroids at a time, so that their cosines stay in its cache.
CHUNK = 512
#: Points that are sent to the tasks that draw pairs take no more.
SENT_BYTES = 64 << 20
PAIR_QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)


def centered(points: DataFrame, v: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Points less their mean, brought to the sphere, and the mean as a one-row table."""
    mean = vector_mean(points, v, dim, out="center")
    moved = points.crossJoin(F.broadcast(mean.select(F.col("center").alias("_m"))))
    return moved.withColumn(v, unit(subtract(v, "_m"))).drop("_m"), mean


def _table(df: DataFrame, centers: list) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(centers)], "k int, center array<double>")


def step(points: DataFrame, centroids: DataFrame, v: str, dim: int, id: str) -> tuple[DataFrame, float]:
    """One iteration (M7): assign, sum members, give empty clusters the worst-fit points, renormalise.

    Returns the new centroids, one row for each k, and the objective, the mean cosine to the assigned centroid.
    """
    assigned = nearest_centroid(points, centroids, v)
    means = [F.avg(F.get(F.col(v), F.lit(i))) for i in range(dim)]
    sums = assigned.groupBy(F.col("cluster").alias("k")).agg(F.array(*means).alias("center"), F.count(F.lit(1)).alias("n"), F.sum("cos").alias("s")).collect()
    centers = {r["k"]: r["center"] for r in sums}
    total = sum(r["n"] for r in sums)
    ks = [r["k"] for r in centroids.select("k").orderBy("k").collect()]
    empty = [k for k in ks if k not in centers]
    if empty:
        for k, r in zip(empty, worst_fit(assigned, id, len(empty)).select(v).collect()):
            centers[k] = r[0]
    spark = points.sparkSession
    new = spark.createDataFrame([(k, centers.get(k)) for k in ks], "k int, center array<double>")
    return new.withColumn("center", unit("center")), sum(r["s"] for r in sums) / total if total else None


def worst_fit(assigned: DataFrame, id: str, n: int) -> DataFrame:
    """The *n* points with the least cosine to their centroid, least first; ties by id."""
    return assigned.orderBy("cos", id).limit(n)


def plus_plus(points: DataFrame, v: str, id: str, k: int, seed: int) -> list:
    """M6: the vectors of :func:`plus_plus_ids`."""
    return [center for _, center in plus_plus_ids(points, v, id, k, seed)]


def plus_plus_ids(points: DataFrame, v: str, id: str, k: int, seed: int) -> list[tuple]:
    """M6: (id, vector) of the first point of the seeded order, then points with probability as their squared cosine distance.

    The draw is by exponential clocks: the point with the least -log(u) / d2 is one drawn in proportion to d2, so a
    draw is one partial aggregation and no cumulative sum over the table.
    """
    one = F.struct(F.col(id).alias("id"), F.col(v).alias("v"))
    first = points.agg(F.min_by(one, F.struct(uniform(id, f"first{seed}"), F.col(id)))).first()[0]
    if first is None:
        return []
    found = [tuple(first)]
    while len(found) < k:
        table = _table(points, [c for _, c in found]).withColumn("center", unit("center"))
        d = F.greatest(F.lit(0.0), 1 - F.col("cos"))
        near = nearest_centroid(points, table, v).withColumn("_d", d * d)
        clock = -F.log(1 - uniform(id, f"pick{seed}:{len(found)}")) / at_least("_d", 1e-300)
        found.append(tuple(near.agg(F.min_by(one, F.struct(clock, F.col(id)))).first()[0]))
    return found


def spherical_kmeans(points: DataFrame, v: str, id: str, dim: int, k: int, seed: int = 0, iterations: int = ITERATIONS, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame, float]:
    """(points with cluster and cos, centroids, objective).  Stops when the objective gains less than TOLERANCE."""
    rows = points.select(F.col(id).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v")).persist()
    try:
        if start is None:
            found = _parallel_starts(rows, [(k, seed)])
        else:
            given = np.array([r["center"] for r in start.orderBy("k").collect()], float)
            found = {(k, seed): given / np.maximum(np.linalg.norm(given, axis=1, keepdims=True), 1e-12)}
        found = _converged(rows, found, dim, iterations) if rows.count() else {(k, seed): np.zeros((0, dim))}
    finally:
        rows.unpersist()
    centroids = _table(points, found[k, seed].tolist())
    assigned = nearest_centroid(points, centroids, v)
    return assigned, centroids, assigned.agg(F.avg("cos")).first()[0]


def _converged(rows: DataFrame, found: dict, dim: int, iterations: int) -> dict:
    """The centroids of each run after as many moves as it takes, all runs in one pass over the points a move."""
    found, best, done = dict(found), {r: -2.0 for r in found}, set()
    for _ in range(iterations):
        live = [r for r in found if r not in done]
        if not live:
            break
        sums = _sums(rows, {r: found[r] for r in live}, dim)
        empty = {r: [k for k in range(len(found[r])) if k not in sums[r]] for r in live if r in sums}
        worst = _worst(rows, found, {r: ks for r, ks in empty.items() if ks})
        for r in live:
            found[r], objective = _moved(found[r], sums.get(r, {}), worst.get(r, {}))
            if objective is None or objective - best[r] < TOLERANCE:
                done.add(r)
            else:
                best[r] = objective
    return found


def k_sweep(points: DataFrame, v: str, id: str, dim: int, ks: tuple[int, ...] = K_SWEEP, restarts: int = RESTARTS, iterations: int = ITERATIONS) -> DataFrame:
    """M8: for each K below the number of points the best restart by objective, the first among equals.

    All runs, K by restart, go through the points together: a pass draws candidates for the starts of all runs, or moves
    the centroids of each run that has not converged.  The driver holds the centroids of all runs.
    """
    rows = points.select(F.col(id).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v")).persist()
    try:
        n = rows.count()
        runs = [(k, seed) for k in ks if k < n for seed in range(restarts)]
        found = _converged(rows, _parallel_starts(rows, runs), dim, iterations)
        last = _sums(rows, found, dim)
        scored = [(k, seed, sum(x[1] for x in last[k, seed].values()) / n) for k, seed in runs]
    finally:
        rows.unpersist()
    top = {}
    for k, seed, objective in scored:
        if k not in top or objective > top[k][2]:
            top[k] = (k, seed, float(objective))
    return points.sparkSession.createDataFrame(list(top.values()), "K int, restart int, objective double")


def _near(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first among equals, and the cosine to it."""
    k, cos = np.zeros(len(x), np.int64), np.zeros(len(x))
    c = _units(centers).T
    for a in range(0, len(x), CHUNK):
        each = _units(x[a : a + CHUNK]) @ c
        k[a : a + CHUNK] = each.argmax(1)
        cos[a : a + CHUNK] = each[np.arange(len(each)), k[a : a + CHUNK]]
    return k, cos


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _parallel_starts(rows: DataFrame, runs: list[tuple[int, int]]) -> dict:
    """The starting centroids of all runs by k-means||: ROUNDS passes oversample, one weighs, the driver reclusters.

    A pass draws each point on its own, with a chance in proportion to its squared distance from the candidates so far,
    DRAWN of them in expectation, or all points where they are fewer.  Candidates of a seed serve its runs of every K: weighted
    by the points nearest to them they are what k-means++ draws from, and weighted moves settle.  The driver holds about
    ROUNDS * DRAWN candidates of each seed, whatever the number of points; draws are repeatable, and those of a run alone.
    """
    found: dict = {}
    seeds = sorted({seed for _, seed in runs})
    if not runs:
        return found
    firsts = rows.agg(*[F.min_by("v", F.struct(uniform("id", f"first{seed}"), "id")) for seed in seeds]).first()
    pool = {seed: np.array([firsts[i]], float) for i, seed in enumerate(seeds)}
    cost, most = None, max((k for k, _ in runs if k > max(K_SWEEP)), default=0)
    for round_ in range(ROUNDS):
        if cost is None:
            cost = _nearest_sums(rows, pool)[0]
        near = _with_distances(rows, pool)
        chance = lambda s: max(DRAWN, 2 * most) * F.col(f"d{s}") / max(cost[s], 1e-300)
        hits = F.filter(F.array(*[F.when(uniform("id", f"draw{s}:{round_}") < chance(s), F.lit(s)) for s in seeds]), lambda x: x.isNotNull())
        drawn = near.select("id", "v", F.explode(hits).alias("seed")).orderBy("seed", "id").collect()
        for s in seeds:
            new = [r["v"] for r in drawn if r["seed"] == s]
            if new:
                pool[s] = np.vstack([pool[s], np.array(new, float)])
        cost, weights = _nearest_sums(rows, pool)
    return {(k, seed): _recluster(pool[seed], weights[seed], k, seed) for k, seed in runs}


def _with_distances(rows: DataFrame, pool: dict[int, np.ndarray]) -> DataFrame:
    """*rows* with the squared cosine distance to the nearest candidate of each seed."""

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                d = [np.maximum(1 - _near(x, c)[1], 0) ** 2 for c in pool.values()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), *map(pa.array, d)], names=["id", "v", *(f"d{s}" for s in pool)])

    return rows.mapInArrow(far, "id long, v array<double>, " + ", ".join(f"d{s} double" for s in pool))


def _nearest_sums(rows: DataFrame, pool: dict[int, np.ndarray]) -> tuple[dict, dict]:
    """For each seed the sum of squared distances to its candidates, and how many points are nearest to each."""
    order = list(pool)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n = np.zeros(len(order)), [np.zeros(len(pool[s]), np.int64) for s in order]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                for i, s in enumerate(order):
                    k, cos = _near(x, pool[s])
                    d[i] += (np.maximum(1 - cos, 0) ** 2).sum()
                    n[i] += np.bincount(k, minlength=len(n[i]))
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(d), pa.array([x.tolist() for x in n], pa.list_(pa.int64()))], names=["seed", "d", "n"])

    parts = rows.mapInArrow(add, "seed long, d double, n array<long>").select("seed", "d", F.posexplode("n").alias("i", "n"))
    cost, weights = dict.fromkeys(order, 0.0), {s: np.zeros(len(pool[s])) for s in order}
    for r in parts.groupBy("seed", "i").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect():  # a row for each candidate
        weights[r["seed"]][r["i"]], cost[r["seed"]] = r["n"], r["d"]
    return cost, weights


def _recluster(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ over the candidates and the weighted moves after it, the best of SETTLED tries.

    Where fewer than *k* candidates differ, the last ones repeat; a later move gives such a centroid the worst-fit point.
    """
    unit_rows = candidates / np.maximum(np.linalg.norm(candidates, axis=1, keepdims=True), 1e-12)
    best, top = None, -np.inf
    for attempt in range(SETTLED):
        r = np.random.default_rng([seed, k, attempt])
        w = np.maximum(weights, 1e-9)
        chosen = [int(r.choice(len(w), p=w / w.sum()))]
        far = np.maximum(1 - unit_rows @ unit_rows[chosen[0]], 0) ** 2
        while len(chosen) < k:
            p = w * far
            chosen.append(int(r.choice(len(w), p=p / p.sum())) if p.sum() > 0 else chosen[-1])
            far = np.minimum(far, np.maximum(1 - unit_rows @ unit_rows[chosen[-1]], 0) ** 2)
        centers = unit_rows[chosen]
        for _ in range(ITERATIONS):
            cos = unit_rows @ centers.T
            nearest = cos.argmax(1)
            new = np.zeros_like(centers)
            np.add.at(new, nearest, candidates * w[:, None])
            size = np.linalg.norm(new, axis=1, keepdims=True)
            new = np.where(size > 1e-12, new / np.maximum(size, 1e-12), centers)
            if np.abs(new - centers).max() < 1e-9:
                break
            centers = new
        score = float((w * (unit_rows @ centers.T).max(1)).sum())
        if score > top:
            best, top = centers, score
    return best


def _starts(rows: DataFrame, runs: list[tuple[int, int]]) -> dict:
    """M6 for all runs: the seeded first point, then draws by squared distance, a pass for each place.

    For few clusters and checks; sweeps start from :func:`_parallel_starts`, whose passes do not grow with K.
    """
    found: dict = {}
    seeds = sorted({seed for _, seed in runs})
    if not runs:
        return found
    firsts = rows.agg(*[F.min_by("v", F.struct(uniform("id", f"first{seed}"), "id")) for seed in seeds]).first()
    for k, seed in runs:
        found[k, seed] = np.array([firsts[seeds.index(seed)]], float)
    for place in range(1, max(k for k, _ in runs)):
        # Runs of one seed draw alike as long as they draw at all: one draw serves every K.
        for_seed = {seed: found[max(k for k, s in runs if s == seed), seed] for seed in seeds}

        def draw(batches: Iterator[pa.RecordBatch], for_seed=for_seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch)
                    far = [np.maximum(1 - _near(x, c)[1], 0) ** 2 for c in for_seed.values()]
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), *map(pa.array, far)], names=["id", "v", *(f"d{s}" for s in for_seed)])

        schema = "id long, v array<double>, " + ", ".join(f"d{s} double" for s in seeds)
        clock = lambda s: -F.log(1 - uniform("id", f"pick{s}:{place}")) / at_least(f"d{s}", 1e-300)
        drawn = rows.mapInArrow(draw, schema).agg(*[F.min_by("v", F.struct(clock(s), F.col("id"))) for s in seeds]).first()
        for k, seed in runs:
            if k > place:
                found[k, seed] = np.vstack([found[k, seed], drawn[seeds.index(seed)]])
    return {r: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) for r, c in found.items()}


def _sums(rows: DataFrame, centers: dict, dim: int) -> dict:
    """For each run its clusters' (members, sum of cosines, sum of vectors); tasks send one row for each cluster."""
    order = list(centers)

    ends = np.cumsum([0, *(len(centers[r]) for r in order)])
    run = np.repeat(np.arange(len(order)), np.diff(ends))
    all_ = np.vstack([_units(centers[r]) for r in order]).T

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, total = np.zeros(len(run), np.int64), np.zeros(len(run)), np.zeros((len(run), dim))
        for batch in batches:
            x = _matrix(batch) if batch.num_rows else np.zeros((0, dim))
            for a in range(0, len(x), CHUNK):
                own = x[a : a + CHUNK]
                cos = _units(own) @ all_
                member, at = np.zeros_like(cos), np.arange(len(own))
                for first, end in zip(ends[:-1], ends[1:]):
                    k = cos[:, first:end].argmax(1) + first
                    member[at, k] = 1
                    n += np.bincount(k, minlength=len(n))
                    s += np.bincount(k, cos[at, k], len(s))
                total += member.T @ own
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(run[some]), pa.array(some - ends[run[some]]), pa.array(n[some]), pa.array(s[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], names=["run", "k", "n", "s", "v"]
        )

    parts = rows.mapInArrow(add, "run long, k long, n long, s double, v array<double>")
    sums = parts.groupBy("run", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dim)]).alias("v"))
    out: dict = {}
    for r in sums.collect():  # as many rows as there are centroids
        out.setdefault(order[r["run"]], {})[r["k"]] = (r["n"], r["s"], r["v"])
    return out


def _worst(rows: DataFrame, centers: dict, empty: dict) -> dict:
    """O4 for each run of *empty*: as many points with the least cosine to their centroid, ties by id, in one pass over the points."""
    order = list(empty)
    if not order:
        return {}

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [[] for _ in order]
        for batch in batches:
            if batch.num_rows:
                x, ids = _matrix(batch), batch.column("id").to_numpy()
                for i, r in enumerate(order):
                    cos = _near(x, centers[r])[1]
                    some = np.lexsort((ids, cos))[: len(empty[r])]
                    held[i] = sorted(held[i] + [(cos[j], ids[j], x[j].tolist()) for j in some])[: len(empty[r])]
        flat = [(i, *q) for i, own in enumerate(held) for q in own]
        yield pa.RecordBatch.from_arrays([pa.array([q[k] for q in flat], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], names=["run", "cos", "id", "v"])

    found: dict = {r: [] for r in order}
    for q in rows.mapInArrow(least, "run long, cos double, id long, v array<double>").orderBy("run", "cos", "id").collect():  # a row for each empty cluster and task
        found[order[q["run"]]].append(q["v"])
    return {r: dict(zip(empty[r], v)) for r, v in found.items()}


def _moved(centers: np.ndarray, sums: dict, worst: dict) -> tuple[np.ndarray, float | None]:
    """The next centroids of a run, empty ones from *worst*, and the objective of the assignment before them."""
    total = sum(n for n, _, _ in sums.values())
    if not total:
        return centers, None
    new = np.array([sums[k][2] if k in sums else worst.get(k, np.zeros(centers.shape[1])) for k in range(len(centers))])
    return _units(new), sum(s for _, s, _ in sums.values()) / total


def sizes(assigned: DataFrame, k: int, cluster: str = "cluster") -> DataFrame:
    """A5: members of each of the K clusters, empty ones too."""
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias(cluster))
    return every.join(assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")), cluster, "left").fillna({"n": 0})


def evaluate(points: DataFrame, centroids: DataFrame, v: str, cluster: str, k: int) -> DataFrame:
    """Cohesion, separation from the nearest other centroid, and sizes, in one row."""
    from quillon.operators.directions import centroid_array

    own = at_least(norm(v))
    scored = points.crossJoin(F.broadcast(centroid_array(centroids)))
    cos = lambda c: dot(F.col(v), c["center"]) / (own * c["norm"])
    mine = F.array_max(F.transform(F.filter("_centroids", lambda c: c["k"] == F.col(cluster)), cos))
    other = F.coalesce(F.array_max(F.transform(F.filter("_centroids", lambda c: c["k"] != F.col(cluster)), cos)), F.lit(-2.0))
    scored = scored.select(F.col(cluster).alias("cluster"), mine.alias("own"), other.alias("other"))
    per = scored.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("s"), F.sum("other").alias("o"))
    per = scored.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster")).join(per, "cluster", "left").fillna({"n": 0})
    total = F.sum("n")
    return per.agg(
        (F.sum("s") / total).alias("cohesion"), ((F.sum("s") - F.sum("o")) / total).alias("separation"), (F.sum("o") / total).alias("nearest_other"),
        F.min(F.when(F.col("n") > 0, F.col("s") / F.col("n"))).alias("cohesion_min"), F.min("n").alias("size_min"), F.max("n").alias("size_max"),
        F.percentile("n", 0.5).cast("bigint").alias("size_median"), F.count_if(F.col("n") < MIN_CLUSTER_SIZE).alias("n_small"),
    )


def covariance(points: DataFrame, v: str, dim: int) -> DataFrame:
    """The upper triangle (i, j, cov), from the Gram matrices of batches: a task sends one sum for each i <= j.

    Sums are taken around one point of the table, so that a large common mean costs no digits.
    """
    first = points.select(v).where(F.size(v) == dim).limit(1).collect()
    around = np.array(first[0][0] if first else np.zeros(dim), float)
    i, j = np.triu_indices(dim)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, dim) - around
                n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        if n:
            cells = [pa.array(np.append(i, range(dim)).astype(np.int32)), pa.array(np.append(j, np.full(dim, -1)).astype(np.int32)), pa.array(np.append(products[i, j], total)), pa.array(np.full(len(i) + dim, n))]
            yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "p", "n"])

    cells = points.select(F.col(v).cast("array<double>").alias(v)).mapInArrow(gram, "i int, j int, p double, n long")
    cells = cells.groupBy("i", "j").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    sums = cells.where("j = -1").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("s"))  # dim numbers
    joined = cells.where("j >= 0").crossJoin(F.broadcast(sums))
    return joined.select("i", "j", ((F.col("p") - F.get("s", F.col("i")) * F.get("s", F.col("j")) / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def principal_shares(points: DataFrame, v: str, dim: int, top: int = 16) -> list[float]:
    """Shares of the greatest variances of the covariance, from :func:`quillon.operators.principal.principal`."""
    return principal(points, v, dim, top).shares.tolist()


def pair_cosines(points: DataFrame, v: str, id: str, pairs: int = PAIR_SAMPLE, seed: int = 0) -> DataFrame:
    """Cosines of *pairs* seeded pairs of points drawn with reuse, those of a point with itself left out.

    Ids alone are ranked, as keys of any kind.  While all points take no more than SENT_BYTES, they are sent to the tasks, which
    hold the pairs; beyond that the drawn ids, a bounded table, are sent to the points, and drawn vectors meet by pair.
    """
    spark = points.sparkSession
    n, longest = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(v)), F.lit(0))).first()
    draw = lambda tag: F.floor(uniform("id", f"{tag}{seed}") * n)
    wanted = spark.range(pairs).select("id", draw("i").alias("i"), draw("j").alias("j")).where("i <> j")
    if n * longest * 8 <= SENT_BYTES:
        placed = ranked(points.select(F.col(id).alias("_id"), v), "_id", "_rank").select("_rank", F.col(v).alias("_v"), at_least(norm(v)).alias("_n"))
        placed = staged(placed, "placed")
        side = lambda k: F.broadcast(placed.select(F.col("_rank").alias(k), F.col("_v").alias(f"_v{k}"), F.col("_n").alias(f"_n{k}")))
        return wanted.join(side("i"), "i").join(side("j"), "j").select((dot("_vi", "_vj") / (F.col("_ni") * F.col("_nj"))).alias("cos"))
    wanted = wanted.select(F.col("id").alias("_pair"), F.posexplode(F.array("i", "j")).alias("_side", "_rank"))
    drawn = ranked(points.select(F.col(id).alias("_id")), "_id", "_rank").join(F.broadcast(wanted), "_rank").drop("_rank")
    met = points.select(F.col(id).alias("_id"), v).join(F.broadcast(drawn), "_id")
    both = met.groupBy("_pair").agg(*[F.max(F.when(F.col("_side") == k, F.col(v))).alias(f"_{k}") for k in (0, 1)])
    return both.select((dot("_0", "_1") / (at_least(norm("_0")) * at_least(norm("_1")))).alias("cos"))


def mean_cosines(points: DataFrame, v: str, dim: int) -> DataFrame:
    """A10: mean and least cosine to the direction of the mean of the unit vectors, one row."""
    units = points.select(unit(v).alias("_u"))
    mean = vector_mean(units, "_u", dim, out="_m").select(unit("_m").alias("_m"))
    return units.crossJoin(F.broadcast(mean)).select(dot("_u", "_m").alias("c")).agg(F.avg("c").alias("mean_dir_mean"), F.min("c").alias("mean_dir_min"))


def diagnose(points: DataFrame, v: str, id: str, dim: int, pairs: int = PAIR_SAMPLE, seed: int = 0, top: int = 16) -> DataFrame:
    """M9: cosine statistics, the *top* principal shares, and whether to centre before clustering, in one row."""
    points = staged(points.select(id, unit(v).alias(v)), "units")  # read by every pass below
    cosines = staged(pair_cosines(points, v, id, pairs, seed), "cosines")
    stats = cosines.agg(F.avg("cos").alias("mean_cos"), F.stddev_samp("cos").alias("std_cos")).crossJoin(F.broadcast(quantiles(cosines, "cos", list(PAIR_QUANTILES))))
    stats = stats.crossJoin(F.broadcast(mean_cosines(points, v, dim)))
    shares = principal_shares(points, v, dim, top)
    advice = F.when((F.col("mean_cos") > 0.5) & (F.col("pc1") > 0.5), "CENTER").otherwise("AS IS")
    found = {"pc1": F.lit(float(shares[0])), "pc_cumulative": F.lit(float(sum(shares))), "pc_shares": F.array(*[F.lit(float(x)) for x in shares])}
    return stats.withColumns(found).withColumn("advice", advice)
