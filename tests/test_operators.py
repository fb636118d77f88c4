"""Operators at their edges, and properties of the random ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.vectors import norm
from quillon.operators import batching, clustering, directions, identity, inspection, metrics, preferences, sketch


def points(spark, n=300, dim=8, k=3, noise=0.05, seed=0):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(k, dim))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    rows = []
    for i in range(n):
        v = centers[i % k] + noise * r.normal(size=dim)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), i % k))
    return spark.createDataFrame(rows, "id long, v array<double>, truth int")


def test_direction_names(spark):
    assert directions.resolve("max_weighted_norm1")["bases"] == ["single_weighted_norm1", "aggregated_weighted_norm1"]
    assert directions.resolve(directions.direction_name("maxclu", "mean", 8)) == {"family": "maxclu", "kind": "mean", "K": 8, "bases": ["single_unweighted"]}
    for bad in ("single", "maxclu_mean_K", "clusteronly_median_K3"):
        with pytest.raises(ValueError):
            directions.resolve(bad)
    with pytest.raises(ValueError):
        directions.dot_scale("no", F.lit(1), F.lit(1))


def test_argmax_ties_and_separate_maxima(spark):
    c = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 10.0])], "k int, center array<double>")
    p = spark.createDataFrame([(0, [3.0, 1.0])], "id long, v array<double>")
    assert directions.nearest_centroid(p, c).first()["cluster"] == 1
    s = directions.cluster_scores(p.withColumn("g", norm("v")), c, "v", "g").first()
    assert s["dot"] == 10.0 and s["cos"] == pytest.approx(3 / 10**0.5)  # from different centroids


def test_vector_mean_long_agrees(spark):
    p = points(spark, 50)
    a = directions.vector_mean(p, "v", 8, "truth").select("truth", F.posexplode("center").alias("i", "x"))
    b = directions.vector_mean_long(p, "v", "truth")
    assert a.join(b, ["truth", "i"]).where(F.abs(F.col("x") - F.col("value")) < 1e-12).count() == 24


def test_planted_clusters_are_found(spark):
    p = points(spark)
    assigned, centers, objective = max((clustering.spherical_kmeans(p, "v", "id", 8, 3, seed) for seed in range(3)), key=lambda x: x[2])
    assert objective > 0.98 and assigned.select("truth", "cluster").distinct().count() == 3
    best = clustering.k_sweep(p, "v", "id", 8, [2, 3, 500], restarts=2, iterations=5).collect()
    assert [r["K"] for r in best] == [2, 3] and best[1]["objective"] > best[0]["objective"]


def test_empty_clusters_are_seeded_and_counted(spark):
    p = points(spark, 30)
    start = spark.createDataFrame([(0, [1.0] * 8), (1, [1.0] * 8), (2, [-1.0] * 8)], "k int, center array<double>")
    new, _ = clustering.step(p, start, "v", 8, "id")
    assert new.count() == 3 and new.where("center is null").count() == 0
    assert [r["n"] for r in clustering.sizes(p.withColumn("cluster", F.col("truth")), 5).orderBy("cluster").collect()] == [10, 10, 10, 0, 0]
    one = clustering.evaluate(p, start, "v", "truth", 4).first()
    assert one["size_min"] == 0 and one["n_small"] == 4


def test_covariance_and_shares(spark):
    p = points(spark, 100)
    x = np.array([r["v"] for r in p.collect()])
    got = {(r["i"], r["j"]): r["cov"] for r in clustering.covariance(p, "v", 8).collect()}
    want = np.cov(x.T)
    assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-12) for i in range(8) for j in range(i, 8))
    values = np.linalg.eigvalsh(want)[::-1]
    assert clustering.principal_shares(p, "v", 8, 2) == pytest.approx((values[:2] / values.sum()).tolist())
    axes, shares = inspection.pca_2d(p, "v", 8)
    assert len(axes) == 2 and shares == pytest.approx((values[:2] / values.sum()).tolist())
    assert {"pc1", "pc2"} <= set(inspection.project(p, "v", axes).columns)
    assert clustering.diagnose(p, "v", "id", 8, 20).first()["advice"] in ("CENTER", "AS IS")
    moved, mean = clustering.centered(p, "v", 8)
    assert moved.select(F.abs(norm("v") - 1).alias("d")).agg(F.max("d")).first()[0] < 1e-12


def test_sketch_keeps_inner_products(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 200))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    s = np.array([q["sketch"] for q in sketch.count_sketch(df, "v", 200, 64).orderBy("id").collect()])
    off = (s @ s.T - x @ x.T)[np.triu_indices(40, 1)]
    assert abs(off.mean()) < 0.02 and off.std() == pytest.approx(1 / 8, rel=0.25)
    table = sketch.coordinate_table(spark, 200, 16).groupBy("b").agg(F.count_distinct("s").alias("n"))
    assert table.where("n = 2").count() >= 12  # buckets mix signs
    a = sketch.count_sketch_long(df.select("id", F.lit(0).alias("o"), "v"), "id", "o", "v", 64).groupBy("id").agg(F.sum(F.col("value") ** 2).alias("q"))
    assert sorted(round(q["q"], 9) for q in a.collect()) == sorted(np.round((s * s).sum(1), 9).tolist())
    d = np.array([q["dense"] for q in sketch.rademacher(df, "v", 200, 64).orderBy("id").collect()])
    assert (d @ d.T - x @ x.T)[np.triu_indices(40, 1)].std() == pytest.approx(1 / 8, rel=0.25)
    bad = spark.createDataFrame([(0, [float("nan"), 1.0, None]), (1, None)], "id long, v array<double>")
    assert all(np.isfinite(q["sketch"]).all() for q in sketch.count_sketch(bad, "v", 3, 2).select("sketch").collect() if None not in q["sketch"])
    assert [tuple(q) for q in sketch.block_plan(spark, 10, 4, 2).collect()] == [(0, 0, 4, 2000006), (1, 4, 4, 2000007), (2, 8, 2, 2000008)]


def test_preferences(spark):
    m = lambda *ps: [{"role": a, "content": b} for a, b in ps]
    rows = [
        (0, m(("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b c")), m(("user", "q"), ("assistant", None))),
        (1, m(("system", "x")), m(("user", "q"), ("assistant", "z"))),
        (2, m(("user", "w " * 3000), ("assistant", "y")), m(("assistant", "n"))),
    ]
    raw = spark.createDataFrame(rows, "idx long, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>")
    got = {r["idx"]: r for r in preferences.format_pairs(raw).collect()}
    assert got[0]["chosen"] == "\nb c<|im_end|>\n" and got[0]["prompt"].endswith("r<|im_end|>\n<|im_start|>assistant")
    assert got[0]["rejected"] == "\n<|im_end|>\n" and got[1]["chosen"] is None and got[1]["prompt"] is None
    assert {r["idx"]: r["rejected"] for r in preferences.format_pairs(raw, reverse=True).collect()}[0] == got[0]["chosen"]
    with pytest.raises(Exception, match="assistant header"):
        preferences.format_pairs(raw, strict=True).collect()
    kept, dropped = preferences.filter_degenerate(preferences.format_pairs(raw))
    assert {r["idx"]: r["reason"] for r in dropped.collect()} == {1: "no_header", 2: "long_prompt"} and kept.count() == 1
    assert preferences.unpair(kept).select("label").collect() == [(True,), (False,)]
    last = raw.select(preferences.last_message("rejected"), preferences.last_message("chosen", "user")).collect()
    assert last[0][0] == "" and last[1][1] is None
    ids = spark.createDataFrame([([1, 9, 8, 2, 9, 8, 3, 4],), ([1, 2],), ([9, 8],)], "ids array<int>")
    got = [r[0] for r in ids.select(preferences.split_ids("ids", [9, 8], 7)).collect()]
    assert tuple(got[0]) == (6, [3]) and got[1] is None and tuple(got[2]) == (2, [])  # a header at the end, an empty completion
    padded = ids.select(preferences.pad_left("ids", F.lit(8)), preferences.label_mask("ids", F.lit(2))).collect()
    assert padded[1][0] == [0] * 6 + [1, 2] and padded[0][1] == [-100, -100, 8, 2, 9, 8, 3, 4]


def test_coverage(spark):
    base, done = spark.range(20).withColumnRenamed("id", "idx"), spark.range(8, 20).withColumnRenamed("id", "idx")
    assert tuple(preferences.coverage(base, done).first()) == (20, 12, [0, 1, 2, 3, 4], 8)
    assert preferences.coverage(base, base).first()["first_gaps"] == []


def test_compare_details(spark):
    rows = [("even", i, g, r) for i, (g, r) in enumerate([(1.0, 1.0), (2.2, 2.0), (3.9, 3.0), (4.0, 4.0)])] + [("one", 0, 2.0, 1.0)] + [("flat", i, 1.0, float(i)) for i in range(3)]
    got = {r["channel"]: r for r in metrics.compare(spark.createDataFrame(rows, "channel string, i int, got double, ref double"), "channel").collect()}
    assert got["even"]["rel_median"] == 0.0  # the lower of the middle two
    assert got["even"]["slope"] == pytest.approx((1 + 4.4 + 11.7 + 16) / 30)
    assert np.isnan(got["one"]["corr"]) and np.isnan(got["flat"]["corr"])


def test_fingerprints(spark):
    p = points(spark, 30).withColumn("name", F.col("truth").cast("string"))
    saved = identity.fingerprint(p, "name", "v")
    other = identity.fingerprint(p.where("truth < 2").unionByName(p.where("truth = 0").withColumn("name", F.lit("new"))), "name", "v")
    status = {r["name"]: r["status"] for r in identity.verify(saved, other, "name").collect()}
    assert status == {"0": "ok", "1": "ok", "2": "missing", "new": "extra"}
    assert identity.key_difference(saved, other, "name").count() == 2
    with pytest.raises(ValueError):
        identity.enforce(identity.verify(saved, other, "name"))
    assert identity.enforce(identity.verify(saved, other, "name"), "advisory").count() == 2
    with pytest.raises(ValueError):
        identity.same_source([spark.range(1).selectExpr("'a' source_id"), spark.range(1).selectExpr("'b' source_id")])


def test_terms_and_report(spark):
    docs = spark.createDataFrame([("a", "Zebra zebra's the CAFÉ " * 20), ("b", "apple it's apple pear " * 20), ("c", "")], "k string, text string")
    got = [(r["k"], r["term"]) for r in inspection.distinctive_terms(docs, "text", "k").orderBy("k", "rank").collect()]
    assert ("a", "zebra") in got and ("a", "caf") in got and ("b", "apple") in got and not any(t == "the" for _, t in got)
    page = inspection.html_report(spark.createDataFrame([("</script>\u2028", 1)], "x string, n int"), "a<b")
    assert "</script>\u2028" not in page and "\\u003c/script>" in page and "a&lt;b" in page
    assert inspection.eta_squared(docs, F.lit(1.0), "k").first()[0] == 0.0


def test_samples_are_disjoint_from_medoids(spark):
    p = points(spark, 60).withColumn("cos", F.get("v", F.lit(0)))
    top = inspection.medoids(p, "truth", "cos", "id", 4)
    some = inspection.sample(p, "truth", "id", 5, without=top)
    assert some.count() == 15 and some.join(top, "id").count() == 0
    assert some.select("id").exceptAll(inspection.sample(p.repartition(7), "truth", "id", 5, without=top).select("id")).count() == 0


def test_batches():
    assert batching.cut(np.array([4096, 1, 1, 5000, 1])).tolist() == [0, 1, 1, 2, 3]
    assert batching.cut(np.ones(40, int)).tolist() == [k // 16 for k in range(40)]


def test_fixed_batches(spark):
    assert [r["batch"] for r in batching.fixed_batches(spark.range(10), "id").orderBy("id").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_blocks_shift_and_last(spark):
    from quillon.operators import layout

    df = spark.createDataFrame([(1, [1.0, 2.0], None), (2, None, [3.0, 4.0, 5.0])], "id long, a array<double>, b array<double>")
    flat = layout.flatten_blocks(df, [("a", 2), ("b", 3)]).select("id", "flat")
    assert [r["flat"] for r in flat.orderBy("id").collect()] == [[1.0, 2.0, 0.0, 0.0, 0.0], [0.0, 0.0, 3.0, 4.0, 5.0]]
    assert [tuple(r)[2:] for r in layout.unflatten(flat, "flat", [("x", 4), ("y", 1)]).orderBy("id").collect()] == [([1.0, 2.0, 0.0, 0.0], [0.0]), ([0.0, 0.0, 3.0, 4.0], [5.0])]
    with pytest.raises(Exception, match="not 4 long"):
        layout.unflatten(flat, "flat", [("x", 4)]).collect()
    m = spark.createDataFrame([([True, False, True, False],), ([False, False],), ([],)], "m array<boolean>")
    assert [r[0] for r in m.select(preferences.last_true("m")).collect()] == [2, 1, -1]
    assert [r[0] for r in m.select(preferences.shifted("m")).collect()] == [[False, True, False], [False], []]
    with pytest.raises(Exception, match="uneven"):
        preferences.zipped(spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>"), "a", "b").collect()
    sums = layout.prefix_sums(spark.range(0, 30000, 7).withColumn("x", F.col("id") % 5), "id", "x", "before")
    want, total = {}, 0
    for i in range(0, 30000, 7):
        want[i] = total
        total += i % 5
    assert {r["id"]: r["before"] for r in sums.collect()} == want


def test_control_weights_are_those_of_a_loop(spark):
    import random

    from quillon.functions.controls import control_weights

    df = spark.createDataFrame([(0, 3), (5, 0), (7, 9)], "idx long, n int")
    for r in control_weights(df, "idx", "n", 0.0, 2.0, 42).collect():
        g = random.Random(42 * 1_000_003 + r["idx"])
        assert r["weights"] == [g.uniform(0.0, 2.0) for _ in range({0: 3, 5: 0, 7: 9}[r["idx"]])]


def test_sweep_runs_are_those_of_single_runs(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(150, 6)) + np.repeat(r.normal(size=(5, 6)) * 4, 30, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for row in clustering.k_sweep(p, "v", "id", 6, (3, 5), restarts=2).collect():
        single = [clustering.spherical_kmeans(p, "v", "id", 6, row["K"], seed)[2] for seed in range(2)]
        assert row["objective"] == pytest.approx(max(single)) and row["restart"] == int(np.argmax(single))
    starts = clustering.plus_plus(p, "v", "id", 4, 1)
    assert np.allclose(clustering._starts(p.select("id", "v"), [(4, 1)])[4, 1], starts)


def test_direction_names_build_plans(spark):
    tokens = spark.createDataFrame([(0, 0, [1.0, 0.0], 1.0), (0, 1, [0.0, 2.0], 2.0)], "idx long, t long, v array<double>, g double")
    own = spark.createDataFrame([(0, [1.0, 1.0])], "idx long, unweighted array<double>")
    mean = spark.createDataFrame([([0.0, 3.0],)], "unweighted array<double>")
    clusters = {("mean", 1): spark.createDataFrame([(0, [2.0, 0.0])], "k int, center array<double>")}
    got = lambda n: [tuple(r) for r in directions.direction_scores(n, tokens, own, mean, clusters, "idx", "v", "g").orderBy("t").select("dot", "cos").collect()]
    assert got("single_unweighted") == [(1.0, pytest.approx(0.5**0.5)), (2.0, pytest.approx(0.5**0.5))]
    assert got("max_unweighted") == [(1.0, pytest.approx(0.5**0.5)), (6.0, 1.0)]
    assert got("clusteronly_mean_K1") == [(1.0, 1.0), (0.0, 0.0)]
    assert got("maxclu_mean_K1") == [(1.0, 1.0), (2.0, pytest.approx(0.5**0.5))]
    names = ["single_unweighted", "max_unweighted", "clusteronly_mean_K1", "maxclu_mean_K1", "aggregated_unweighted"]
    many = directions.named_scores(names, tokens, own, mean, clusters, "idx", "v", "g").collect()
    for n in names:
        assert sorted((r["t"], r["dot"], r["cos"]) for r in many if r["direction"] == n) == [(t, d, c) for t, (d, c) in enumerate(got(n))]
    with pytest.raises(ValueError, match="no centroids"):
        directions.named_scores(["clusteronly_mean_K2"], tokens, own, mean, clusters, "idx", "v", "g")
    with pytest.raises(ValueError, match="no centroids"):
        got("clusteronly_mean_K2")
    with pytest.raises(ValueError, match="unknown direction"):
        got("min_unweighted")


def test_fingerprint_policies(spark, tmp_path):
    now = spark.createDataFrame([("a", 2, 1.0, 2.0), ("b", 1, 3.0, 9.0)], "name string, numel long, sum double, sumsq double")
    assert identity.establish(now, str(tmp_path / "f"), "name").count() == 0
    moved = now.withColumn("sum", F.col("sum") * 2)
    with pytest.raises(ValueError, match="fingerprints differ"):
        identity.establish(moved, str(tmp_path / "f"), "name")
    assert identity.establish(moved, str(tmp_path / "f"), "name", "advisory").count() == 2
    with pytest.raises(ValueError, match="names differ"):
        identity.pinned(now, now.where("name = 'a'"), "name")


def test_last_match_against_a_loop(spark):
    import random

    r = random.Random(4)
    for header in ([7], [1, 1], [1, 2, 1, 3], [1, 1, 2, 1, 1], [2, 2, 2]):
        rows = [(k, [r.choice([1, 2, 3, 7, None]) if r.random() < 0.05 else r.choice([1, 2, 1, 3, 7]) for _ in range(r.randint(0, 25))]) for k in range(200)]
        got = {q["k"]: q["last"] for q in spark.createDataFrame(rows, "k long, ids array<int>").select("k", preferences.last_match("ids", header).alias("last")).collect()}
        for k, ids in rows:
            ends = [i + len(header) for i in range(len(ids) - len(header) + 1) if ids[i : i + len(header)] == header]
            assert got[k] == (max(ends) if ends else None)
    with pytest.raises(ValueError):
        preferences.last_match("ids", [])
