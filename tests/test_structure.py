"""Dense states, block sketches, components, scans, exact quantiles, seeding and the report, beside numpy and loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import clustering, dense, directions, identity, inspection, layout, metrics, principal, sketch
from quillon.operators.quantiles import LINEAR, LOWER, quantiles


def vectors(spark, x, *more):
    rows = [(i, v.tolist(), *[m[i] for m in more]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["id long", "v array<double>", *(f"k{j} {'string' if isinstance(m[0], str) else 'long'}" for j, m in enumerate(more))]))


def test_dense_means_of_arrays_and_of_blocks(spark):
    x = np.random.default_rng(1).normal(size=(90, 1000))
    keys = [("a", "b", "c")[i % 3] for i in range(90)]
    df = vectors(spark, x, keys).repartition(7).withColumn("w", F.col("id") / 10.0)
    got = {r["k0"]: r for r in dense.whole(dense.means(df, "v", "k0", weights={"one": F.lit(1.0), "w": F.col("w")}, block=300), "k0", names=("one", "w")).collect()}
    for j, k in enumerate("abc"):
        assert got[k]["n_averaged"] == 30
        assert np.allclose(got[k]["one"], x[j::3].mean(0), atol=1e-12)
        assert np.allclose(got[k]["w"], (x * (np.arange(90) / 10)[:, None])[j::3].mean(0), atol=1e-12)
    cut = df.select("id", "k0", F.explode(F.array(*[F.struct(F.lit(a).alias("offset"), F.slice("v", a + 1, 400).alias("x")) for a in (0, 400, 800)])).alias("b")).select("k0", "b.*")
    blocks = dense.means(cut, "x", "k0", offset="offset", block=128)
    assert {r["offset"] for r in blocks.collect()} == {a + b for a in (0, 400, 800) for b in range(0, 400 if a < 800 else 200, 128)}
    assert all(np.allclose(r["mean"], x["abc".index(r["k0"]) :: 3].mean(0), atol=1e-12) for r in dense.whole(blocks, "k0").collect())


def test_dense_state_is_flushed_and_merged(spark, monkeypatch):
    monkeypatch.setattr(dense, "MOST_CELLS", 500)
    x = np.random.default_rng(2).normal(size=(60, 100))
    got = dense.whole(dense.sums(vectors(spark, x, list(range(60))).withColumn("g", F.col("k0") % 20), "v", "g", block=64), "g", names=("sum",)).collect()
    assert len(got) == 20 and all(np.allclose(r["sum"], x[r["g"] :: 20].sum(0)) for r in got)


def test_dense_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 4.0]), (1, None), (2, []), (3, [5.0, 6.0])], "k long, v array<double>")
    got = {r["k"]: (r["n"], r["sum"]) for r in dense.sums(df, "v", "k").collect()}
    assert got == {None: (2, [4.0, 6.0]), 2: (1, []), 3: (1, [5.0, 6.0])}
    assert dense.sums(df.limit(0), "v", "k").collect() == []
    with pytest.raises(Exception, match="differ in length"):
        dense.sums(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1), "v").collect()


def test_plans_of_means_do_not_grow_with_the_vector(spark):
    def size(n):
        df = spark.range(20).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (j * F.col("id")).cast("double")).alias("v"))
        m = directions.vector_mean(df, "v", n)
        return len(m._jdf.queryExecution().optimizedPlan().toString()), m.first()

    (small, _), (large, row) = size(1000), size(100_000)
    assert abs(large - small) < 50 and row["n_averaged"] == 20 and row["center"][99_999] == pytest.approx(99_999 * 9.5)


def test_block_sketch(spark):
    x = np.random.default_rng(4).normal(size=(30, 5000))
    x[3, 7] = np.nan
    df = vectors(spark, x)
    cut = df.select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("offset"), F.slice("v", a + 1, 1024).alias("x")) for a in range(0, 5000, 1024)])).alias("b")).select("id", "b.*").repartition(6)
    got = {r["id"]: r for r in sketch.block_sketch(cut, "id", "offset", "x", 128, seed=3).collect()}
    h = sketch.cell_hash(np.arange(5000), 3).astype(np.int64)
    x = np.nan_to_num(x)
    for i in range(30):
        assert np.allclose(got[i]["sketch"], np.bincount(h % 128, np.where(h >> 31, 1.0, -1.0) * x[i], 128)) and got[i]["n_blocks"] == 5
        assert got[i]["sketch_norm"] == pytest.approx(np.linalg.norm(x[i]))
    s = np.array([got[i]["sketch"] for i in range(30)])
    off = ((s @ s.T - x @ x.T) / 5000)[np.triu_indices(30, 1)]
    assert abs(off.mean()) < 0.02 and off.std() == pytest.approx(128**-0.5, rel=0.25)
    # What moves is a sketch for each task and vector, not a row for each coordinate.
    assert np.bincount(h % 128, minlength=128).min() > 10 and abs((h >> 31).mean() - 0.5) < 0.03


def test_principal_components_at_a_thousand_dimensions(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 30)) * 0.8 ** np.arange(30) @ r.normal(size=(30, 1000)) + 20 * r.normal(size=1000) + 0.01 * r.normal(size=(400, 1000))
    df = vectors(spark, x).repartition(5)
    found = principal.principal(df, "v", 1000, 6)
    values, axes = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(found.variances, values[::-1][:6], rtol=1e-9) and found.total == pytest.approx(values.sum())
    assert np.allclose(np.abs((found.axes * axes[:, ::-1][:, :6].T).sum(1)), 1)
    placed = principal.project(df, "v", found, 3).orderBy("id").collect()
    assert np.allclose([[p["pc1"], p["pc2"], p["pc3"]] for p in placed], (x - x.mean(0)) @ found.axes[:3].T)


def test_principal_edges(spark):
    same = vectors(spark, np.ones((5, 4)))
    assert principal.principal(same, "v", 4, 2).shares.tolist() == [0, 0]
    none = principal.principal(same.limit(0), "v", 4, 2)
    assert none.n == 0 and none.total == 0
    null = same.union(spark.createDataFrame([(9, None)], "id long, v array<double>"))
    found = principal.principal(null, "v", 4, 2)
    assert found.n == 5 and {r["pc1"] for r in principal.project(null, "v", found).where("id = 9").collect()} == {None}
    with pytest.raises(Exception, match="is not 3 long"):
        principal.principal(same, "v", 3, 1)


def test_diagnostic_advice(spark):
    r = np.random.default_rng(6)
    shared = np.outer(np.sign(r.normal(size=300)) * 0 + 3, np.ones(64)) + np.outer(3 * r.normal(size=300), np.eye(64)[0]) + 0.1 * r.normal(size=(300, 64))
    spread_ = r.normal(size=(300, 64))
    for x, advice in ((shared, "CENTER"), (spread_, "AS IS")):
        row = clustering.diagnose(vectors(spark, x), "v", "id", 64, 2000, top=3).first()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        values = np.linalg.eigvalsh(np.cov(u.T))[::-1]
        assert row["advice"] == advice and np.allclose(row["pc_shares"], values[:3] / values.sum(), atol=1e-9)
        mean = u.mean(0) / np.linalg.norm(u.mean(0))
        assert row["mean_dir_mean"] == pytest.approx((u @ mean).mean()) and row["mean_dir_min"] == pytest.approx((u @ mean).min())


def test_pairs_are_the_same_whether_points_or_pairs_are_sent(spark, monkeypatch):
    df = vectors(spark, np.random.default_rng(12).normal(size=(60, 9))).repartition(4)
    sent = sorted(r["cos"] for r in clustering.pair_cosines(df, "v", "id", 500).collect())
    monkeypatch.setattr(clustering, "SENT_BYTES", 0)
    assert sent == pytest.approx(sorted(r["cos"] for r in clustering.pair_cosines(df, "v", "id", 500).collect()))


@pytest.mark.parametrize("kind", ["sparse", "negative", "text", "pair"])
def test_prefix_sums_by_any_key(spark, kind):
    r = random.Random(7)
    key = {"sparse": lambda i: r.getrandbits(62), "negative": lambda i: -i * i, "text": lambda i: f"{r.random():.12f}", "pair": lambda i: None}[kind]
    rows = [(i, key(i), r.choice([None, 0, 1]) if kind == "pair" else 0, i % 9) for i in range(3000)]
    df = spark.createDataFrame(rows, f"id long, k {'string' if kind == 'text' else 'long'}, a int, x long").repartition(5)
    order = ["a", "id"] if kind == "pair" else "k"
    got = {q["id"]: q["s"] for q in layout.prefix_sums(df, order, "x", "s", buckets=37).collect()}
    place = (lambda q: (q[2] is not None, q[2] or 0, q[0])) if kind == "pair" else (lambda q: q[1])
    total, want = 0, {}
    for q in sorted(rows, key=place):
        want[q[0]], total = total, total + q[3]
    assert got == want


def test_buckets_are_even_whatever_the_keys(spark):
    df = spark.range(40_000).select(F.xxhash64("id").alias("k"))
    sizes = [r["count"] for r in layout.bucketed(df, "k", 20).groupBy("_bucket").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2.5 * min(sizes)


def test_ranks_of_one_huge_group(spark):
    r = random.Random(8)
    rows = [(i, "huge" if i % 50 else ("small" if i % 100 else None), r.randint(0, 30)) for i in range(4000)]
    df = spark.createDataFrame(rows, "i long, g string, x int").repartition(4)
    got = {q["i"]: q["place"] for q in layout.ranked(df, ["x", "i"], "place", keys=("g",)).collect()}
    want = {}
    for g in ("huge", "small", None):
        want |= {q[0]: k for k, q in enumerate(sorted((q for q in rows if q[1] == g), key=lambda q: (q[2], q[0])))}
    assert got == want


@pytest.mark.parametrize("kind", [LINEAR, LOWER])
@pytest.mark.parametrize("inside", [100_000, 40])
def test_quantiles_are_exact(spark, kind, inside):
    r, probs = np.random.default_rng(9), [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    groups = {"ties": r.integers(0, 5, 3000) * 1.0, "skewed": np.exp(4 * r.normal(size=5000)), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "same": np.full(900, 3.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("ties", None), ("ties", float("nan")), ("none", None)]
    got = {q["g"]: q["quantiles"] for q in quantiles(spark.createDataFrame(rows, "g string, x double").repartition(4), "x", probs, "g", kind=kind, inside=inside).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        want = np.quantile(x, probs, method="linear" if kind == LINEAR else "inverted_cdf")
        assert np.allclose(got[g], want, rtol=1e-12), g


def test_compare_with_one_huge_channel(spark):
    r = np.random.default_rng(10)
    ref = r.normal(size=2000)
    got = ref + 0.001 * r.normal(size=2000)
    rows = [(i, "huge" if i > 2 else "tiny", float(a), float(b)) for i, (a, b) in enumerate(zip(got, ref))]
    out = {q["c"]: q for q in metrics.compare(spark.createDataFrame(rows, "i long, c string, got double, ref double"), "c").collect()}
    a, b = got[3:], ref[3:]
    rel = np.sort(np.abs(a - b) / np.abs(b))
    assert out["huge"]["rel_median"] == pytest.approx(rel[(len(rel) + 1) // 2 - 1])
    assert out["huge"]["spearman"] == pytest.approx(np.corrcoef(a.argsort().argsort(), b.argsort().argsort())[0, 1])
    assert out["huge"]["ok"] and out["tiny"]["n"] == 3


def test_parallel_starts_are_as_good_as_those_one_by_one(spark):
    r = np.random.default_rng(11)
    centers = r.normal(size=(20, 16))
    x = centers[np.arange(1200) % 20] + 0.15 * r.normal(size=(1200, 16))
    df = vectors(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    rows = df.select("id", "v").persist()
    tries = [(20, seed) for seed in range(3)]
    objective = lambda found: max(sum(q[1] for q in v.values()) / 1200 for v in clustering._sums(rows, clustering._converged(rows, found, 16, 50), 16).values())
    assert objective(clustering._parallel_starts(rows, tries)) > 0.98 * objective(clustering._starts(rows, tries))


def test_parallel_starts_with_fewer_points_than_clusters(spark):
    df = vectors(spark, np.eye(3))
    found = clustering._parallel_starts(df.select("id", "v"), [(5, 0)])[5, 0]
    assert found.shape == (5, 3) and np.allclose(np.linalg.norm(found, axis=1), 1)


def test_products_of_another_run_are_refused(spark, tmp_path):
    one, other = (spark.createDataFrame([(k, s)], "idx long, source_id string") for k, s in ((1, "full"), (2, "sampled")))
    path = str(tmp_path / "products")
    assert identity.add_products(one, path) and not identity.add_products(other, path)
    assert [r["idx"] for r in spark.read.parquet(path).collect()] == [1]
    assert identity.add_products(other, path, overwrite=True) and [r["idx"] for r in spark.read.parquet(path).collect()] == [2]
    assert not identity.add_products(one.union(other), str(tmp_path / "mixed"))


def test_report_without_texts(spark):
    points = spark.createDataFrame([(k, k % 2, 1 - k / 100, float(k)) for k in range(30)], "id long, label int, cos double, size double")
    texts = spark.createDataFrame([(k, "p", "alpha beta " * 40, "r") for k in range(0, 10)], "id long, prompt string, chosen string, rejected string")
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "k int, center array<double>")
    got = {r["label"]: r for r in inspection.report(points, texts, centers, "label", "cos", "id", "size").collect()}
    assert [x["id"] for x in got[0]["medoids"]] == list(range(0, 20, 2)) and len(got[0]["others"]) == 5
    assert got[0]["n"] == 15 and got[0]["median_chars"] == 440 and got[1]["nearest"] == 0 and {t["term"] for t in got[0]["terms"]} == {"alpha", "beta"}
    assert got[0]["medoids"][9]["chosen"] is None and got[0]["eta_log_chosen"] == 0.0


def _counting(spark, df, column):
    """*df* with an accumulator of how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    return df.withColumn(column, F.udf(seen, df.schema[column].dataType).asNondeterministic()(column)), made


def test_comparing_makes_its_rows_no_oftener_than_one_scan(spark):
    df = spark.range(2000).select(F.col("id").alias("i"), F.lit("huge").alias("c"), F.col("id").cast("double").alias("got"), (F.col("id") * 2.0).alias("ref"))
    df, made = _counting(spark, df, "got")
    assert metrics.compare(df, "c").first()["spearman"] == pytest.approx(1)
    assert made.value <= 3 * 2000  # sampled, once more where buckets are uneven, and dealt


def test_scans_of_scans_make_their_rows_no_oftener_than_one(spark):
    df, made = _counting(spark, spark.range(2000).select("id", F.lit(1).cast("long").alias("x")), "x")
    twice = layout.prefix_sums(layout.prefix_sums(df, "id", "x", "a"), "id", "x", "b")
    got = layout.ranked(twice, ["x", "id"], "place").collect()
    assert all(r["a"] == r["b"] == r["place"] == r["id"] for r in got) and len(got) == 2000
    assert made.value <= 3 * 2000


def test_verdicts_by_copy(spark):
    rows = [(i, copy, c, x * by, x) for i in range(40) for copy, by in (("exact", 1.0), ("drifted", 1.02)) for c in ("norms", "products") for x in [1.0 + (i * 7 % 11)]]
    stats = metrics.compare(spark.createDataFrame(rows, "i long, copy string, channel string, got double, ref double"), "copy", "channel")
    stats = stats.withColumns({"clean": F.col("channel") == "norms", "basis_sensitive": F.col("channel") == "products"})
    got = {r["copy"]: r["verdict"] for r in identity.classify_reproduction(stats, "copy").collect()}
    assert got == {"exact": "EXACT", "drifted": "SAME MODEL, DRIFTED SUBSPACE"}


def test_odds_have_the_last_bits_of_the_c_library(spark):
    terms = {f"term{chr(97 + i // 26)}{chr(97 + i % 26)}": (15 + i, i * 5 % 7) for i in range(150)}
    docs = [(lang, " ".join(" ".join([t] * n[k]) for t, n in terms.items())) for k, lang in enumerate("ab")]
    got = inspection.distinctive_terms(spark.createDataFrame(docs, "lang string, text string"), "text", "lang", top=150).where("lang = 'a'").collect()
    n_a, n_all, v = sum(n[0] for n in terms.values()), sum(sum(n) for n in terms.values()), len(terms)
    want = {t: math.log(((n[0] + 1) / (n_a + v)) / ((sum(n) + 1) / (n_all + v))) for t, n in terms.items()}
    assert {r["term"]: r["logodds"] for r in got} == want
    assert [r["term"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(want, key=lambda t: (want[t], t), reverse=True)


def test_pairs_without_a_side_sort_last(spark):
    rows = [(0, 0, 2.0, None), (0, 1, None, 0.5), (0, 2, 1.0, 0.25)]
    got = metrics.sort_matched(spark.createDataFrame(rows, "batch int, pair_id int, l double, r double"), F.col("l"), F.col("r"), "batch").collect()
    want = {1: math.log1p(math.exp(-0.075)), 2: math.log1p(math.exp(-0.15)), 3: None}
    assert {r["rank"]: r["loss"] for r in got} == {k: x if x is None else pytest.approx(x) for k, x in want.items()}


def test_empty_clusters_of_all_runs_are_filled_in_one_pass(spark, monkeypatch):
    x = np.random.default_rng(31).normal(size=(300, 5))
    rows = vectors(spark, x).repartition(3)
    monkeypatch.setattr(clustering, "worst_fit", None)  # not a pass for each run
    found = {("a", 0): np.vstack([x[:2], -1e9 * np.ones((0, 5)), x[1:2], x[1:2]]), ("b", 0): np.vstack([x[3:5], x[4:5]])}
    got = clustering._converged(rows, found, 5, 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r, n in (("a", 0), 2), (("b", 0), 1):
        c = found[r] / np.linalg.norm(found[r], axis=1, keepdims=True)
        cos = (u @ c.T).max(1)
        assert np.allclose(got[r][-n:], u[np.lexsort((np.arange(300), cos))[:n]])


def test_sums_of_all_runs_are_those_of_loops(spark):
    x = np.random.default_rng(32).normal(size=(1500, 7))
    centers = {(k, s): np.random.default_rng([k, s]).normal(size=(k, 7)) for k in (2, 5) for s in (0, 1)}
    got = clustering._sums(vectors(spark, x).repartition(3), centers, 7)
    for r, c in centers.items():
        cos = (x @ c.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(c, axis=1)
        for k in range(len(c)):
            own = cos.argmax(1) == k
            assert got[r][k][0] == own.sum() and np.isclose(got[r][k][1], cos[own, k].sum()) and np.allclose(got[r][k][2], x[own].sum(0))


def test_running_sums_are_written_a_bucket_a_task(spark):
    got = layout.prefix_sums(spark.range(3200).select("id", F.lit(1).cast("long").alias("x")), "id", "x", "s", buckets=16)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # of the buckets' totals; that of the rows is done
    files = spark.read.parquet(*got.inputFiles()).groupBy(F.input_file_name()).agg(F.count("id").alias("n"), F.count_distinct("_bucket").alias("buckets")).collect()
    assert len(files) == 16 and all(r["n"] < 400 and r["buckets"] == 1 for r in files)
    assert all(r["s"] == r["id"] for r in got.collect())
