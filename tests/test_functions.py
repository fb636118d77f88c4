"""Scalar and vector functions at their edges, against plain Python."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import losses, vectors, weights

finite = st.floats(-30, 30, allow_nan=False)


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def array(v):
    return F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")


@settings(max_examples=8, deadline=None)
@given(z=st.lists(finite, min_size=1, max_size=6), data=st.data())
def test_logits(spark, z, data):
    t = data.draw(st.integers(0, len(z) - 1))
    whole = math.log(sum(math.exp(x - max(z)) for x in z)) + max(z)
    p = [math.exp(x - whole) for x in z]
    got = one(spark, vectors.lse(array(z)), vectors.nll(array(z), F.lit(t)), vectors.collision(array(z)), vectors.entropy(array(z)), vectors.position_kl(array(z), array(z)))
    assert got == pytest.approx((whole, whole - z[t], sum(x * x for x in p), -sum(x * math.log(x) if x else 0 for x in p), 0.0), abs=1e-9)
    g = one(spark, vectors.logit_gradient(array(z), F.lit(t)))[0]
    assert sum(map(abs, g)) == pytest.approx(2 * (1 - p[t]), abs=1e-9)
    assert sum(x * x for x in g) == pytest.approx(1 - 2 * p[t] + sum(x * x for x in p), abs=1e-9)


def test_clamps_and_faults(spark):
    p = one(spark, vectors.token_probability(F.lit(0.0)))[0]
    assert p == 1 - 1e-6
    got = one(spark, vectors.norm1_weight(F.lit(p)), vectors.norm2_weight(F.lit(1.0), F.lit(1.0)), vectors.cosine(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert got == pytest.approx((5e5, 1e6, 0.0), rel=1e-6)
    bad = array([1, float("nan"), float("inf"), float("-inf")])
    assert one(spark, vectors.sanitize(bad))[0] == [1.0, 0.0, 0.0, 0.0]
    assert one(spark, vectors.unit(array([0, 0])))[0] == [0.0, 0.0]
    assert one(spark, vectors.log_sigmoid(F.lit(-1000.0)), vectors.log_sigmoid(F.lit(1000.0))) == (-1000.0, 0.0)


def test_unknown_names_raise():
    for call in (lambda: weights.formula("no"), lambda: weights.normalised("x", "no", "k"), lambda: losses.loss("no", F.lit(1), F.lit(1), F.lit(1), F.lit(1)), lambda: losses.divergence(F.lit(1.0), "no"), lambda: losses.loss("exo_pair", F.lit(1), F.lit(1), F.lit(1), F.lit(1), eps=0)):
        with pytest.raises(ValueError):
            call()
    assert len(weights.METHODS) == 13 and weights.METHODS["sigmoid"] == weights.METHODS["sigmoid_c"]


def test_methods(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 2.0), (1, 1, -0.5, -4.0), (2, 0, 0.0, 0.0)], "idx int, t int, c double, p double")
    df = weights.with_scores(df, "idx")
    assert [r["pn"] for r in df.orderBy("idx", "t").collect()] == [0.5, -1.0, 0.0]  # all-zero dots stay 0
    w = {(r["idx"], r["t"]): r["w"] for r in weights.method(df, "altdot", "idx").collect()}
    assert w[1, 0] + w[1, 1] == pytest.approx(1) and w[1, 1] > 0.999 and w[2, 0] == 1.0
    raw = df.withColumn("x", F.when(F.col("t") == 0, 1.0).otherwise(-3.0))
    assert raw.select(weights.normalised("x", "l1", "idx").alias("w")).agg(F.max("w")).first()[0] == 1e12  # a negative sum is clamped


def test_sum_modes(spark):
    rows = [(k, t, 0.3, float(r), t > 0) for k, rs in enumerate([[9, 1.0, 2.0], [9, 1.0, -1.0], [9, -1.0, -2.0]]) for t, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "idx int, t int, w double, r double, is_completion boolean")
    got = {m: [r["wm"] for r in weights.sum_mode(df, m, "idx").orderBy("idx", "t").collect()] for m in weights.SUM_MODES}
    assert got["token_count"] == pytest.approx(got["ignore"])  # constant weights give the plain objective
    assert got["reward_match"][:3] == pytest.approx([0, 1, 1]) and got["reward_match"][6:] == pytest.approx([0, 1, 1])
    assert got["reward_match"][3:6] == pytest.approx([0, 0.5, 0.5])  # a sum near 0 leaves the shares
    assert got["token_scale"][:3] == [0, 0.3, 0.3]


def test_importance_mix(spark):
    df = spark.createDataFrame([(1, t, s) for t, s in enumerate([3.0, -1.0, 1.0, 0.0])] + [(2, 0, 5.0)] + [(3, t, -1.0) for t in range(3)], "idx int, t int, score double")
    for share in (0.0, 0.7, 1.0):
        rows = weights.importance_mix(df, share, "idx").collect()
        for idx, n in ((1, 4), (2, 1), (3, 3)):
            assert sum(r["w"] for r in rows if r["idx"] == idx) == pytest.approx(n)
    full = {r["t"]: r["w"] for r in weights.importance_mix(df, 1.0, "idx").where("idx = 1").collect()}
    assert full == pytest.approx({0: 3.0, 1: 0.0, 2: 1.0, 3: 0.0})


def test_align_and_place(spark):
    w = array([1, 2, 3])
    assert one(spark, weights.align(w, F.lit(2)), weights.align(w, F.lit(5)), weights.align(array([]), F.lit(2)), weights.align(w, F.lit(0))) == ([1, 2], [1, 2, 3, 2, 2], [1, 1], [])
    df = spark.createDataFrame([([0.5, 0.7],)], "w array<double>")
    assert df.select(weights.place("w", F.lit(2), F.lit(6)), weights.place("w", F.lit(2), F.lit(3))).first()[:] == ([0, 0, 0.5, 0.7, 0, 0], [0, 0, 0.5])


@pytest.mark.parametrize("name", sorted(losses.LOSSES))
def test_losses_against_python(spark, name):
    b, eps, tau = 0.1, 0.1, 0.05
    ls = lambda x: -math.log1p(math.exp(-x)) if x > 0 else x - math.log1p(math.exp(x))
    sg = lambda x: 1 / (1 + math.exp(-x))
    for cs, rs, nc, nr in ((1.5, -2.0, 4, 0), (-3.0, 0.5, 1, 7), (0.0, 0.0, 2, 2)):
        d = b * (cs - rs)
        m = sg(d / tau)
        want = {
            "sigmoid": -ls(d), "hinge": max(0, 1 - d), "ipo": (cs / max(nc, 1) - rs / max(nr, 1) - 1 / (2 * b)) ** 2,
            "robust": ((1 - eps) * -ls(d) + eps * ls(-d)) / (1 - 2 * eps), "exo_pair": sg(d) * (ls(d) - math.log1p(-eps)) + sg(-d) * (ls(-d) - math.log(eps)),
            "nca_pair": -ls(b * cs) - 0.5 * ls(-b * cs) - 0.5 * ls(-b * rs), "bco_pair": -ls(b * cs) - ls(-b * rs), "sppo_hard": (cs - 0.5 / b) ** 2 + (rs + 0.5 / b) ** 2,
            "apo_zero": 1 - sg(b * cs) + sg(b * rs), "apo_down": sg(b * cs) + 1 - sg(d), "discopop": -ls(d) * (1 - m) + math.exp(-d) * m,
        }[name]
        got = one(spark, losses.loss(name, F.lit(cs), F.lit(rs), F.lit(float(nc)), F.lit(float(nr)), b, eps, tau))[0]
        assert got == pytest.approx(want, abs=1e-9)
