import math

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import quality
from tests.llm.fixtures import empty, rows, table

LABELS = "doc_id long, quality int, toxic int, text string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    fitted = labels.where("doc_id % 2 = 0")
    got = quality.judge(docs, fitted).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in got if r["quality"] is not None]
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = np.mean([r["kept"] == (truth[r["doc_id"]] == 1) for r in good])
    assert len(good) > 150 and right > 0.95
    assert np.mean([r["kept"] for r in good if truth[r["doc_id"]] == 1]) > 0.97


def test_site_posteriors_against_a_loop(spark):
    r = np.random.default_rng(3)
    data = [(f"h{k % 7}" if k % 11 else None, f"p{k % 3}", float(r.normal() + k % 7 - 3)) for k in range(500)]
    got = quality.site_posteriors(spark.createDataFrame(data, "host string, path string, evidence double"), 0.7).collect()
    logit = math.log(0.7 / 0.3)
    paths, hosts = {}, {}
    for h, p, e in data:
        for table_, key in ((paths, (h, p)), (hosts, h)):
            n, good = table_.get(key, (0, 0.0))
            table_[key] = (n + 1, good + 1 / (1 + math.exp(-(e + logit))))

    def strength(groups):
        n, g = np.array(groups, float).T
        m = g.sum() / n.sum()
        spread = (n * (g / n - m) ** 2).sum()
        between = (spread - (len(n) - 1) * m * (1 - m)) / (n.sum() - (n * n).sum() / n.sum())
        return float(np.clip(m * (1 - m) / between - 1 if between > 0 else 1000, 1, 1000)), m

    a, mean = strength(list(hosts.values()))
    b, _ = strength(list(paths.values()))
    assert len(got) == len(paths)
    for row in got:
        n, g = hosts[row["host"]]
        host = (g + a * mean) / (n + a)
        n, g = paths[row["host"], row["path"]]
        assert row["host_rate"] == pytest.approx(host)
        assert row["path_rate"] == pytest.approx((g + b * host) / (n + b))
        assert row["documents"] == n


def test_whole_result_against_a_plain_version(spark):
    """Evidence, site rates, posterior and decision of every document, from the fitted model and loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model, data = quality.train(docs, labels), docs.orderBy("doc_id").collect()
    known = [r["quality"] for r in labels.collect() if r["quality"] in (0, 1)]
    rate = sum(known) / len(known)
    evidence = {r["doc_id"]: float(model.evidence(quality.features(pa.array([r["text"]])))[0]) for r in data}
    sites = quality.site_posteriors(spark.createDataFrame([(r["source"], r["lang"], evidence[r["doc_id"]]) for r in data], "host string, path string, evidence double"), rate).collect()
    rates = {(s["host"], s["path"]): (s["host_rate"], s["path_rate"]) for s in sites}
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert set(got) == set(evidence)
    for r in data:
        host, path = rates[r["source"], r["lang"]]
        p = 1 / (1 + math.exp(-(evidence[r["doc_id"]] + math.log(path / (1 - path)))))
        g = got[r["doc_id"]]
        assert (g["evidence"], g["host_rate"], g["path_rate"], g["quality"]) == pytest.approx((evidence[r["doc_id"]], host, path, p))
        assert g["kept"] == (p >= 0.5)
    kept = quality.keep_good(docs, labels)
    assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in data if got[r["doc_id"]]["kept"])


def test_words_speak_where_labels_are_many():
    r = np.random.default_rng(4)
    words = [f"w{k:03d}" for k in range(60)]
    texts = [" ".join(r.choice(words[:40] if k % 2 else words[20:], 30)) for k in range(1200)]
    x, y = quality.features(pa.array(texts)), np.arange(1200) % 2.0
    model = quality.fit(x[:800], y[:800])
    assert np.mean((model.evidence(x[800:]) + model.base > 0) == (y[800:] > 0)) > 0.9


def test_odd_tables(spark):
    labels = spark.createDataFrame([(k, k % 2, 0, "x") for k in range(30)] + [(None, 1, 0, ""), (3, None, 0, ""), (999, 1, 0, "")], LABELS)
    got = quality.judge(table(spark), labels).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in got) == sorted((r[0] is not None, r[0]) for r in rows())
    assert all(0 <= r["quality"] <= 1 and r["kept"] == (r["quality"] >= 0.5) for r in got)
    assert quality.keep_good(table(spark), labels).columns == table(spark).columns
    assert quality.judge(empty(spark), labels).collect() == []
    none = quality.judge(table(spark), spark.createDataFrame([], LABELS)).collect()
    assert len(none) == len(rows()) and all(r["evidence"] == 0 for r in none)


def test_features_do_not_depend_on_neighbours():
    texts = [r[1] for r in rows()]
    whole = quality.features(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(quality.features(pa.array([t], pa.string()))[0], whole[k])
