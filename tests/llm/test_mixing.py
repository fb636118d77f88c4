import re
from collections import Counter, defaultdict

import pytest

from quillon.llm import mixing
from tests.llm.fixtures import MORE, SCHEMA, empty, rows, table


def water_fill(sizes, weights):
    target, capped = {}, set()
    total = sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weights[s] for s in free) if free else 0
        target = {s: 3 * sizes[s] if s in capped else level * weights[s] for s in sizes}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def check(data, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in data:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s))
    target = water_fill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in data)
    taken, cut = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["size"] * (r["copies"] - 1) < r["taken"] <= r["size"] * r["copies"] or r["taken"] == r["copies"] == 0
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        cut[r["source"]] += r["taken"] != r["size"] * r["copies"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6 and cut[s] <= 1
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


def test_targets_and_takes(spark):
    check(rows(), mixing.mix(table(spark)).collect())
    assert mixing.mix(empty(spark)).collect() == []


def test_capped_sources(spark):
    data = [(k, "w " * (500 if k < 6 else 3), "en", f"s{k // 2}", 0, *MORE) for k in range(14)]
    check(data, mixing.mix(spark.createDataFrame(data, SCHEMA)).collect())


def test_reruns_agree(spark):
    a = sorted(map(str, mixing.mix(table(spark)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(str, mixing.mix(table(spark).repartition(5)).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_order_follows_the_schedules(spark):
    data = [(k, "w " * 10, "en", f"s{k % 3}", 0, *MORE) for k in range(900)]
    run = mixing.training_order(spark.createDataFrame(data, SCHEMA)).collect()
    half = len(run) // 2
    first = Counter(r["source"] for r in run[:half])
    last = Counter(r["source"] for r in run[half:])
    assert first["s0"] > last["s0"] and first["s2"] < last["s2"]  # falling and rising weights
    drawn = Counter(r["doc_id"] for r in run)
    assert drawn == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(data, SCHEMA)).collect() if r["copies"]})


def test_the_run_holds_the_words_taken(spark):
    df = table(spark)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    run = mixing.training_order(df).collect()
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in run:
        got[r["doc_id"]] += len(words(r["text"]))
    assert +got == +want and all(words(r["text"]) for r in run)
    texts = {r[1] for r in rows()}
    cut = [r for r in run if r["text"] not in texts]
    assert all(any(t and t.startswith(r["text"]) for t in texts) and r["n_chars"] == len(r["text"]) for r in cut)
    assert mixing.training_order(empty(spark)).collect() == []


def test_rows_that_differ_elsewhere_are_all_drawn(spark):
    data = [(1, "same text here", "s", tag) for tag in ("x", "y", None, "x")] + [(None, "same", "s", "u"), (None, "same", "s", "v")]
    data += [(k, "other words of this one", "t", "z") for k in range(5, 9)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, tag string")
    run = mixing.training_order(df, weights=(1.0, 1.0)).collect()
    assert sum(len(r["text"].split()) for r in run) == pytest.approx(sum(len(r[1].split()) for r in data), abs=1)
    assert {"x", "y", None, "u", "v"} <= {r["tag"] for r in run if r["source"] == "s"}
