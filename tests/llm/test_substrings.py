import hashlib
import random

import numpy as np
import pytest

from quillon.llm import substrings
from tests.llm.fixtures import MORE, SCHEMA, empty, prose, rows, table


def brute(data):
    texts = [((r[0] is None, r[0] or 0), (r[1] or "").encode()) for r in data]
    least = {}
    for key, text in texts:
        for i in range(len(text) - 49):
            w = text[i : i + 50]
            least[w] = min(least.get(w, key), key)
    out = []
    for key, text in texts:
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - 49):
            if least[text[i : i + 50]] < key:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((None if key[0] else key[1], len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda x: (x[0] is not None, x))


def got(df):
    return sorted((tuple(r) for r in substrings.digest(df).collect()), key=lambda x: (x[0] is not None, x))


def cases():
    r = random.Random(2)
    data = list(rows())
    bases = [prose(70 + k, 150) for k in range(5)] + ["ab" * 300, " " * 900, "a" * 49, "\x00" * 120]
    for k in range(60):
        text = ""
        for _ in range(r.randint(1, 4)):
            base = r.choice(bases)
            a = r.randrange(len(base))
            text += base[a : a + r.randint(30, 200)] + r.choice(["", "x", prose(r.randrange(999), 8)])
        data.append((3000 - 7 * k, text, "en", "s", 0, *MORE))
    return data


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH", 50)
    data = cases()
    assert got(spark.createDataFrame(data, SCHEMA)) == brute(data)


def test_odd_tables(spark):
    assert got(empty(spark)) == []
    assert got(table(spark)) == brute(rows())


@pytest.mark.parametrize("seed", range(5))
def test_transform_against_sorting(seed, monkeypatch):
    monkeypatch.setattr(substrings, "SPOOL", 100)
    r = random.Random(seed)
    strings = [bytes(r.choice(b"ab\x00\xff") for _ in range(r.randint(1, 70))) for _ in range(40)]
    strings += [strings[0], strings[1] + strings[2][:6]]
    bwt, lcp, owner, offset = substrings.column_wise_transform(strings)
    suffixes = sorted((s[k:], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert [strings[o][k:] for o, k in zip(owner.tolist(), offset.tolist())] == [s for s, _, _ in suffixes]
    assert sorted(zip(owner.tolist(), offset.tolist())) == sorted((i, k) for _, i, k in suffixes)
    for k in range(1, len(suffixes)):
        a, b = suffixes[k - 1][0], suffixes[k][0]
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == common
    assert all(bwt[k] == strings[o][f - 1] for k, (o, f) in enumerate(zip(owner, offset)) if f)


def test_greatest_id_is_no_null(spark):
    text = "a passage of well over fifty bytes that comes in both of these documents"
    rows = [(2**63 - 1, text + " x"), (-(2**63), text), (None, text + " y")]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2**63 - 1: len(text), -(2**63): 0, None: len(text)}


def test_little_text_is_staged_in_few_files(spark, monkeypatch):
    from quillon.llm import substrings

    parts, staged = [], substrings.staged
    monkeypatch.setattr(substrings, "staged", lambda df, name: parts.append(df.rdd.getNumPartitions()) or staged(df, name))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        substrings.repeated_windows_of(spark.createDataFrame([(i, f"text {i % 3} " * 30) for i in range(12)], "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 3 and max(parts) <= spark.sparkContext.defaultParallelism
