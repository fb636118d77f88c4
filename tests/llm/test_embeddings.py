import numpy as np
import pytest

from quillon.llm import embeddings
from quillon.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, links string, component string"


def brute(rows):
    ids = [r[0] for r in rows]
    ok = [r[0] is not None and r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if k else None for r, k in zip(rows, ok)]
    near = [[i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98 for j in range(len(rows))] for i in range(len(rows))]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if near[i][j] and group[j] < group[i]:
                    group[i], changed = group[j], True
    out = []
    for i in range(len(rows)):
        least = min((ids[j] for j in range(len(rows)) if group[j] == group[i] and ids[j] is not None), default=None)
        out.append((ids[i], sum(near[i]), least, ids[i] is not None and ids[i] == least))
    return out


def case():
    r = np.random.default_rng(5)
    rows = []
    for c in range(12):
        base = r.normal(size=16)
        for k in range(r.integers(1, 25)):
            rows.append((len(rows) * 3 % 997, (base + r.normal(size=16) * r.choice([0.0, 0.1, 0.2])).tolist(), int(c % 3), "x", "y"))
    rows += [(2000, None, 1, "", ""), (2001, [0.0] * 16, 1, "", ""), (2002, [float("nan")] * 16, 1, "", ""), (2003, [None] + [1.0] * 15, 1, "", "")]
    rows += [(2004, rows[0][1], None, "", ""), (None, rows[0][1], 0, "", ""), (2005, [1.0, 2.0], 0, "", ""), (2006, [2.0, 4.0], 0, "", ""), (2007, [], 0, "", "")]
    rows += [(2008, [1e30] * 16, 2, "", ""), (2009, [1e-30] * 16, 2, "", "")]
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    df = spark.createDataFrame(case(), SCHEMA)
    rows = [tuple(r) for r in df.collect()]
    order = lambda x: (x[0] is not None, x[0])
    assert sorted((tuple(r) for r in embeddings.link_vectors(df).collect()), key=order) == sorted(brute(rows), key=order)
    assert embeddings.link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("dim", [16, 64, 256])
def test_recall_on_planted_pairs(spark, dim):
    """Pairs just above the threshold among other vectors, half of them with a common mean: at least 0.98 are found."""
    r = np.random.default_rng(dim)
    x = r.normal(size=(3000, dim)) + np.repeat([0.0, 1.0], 1500)[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = r.uniform(0.9801, 0.99, (len(x), 1))
    v = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * y])
    df = spark.createDataFrame([(k, e, 0) for k, e in enumerate(v.tolist())], "vec_id long, embedding array<double>, label int")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = ((v @ v.T >= 0.98) & ~np.eye(len(v), dtype=bool)).sum(1)
    got = {q["vec_id"]: q["n_links"] for q in embeddings.link_vectors(df).collect()}
    assert near.sum() >= 6000 and all(got[k] <= n for k, n in enumerate(near.tolist()))
    assert sum(got.values()) >= 0.98 * near.sum()


def test_repeated_rows(spark):
    rows = [(1, [1.0, 2.0], 0)] * 3 + [(2, [2.0, 4.1], 0)]
    got = embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 1, True)] * 3 + [(2, 3, 1, False)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = np.random.default_rng(seed)
    links = r.integers(0, 300, (200, 2)).tolist() + [[k, k + 1] for k in range(400, 440)] + [[900, k] for k in range(800, 860)] + [[5, 5]]
    name = {}
    for a, b in links:
        name.setdefault(a, a), name.setdefault(b, b)
    for _ in range(100):
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: got.get(k, k) for k in name} == name
