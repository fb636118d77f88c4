import random
import re
from collections import Counter

import numpy as np

from quillon.llm import minhash
from tests.llm.fixtures import MORE, SCHEMA, empty, prose, rows, table


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(data, threshold=0.8):
    sets = [shingles(r[1]) for r in data]
    name = {r[0]: r[0] for r in data}
    changed = True
    near = [
        (a[0], b[0]) for i, a in enumerate(data) for j, b in enumerate(data)
        if a[0] is not None and b[0] is not None and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])
    ]
    while changed:
        changed = False
        for a, b in near:
            if name[a] != name[b]:
                name[a] = name[b] = min(name[a], name[b])
                changed = True
    return sorted(((r[0], name[r[0]], r[0] is None or r[0] == name[r[0]]) for r in data), key=lambda x: (x[0] is not None, x[0]))


def got(df):
    return sorted((tuple(r) for r in minhash.classes(df).collect()), key=lambda x: (x[0] is not None, x[0]))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(4)
    data = rows()
    for family in range(8):  # chains and clouds of near copies around the threshold
        words = prose(100 + family, 120).split()
        for k in range(r.choice([2, 5, 25])):
            copy = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = f"w{r.randrange(10**6)}"
            data.append((1000 + len(data), " ".join(copy), "en", "s", 0, *MORE))
            if r.random() < 0.3:
                words = copy
    df = spark.createDataFrame(data, SCHEMA)
    assert got(df) == brute(data)


def test_odd_tables(spark):
    assert got(empty(spark)) == []
    assert got(table(spark).where("doc_id in (25, 26, 27, 29)")) == [(k, k, True) for k in (25, 26, 27, 29)]
    kept = minhash.keep_one(table(spark))
    assert kept.columns == table(spark).columns
    assert sorted(r[0] for r in kept.collect() if r[0] is not None) == sorted({x[1] for x in brute(rows()) if x[1] is not None})


def test_weighted_agreement():
    r = np.random.default_rng(1)
    n = 200
    w = r.uniform(0.2, 9, (n, 40))
    v = w * r.uniform(0.4, 1.4, (n, 40))
    e = r.integers(0, 1 << 62, (n, 40)).astype(np.uint64)
    s = minhash.dart_signatures(np.concatenate([e, e]).ravel(), np.concatenate([w, v]).ravel(), np.repeat(np.arange(2 * n), 40), 2 * n)
    true = np.minimum(w, v).sum(1) / np.maximum(w, v).sum(1)
    off = (s[:n] == s[n:]).mean(1) - true
    assert abs(off.mean()) < 0.01 and np.sqrt((off**2).mean()) < 0.05


def bags(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_bags(data, threshold=0.8):
    """Classes of documents told apart by id and text; class ids are the least ids."""
    found = [bags(r[1]) for r in data]
    name = list(range(len(data)))
    near = [
        (i, j) for i in range(len(data)) for j in range(len(data))
        if data[i][0] is not None and data[j][0] is not None and found[i] and found[j] and (found[i] & found[j]).total() >= threshold * (found[i] | found[j]).total()
    ]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if name[i] != name[j]:
                name[i] = name[j] = min(name[i], name[j])
                changed = True
    least = {}
    for k, r in enumerate(data):
        if r[0] is not None:
            least[name[k]] = min(least.get(name[k], r[0]), r[0])
    out = [(r[0], None if r[0] is None else least[name[k]], r[0] is None or r[0] == least[name[k]]) for k, r in enumerate(data)]
    return sorted(out, key=lambda x: (x[0] is not None, x[0], x[1]))


def test_weighted_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(6)
    data = rows()
    for family in range(8):
        lines = [prose(200 + 10 * family + k, 12).replace("\n", " ") for k in range(6)]
        for k in range(r.choice([2, 5, 20])):  # copies whose lines come more or less often
            text = "\n".join(line for line in lines for _ in range(r.choice([1, 3, 3, 3, 4])))
            data.append((2000 + len(data), text, "en", "s", 0, *MORE))
    got = [tuple(x) for x in minhash.classes(spark.createDataFrame(data, SCHEMA), weighted=True).collect()]
    assert sorted(got, key=lambda x: (x[0] is not None, x[0], x[1])) == brute_bags(data)
    assert any(not k for _, _, k in got[len(rows()) :])


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    t, u = prose(7, 60), prose(8, 60)
    data = [(3, t, "a"), (5, t, "b"), (5, u, "c"), (5, u, "d"), (6, u + " more", "e"), (5, None, "f"), (5, " ", "g"), (None, t, "h"), (None, t, "i")]
    df = spark.createDataFrame(data, "doc_id long, text string, tag string")
    for weighted in (False, True):
        kept = [tuple(x) for x in minhash.keep_one(df, weighted=weighted).collect()]
        assert sorted((i, x) for i, x, _ in kept if i is not None and x and x.strip()) == sorted([(3, t), (5, u)])
        assert Counter(i for i, _, _ in kept) == Counter({3: 1, 5: 3, None: 2})


def test_signatures_take_no_more_text_at_a_time_than_a_slice(monkeypatch):
    import pyarrow as pa

    from quillon.llm import minhash
    from quillon.llm.tokens import SLICE_BYTES

    seen, elements = [], minhash._elements
    monkeypatch.setattr(minhash, "_elements", lambda texts, weighted: seen.append(sum(map(len, texts.to_pylist()))) or elements(texts, weighted))
    texts = [f"one two three four five{i} " * 4000 for i in range(30)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(30)), "text_hash": list(range(30)), "text": texts})
    assert sum(b.num_rows for b in minhash._signed(True)(iter([batch]))) == 30
    assert max(seen) <= SLICE_BYTES
