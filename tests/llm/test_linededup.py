import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import linededup, minhash
from tests.llm.fixtures import MORE, SCHEMA, empty, prose, rows, table


def brute(data, threshold=0.8):
    """{id: removed line numbers}, equal ids holding equal places."""
    lines = []
    for r in data:
        for k, line in enumerate((r[1] or "").split("\n") if r[1] is not None else [""]):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if words:
                lines.append((r[0] is None, r[0] or 0, k, words))
    gone = {}
    for i, (x, doc, k, words) in enumerate(lines):
        if any(o[:3] < (x, doc, k) and len(words & o[3]) >= threshold * len(words | o[3]) - 1e-9 for o in lines):
            gone.setdefault(None if x else doc, set()).add(k)
    return gone


def got(df):
    return {r["doc_id"]: set(r["removed"]) for r in linededup.removed_lines(df).collect() if r["n_removed"]}


def cases():
    r = random.Random(9)
    data = [x for x in rows() if x[0] != 28]
    bases = [re.sub(r"\s", " ", prose(50 + k, n)) for k, n in enumerate([4, 5, 9, 20, 40, 80, 150, 420])]
    for k in range(120):
        lines = []
        for _ in range(r.randint(1, 5)):
            words = r.choice(bases).split()
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                words[r.randrange(len(words))] = f"w{r.randrange(3000)}"
            r.shuffle(words)
            lines.append(" ".join(words))
        data.append((2000 + r.randrange(10**6), "\n".join(lines), "en", "s", 0, *MORE))
    return data


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    data = cases()
    assert got(spark.createDataFrame(data, SCHEMA)) == brute(data)


def test_odd_tables(spark):
    assert linededup.removed_lines(empty(spark)).collect() == []
    out = linededup.removed_lines(table(spark))
    assert out.count() == len(rows())
    kept = {r["doc_id"]: r for r in linededup.remove_lines(table(spark)).collect()}
    gone = brute(rows())
    assert linededup.remove_lines(table(spark)).columns == table(spark).columns
    for r in rows():
        lines = (r[1] or "").split("\n")
        want = None if r[1] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone.get(r[0], ()))
        assert kept[r[0]]["text"] == want
        assert kept[r[0]]["n_chars"] == len(want or "")


@pytest.mark.parametrize("seed", range(4))
def test_candidates_hold_every_similar_pair(seed, monkeypatch):
    """Long lists and hot words: each similar pair ends in one family."""
    monkeypatch.setattr(linededup, "LIST_BLOCK", 50)
    r = random.Random(seed)
    texts = []
    for _ in range(400):
        words = [f"base{k}" for k in range(25)]
        for _ in range(r.randrange(7)):
            words[r.randrange(25)] = f"x{r.randrange(60)}"
        texts.append(" ".join(dict.fromkeys(words)))
    texts = list(dict.fromkeys(texts))
    lines = linededup.Lines(pa.array(texts))
    word, count = np.unique(lines.words, return_counts=True)
    some = count >= 4
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    blobs = list(linededup._postings(0.8, word[some], count[some], 7)(iter([batch])))
    family = {int(x): int(x) for x in lines.node}
    links = [(a, b) for out in linededup._candidates(0.8)(iter(blobs)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())]
    for _ in range(30):
        for a, b in links:
            family[a] = family[b] = min(family[a], family[b])
    sets = [set(t.split()) for t in texts]
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                assert family[int(lines.node[i])] == family[int(lines.node[j])]
