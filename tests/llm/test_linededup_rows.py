"""Rows without an id, and rows that share one, each lose their own lines."""

import random
import re
from collections import Counter

from quillon.llm import linededup

SCHEMA = "doc_id long, text string, n_chars long, source string"


def cases():
    r = random.Random(4)
    bases = [" ".join(f"b{k}w{j}" for j in range(12)) for k in range(8)]
    data = [(5, "here first", "a"), (None, "own line zero\nhere first", "a"), (None, "another line zero\nmy second line\nhere first", "b")]
    data += [(7, "seven one\nseven two", "a"), (7, "seven two\nseven one\nseven three", "b"), (7, "seven one\nseven two", "c")]
    data += [(None, "copied\n\n \ntwice\ncopied", s) for s in "abb"] + [(None, t, s) for t in (None, "", " \t\n") for s in "ab"]
    data += [((1 << 63) - 1, "the greatest id", "a"), (None, "the greatest id", "a")]
    for _ in range(60):
        lines = []
        for _ in range(r.randint(1, 4)):
            words = r.choice(bases).split()
            for _ in range(r.choice([0, 1, 4])):
                words[r.randrange(12)] = f"x{r.randrange(40)}"
            lines.append(" ".join(words))
        data.append((r.choice([None, None, 100, 101, 102]), "\n".join(lines), r.choice("ab")))
    return [(i, t, len(t or ""), s) for i, t, s in data]


def brute(data, digests, threshold=0.8):
    """Removed line numbers of each row, and whether it is a copy of a row without an id."""
    copies, rows = Counter(), []
    for i, t, _, _ in data:
        rows.append((i is None, i or 0, digests[i, t], copies[t] if i is None else 0))
        copies[t] += i is None
    lines = []
    for k, (_, t, _, _) in enumerate(data):
        for j, line in enumerate((t or "").split("\n")):
            if words := frozenset(re.findall(r"[^\x20\x09-\x0D]+", line)):
                lines.append((rows[k], j, words, k))
    gone = [set() for _ in data]
    for place, j, words, k in lines:
        if any((p, i) < (place, j) and len(words & o) >= threshold * len(words | o) - 1e-9 for p, i, o, _ in lines):
            gone[k].add(j)
    return gone


def test_rows_without_an_id_or_sharing_one(spark):
    data = cases()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    digests = {(r["doc_id"], r["text"]): r["d"] for r in df.select("doc_id", "text", linededup._digest().alias("d")).collect()}
    gone = brute(data, digests)
    want = Counter((i, len((t or "").split("\n")), tuple(sorted(g))) for (i, t, _, _), g in zip(data, gone))
    assert Counter((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in linededup.removed_lines(df).collect()) == want
    kept = [(i, None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in g)) for (i, t, _, _), g in zip(data, gone)]
    out = linededup.remove_lines(df).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(kept)
    assert all(r["n_chars"] == len(r["text"] or "") for r in out)
    assert Counter(r["source"] for r in out) == Counter(s for *_, s in data)


def test_many_copies_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(linededup, "UNFOLD", 7)
    monkeypatch.setattr(linededup, "COPY_GROUPS", 3)
    df = spark.range(50).selectExpr("cast(null as long) as doc_id", "'a line\n\nof many' as text", "17L as n_chars", "'s' as source").repartition(4)
    assert Counter(tuple(r["removed"]) for r in linededup.removed_lines(df).collect()) == {(): 1, (0, 2): 49}
    assert Counter(r["text"] for r in linededup.remove_lines(df).collect()) == {"a line\n\nof many": 1, "": 49}
