"""Restoring disguised words, beside an enumeration of all paths, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import toxicity

from . import fixtures

BAD = ["idiot", "stupid", "pathetic", "worthless", "clown", "grobian"]
SWAPS = {"i": "1!", "o": "0", "e": "3", "a": "4@", "s": "5$", "t": "7"}


def spoken(r, n):
    syllables = ["an", "the", "or", "ti", "on", "er", "wh", "ing", "mor", "lun", "sel", "pa"]
    return ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n)]


def corpus(r, n):
    rows, labels = [], []
    for k in range(n):
        words, bad = spoken(r, r.randint(20, 60)), k % 3 == 0
        for _ in range(2 * bad):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def swapped(r, word):
    return "".join(r.choice(SWAPS[c]) if c in SWAPS and k % 2 else c for k, c in enumerate(word))


def disguised(r, word):
    return r.choice([swapped(r, word), " ".join(word), ".".join(word), word[:2] + word[2] * 4 + word[3:]])


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus(random.Random(3), 900)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, known, toxicity.train(docs, known)


def cheapest(token, costs):
    """All paths, one by one."""
    best = None
    for path in itertools.product(*toxicity.lattice(token)):
        letters = "".join(e for e, _ in path) + " "
        total, a, b = sum(c for _, c in path), 0, 0
        for c in letters:
            s = int(toxicity._symbols(c)[0])
            if s or b:
                total += float(costs[a, b, s])
            a, b = (b, s) if s else (0, 0)
        if best is None or (total, letters) < best:
            best = (total, letters)
    return " ".join(best[1].split())


def test_viterbi_against_all_paths(model):
    costs, r = model[2].costs, random.Random(8)
    for _ in range(150):
        token = "".join(r.choice("idot10!5s$ .aaee|3") for _ in range(r.randint(1, 7)))
        assert toxicity.decode(token, costs) == cheapest(token, costs), token


def test_letter_counts_against_a_loop(spark):
    texts = ["Abc ab", None, "", "é é1b", "xyz" * 50, "日本 \n a"]
    got = toxicity.letter_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.zeros(toxicity.SYMBOLS**3)
    for t in texts:
        s = [0, 0, *map(int, toxicity._symbols((t or "").lower())), 0, 0]
        for k in range(2, len(s)):
            a, b, c = (0 if s[k - 1] == 0 else s[k - 2]), s[k - 1], s[k]
            if b or c:  # how many gaps lie between words does not matter to any cost of a letter
                want[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    got[0] = want[0] = 0
    assert (got == want).all()


def test_restores_words(model):
    costs = model[2].costs
    found = {t: toxicity.decode(t, costs) for t in ("1d10t", "5tup1d", "cl0wn", "i d i o t", "s.t.u.p.i.d", "stuuuupid", "p@th3t1c", "w0rthl3ss", "st*pid")}
    assert found == dict(zip(found, ["idiot", "stupid", "clown", "idiot", "stupid", "stupid", "pathetic", "worthless", "stupid"]))


def test_restore_texts(spark, model):
    df = spark.createDataFrame([(1, "You 1d10t, s t u p i d !"), (2, None), (3, "plain words")], "doc_id long, text string")
    got = {r["doc_id"]: r["restored"] for r in toxicity.restore_texts(df, model[2].costs).collect()}
    assert "idiot" in got[1].split() and "stupid" in got[1] and got[2] == "" and got[3] == "plain words"


def test_held_out_accuracy_with_disguise(spark, model):
    docs, known, m = model
    plain = {r["doc_id"]: r for r in toxicity.score(docs, known, m).collect()}
    assert all(plain[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in plain)
    judged = [(k, k % 3 == 0) for k in plain if plain[k]["held_out"]]
    assert sum(plain[k]["predicted"] == bad for k, bad in judged) / len(judged) > 0.98
    r = random.Random(11)
    hidden = [(k, " ".join([*spoken(r, 25), *([disguised(r, r.choice(BAD[:5]))] if k % 2 else []), *spoken(r, 25)])) for k in range(300)]
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(spark.createDataFrame(hidden, "doc_id long, text string"), known, m).collect()}
    assert sum(got[k] for k in got if k % 2) / 150 > 0.9 and sum(got[k] for k in got if k % 2 == 0) / 150 < 0.03


def test_feature_counts_against_a_loop(spark, model):
    docs, known, m = model
    labelled = docs.where("doc_id < 60").join(known.select("doc_id", F.col("toxic").alias("y")), "doc_id").repartition(4)
    got = {r["feature"]: (r["toxic"], r["clean"]) for r in toxicity.feature_counts(labelled, m.costs).collect()}
    want = {}
    for r in labelled.collect():
        for f in {f for w in r["text"].split() for f in toxicity.features(w)}:
            pair = want.setdefault(f, [0, 0])
            pair[1 - r["y"]] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_held_out_labels_and_other_columns_change_nothing(spark, model):
    docs, known, _ = model
    before = sorted(map(tuple, toxicity.score(docs, known).collect()))
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("source", F.lit("toxic")).withColumn("a.b", F.lit(1)).withColumn("score", F.lit("x"))
    assert sorted(map(tuple, toxicity.score(other, flipped).collect())) == before


def test_odd_tables(spark):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(20)] + [(3, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    odd = fixtures.table(spark)
    got = toxicity.score(odd, labels)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(fixtures.empty(spark), labels).count() == 0
    one_kind = toxicity.score(odd, labels.where("toxic = 1"))
    assert one_kind.select("score").distinct().count() == 1
    assert {r["score"] for r in toxicity.score(odd, labels.where("toxic > 7")).collect()} == {0.5}
    odd_ids = spark.createDataFrame([(-(2**63), "a"), (2**63 - 1, "b"), (None, "c")], "doc_id long, text string")
    assert {r["doc_id"]: r["held_out"] for r in toxicity.score(odd_ids, labels).collect()} == {k: zlib.crc32(b"" if k is None else str(k).encode()) % 5 == 0 for k in (-(2**63), 2**63 - 1, None)}
