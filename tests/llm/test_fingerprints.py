import hashlib
import re

from quillon.llm import fingerprints
from pyspark.sql import functions as F
from tests.llm.fixtures import MORE, SCHEMA, empty, rows, table

PHRASE = re.compile(r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,8}|[\x20\x09-\x0D]+")


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def tree(text):
    sections, leaves = [], set()
    for section in text.split("\n\n"):
        paragraphs = []
        for paragraph in section.split("\n"):
            own = [md5(p)[:8] for p in PHRASE.findall(paragraph)]
            leaves |= set(own)
            paragraphs.append((md5("".join(own)), "".join(own)))
        sections.append((md5("".join(p for p, _ in paragraphs)), paragraphs))
    root = md5("".join(s for s, _ in sections))
    return root, root + "/" + "|".join(s[:8] + ":" + ";".join(p[:8] + "=" + o for p, o in ps) for s, ps in sections), leaves


def like(a, b):
    if a[0] == b[0]:
        return 1.0
    total = len(a[2]) + len(b[2])
    return 2.0 * len(a[2] & b[2]) / total if total else 0.0


def brute(data):
    docs = sorted(((r[0], r[1] or "") for r in data), key=lambda d: (d[0] is not None, d[0], md5(d[1])))
    out = []
    for k, (doc, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        own, new, nxt = tree(text), tree(edited), tree(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own[1], new[1], like(own, new), like(own, nxt)))
    return sorted(map(str, out))


def test_against_brute_force(spark):
    assert sorted(str(tuple(r)) for r in fingerprints.fingerprint_edits(table(spark)).collect()) == brute(rows())
    assert fingerprints.fingerprint_edits(empty(spark)).collect() == []
    one = spark.createDataFrame(rows()[:1], SCHEMA)
    assert [str(tuple(r)) for r in fingerprints.fingerprint_edits(one).collect()] == brute(rows()[:1])


def test_hot_ids_are_cut_by_their_texts(spark):
    """A third of the rows without an id, a third with one id, some of them copies of one text."""
    data = [(None, f"a {k % 90} b\nc d {k % 7}") for k in range(400)] + [(5, f"e {k % 300} f") for k in range(400)]
    data += [(k, f"g {k} h\n\ni") for k in range(400)] + [(None, None)] * 9 + [(5, "same")] * 5000 + [(399, "last")] * 2
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    starts, shares = fingerprints._shares(df.withColumn("_k", F.coalesce("doc_id", F.lit(-(1 << 63)))).fillna("", ["text"]))
    hot = {k for k, m in zip(starts, shares) if m > 1}
    assert {-(1 << 63), 5} <= hot
    assert sorted(str(tuple(r)) for r in fingerprints.fingerprint_edits(df).collect()) == brute(data)
    one = spark.createDataFrame([(None, f"t {k}") for k in range(500)], "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in fingerprints.fingerprint_edits(one).collect()) == brute([tuple(r) for r in one.collect()])


def test_edits_are_located(spark):
    df = spark.createDataFrame([("a b c\n\nd e f\n\ng h i", "a b c\n\nd X f\n\ng h i")], "x string, y string")
    df = fingerprints.fingerprint(fingerprints.fingerprint(df, "x", "fx"), "y", "fy")
    assert df.select(fingerprints.differing_sections("fx", "fy")).first()[0] == [1]
    assert df.select(F.col("fx") == F.col("fy")).first()[0] is False


def test_columns_that_clash_are_kept(spark):
    df = spark.createDataFrame([("a b\nc", 1, 2, 3, "x", "y")], "text string, _l int, _p int, _s int, _text string, fingerprint_leaves string")
    got = fingerprints.fingerprint(df).first()
    assert tuple(got)[:6] == ("a b\nc", 1, 2, 3, "x", "y") and got["fingerprint"] == tree("a b\nc")[1]
