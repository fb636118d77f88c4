"""Three-way merge beside a loop over rows, and cases with a known result."""

import hashlib
import random
import zlib

import pytest

from quillon.llm import merging

from . import fixtures

LEAST, GREATEST = -(2**63), 2**63 - 1


def code(branch, doc_id, name):
    return zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 11


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merged(doc_id, text, lang, source):
    n, changed, columns, lines = dict.fromkeys(merging.COUNTS, 0), {"L": False, "R": False}, {}, []
    for name, old in (("lang", lang), ("source", source)):
        new = {b: {0: "", 1: old + "!", 2: old + "?"}.get(code(b, doc_id, name), old) for b in "LR"}
        sides = [b for b in "LR" if new[b] != old]
        for b in sides:
            changed[b] = True
        fought = len(sides) == 2 and new["L"] != new["R"]
        n["n_edit_edit"] += fought
        n["n_clean"] += bool(sides) and not fought
        columns[name] = old if fought or not sides else new[sides[0]]
    for k, line in enumerate(text.split("\n")):
        codes = {b: code(b, doc_id, k) for b in "LR"}
        for b in "LR":
            changed[b] |= codes[b] <= 4
        for kinds, conflict in (((0, 1, 2), "n_edit_edit"), ((3, 4), "n_insert_insert")):
            acts = {codes[b] for b in "LR" if codes[b] in kinds}
            if len(acts) == 2:
                n["n_edit_delete" if 0 in acts else conflict] += 1
                acts = set()
            else:
                n["n_clean"] += len(acts)
            act = acts.pop() if acts else None
            if kinds == (0, 1, 2) and act != 0:
                lines.append(line + {None: "", 1: "!", 2: "?"}[act])
            if kinds == (3, 4) and act:
                lines.append({3: "!", 4: "?"}[act])
    drops = {b: code(b, doc_id, "row") == 0 for b in "LR"}
    if not any(drops.values()):
        return columns["lang"], columns["source"], "\n".join(lines), n
    n = dict.fromkeys(n, 0)
    if all(drops.values()) or not changed["R" if drops["L"] else "L"]:
        return None, None, None, n | {"n_clean": 1}
    return lang, source, text, n | {"n_edit_delete": 1}


def brute(rows):
    base, out, added = {}, {}, {}
    for doc_id, *row in rows:
        base[doc_id] = max(base.get(doc_id, ("", "", "")), tuple(x or "" for x in row))
    for doc_id, (text, lang, source) in base.items():
        out[doc_id] = merged(doc_id, text, lang, source)
        for k, b in enumerate("LR", 1):
            new = None if doc_id is None else -k - doc_id
            if code(b, doc_id, "row") in (3, 4) and new is not None and new >= LEAST:
                added.setdefault(new, set()).add(({3: "!", 4: "?"}[code(b, doc_id, "row")], lang, source))
    for doc_id, states in added.items():
        none = dict.fromkeys(merging.COUNTS, 0)
        if doc_id in out:
            out[doc_id][3]["n_insert_insert"] += 1
        elif len(states) == 1:
            (text, lang, source), = states
            out[doc_id] = lang, source, text, none | {"n_clean": 1}
        else:
            out[doc_id] = None, None, None, none | {"n_insert_insert": 1}
    key = lambda r: (r[0] is not None, r[0] or 0)
    return sorted(((i, lang, source, None if text is None else sha(text), *n.values()) for i, (lang, source, text, n) in out.items()), key=key)


def check(spark, df):
    got = sorted((tuple(r) for r in merging.merge_coded(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == brute([tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()])
    return got


def test_against_a_loop(spark):
    r = random.Random(5)
    rows = [(i, r.choice([None, "", "\n", "a\nb", "\n".join(r.choice("xyz") for _ in range(r.randint(1, 9)))]), r.choice([None, "", "en"]), r.choice([None, "", "s"])) for i in range(-300, 1500)]
    got = check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    for k in range(4, 8):
        assert any(row[k] for row in got)  # every kind comes up


def test_odd_tables(spark):
    more = fixtures.table(spark).withColumnRenamed("bucket", "a.b").withColumnRenamed("key", "place")
    check(spark, more)
    extremes = spark.createDataFrame([(i, "x\n" * 700, "en", None) for i in (LEAST, LEAST + 1, GREATEST, GREATEST - 1, None, None, 0, -1, -2)], "doc_id long, text string, lang string, source string")
    check(spark, extremes)
    assert merging.merge_coded(fixtures.empty(spark)).count() == 0


def test_repeated_rows_are_one_state(spark):
    rows = [(7, "one\ntwo", "en", "s")] * 5 + [(7, "one", "en", "s"), (None, "a", None, None), (None, "b", None, None)]
    got = check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert len({r[0] for r in got}) == len(got)


def test_many_fragments(spark):
    text = "\n".join(map(str, range(2 * merging.FAN * merging.FAN // 100)))
    check(spark, spark.createDataFrame([(k, text, "en", "s") for k in range(3)], "doc_id long, text string, lang string, source string"))


@pytest.mark.parametrize("order", [1, -1])
def test_units_fold_in_any_order_and_repeatedly(spark, order):
    units = [(1, -3, "B", ""), (1, -2, "B", "s"), (1, -1, "B", "en"), (1, 0, "B", "a"), (1, 2, "B", "b"), (1, 4, "B", "c")]
    units += [(1, 0, "L", "A"), (1, 2, "L", None), (1, 2, "R", "bb"), (1, 3, "R", "new"), (1, 4, "R", "C"), (1, 4, "L", "C"), (1, -1, "R", "de")]
    df = spark.createDataFrame(units[::order] * 2, merging.UNIT_SCHEMA).repartition(3)
    row = merging.merge(df).first()
    assert row["text"] == "A\nb\nnew\nC" and row["lang"] == "de" and row["source"] == "s" and row["present"]
    assert [row[c] for c in merging.COUNTS] == [4, 0, 1, 0]


def test_whole_rows(spark):
    base = [(i, p, "B", v) for i in range(4) for p, v in ((-3, ""), (-2, "s"), (-1, "en"), (0, "a"))]
    units = base + [(0, -3, "L", None), (1, -3, "L", None), (1, 0, "R", "b"), (2, -3, "L", None), (2, -3, "R", None), (3, 1, "L", "x"), (3, 1, "R", "y")]
    added = [(9, "L", "t", "en", "s"), (9, "R", "t", "en", "s"), (8, "L", "t", "en", "s"), (8, "R", "u", "en", "s"), (3, "L", "t", "", "")]
    found = merging.merge(spark.createDataFrame(units, merging.UNIT_SCHEMA), spark.createDataFrame(added, "doc_id long, branch string, text string, lang string, source string"))
    got = {r["doc_id"]: (r["present"], r["text"], *[r[c] for c in merging.COUNTS]) for r in found.collect()}
    assert got == {
        0: (False, None, 1, 0, 0, 0), 1: (True, "a", 0, 0, 1, 0), 2: (False, None, 1, 0, 0, 0), 3: (True, "a", 0, 0, 0, 2), 9: (True, "t", 1, 0, 0, 0), 8: (False, None, 0, 0, 0, 1),
    }
