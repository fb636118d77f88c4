"""Alignment of two tokenizers beside loops over whole texts encoded at once."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import alignment

from . import fixtures

NAMES = [c.split()[0] for c in alignment.RESULT_SCHEMA.split(", ")]


def tokens(text):
    """(id, first byte, byte after the last) by A and by B, None where they do not spell the text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    if not hasattr(tokens, "a"):
        paths = alignment.default_vocabularies()
        tokens.a, tokens.b = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
        tokens.a.encode_special_tokens = True
        byte = {}
        for b in range(256):  # one byte at a time, by the tokenizer itself
            byte[b] = None
        tokens.alphabet = {}
        spare = 256
        for b in byte:
            visible = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
            tokens.alphabet[chr(b) if visible else chr(spare)] = b
            spare += not visible
        assert ByteLevel().decode(["Ġa"]) == " a"
    meant = (" " + text).encode()
    sides = []
    spelled_a = [(i, bytes(tokens.alphabet[c] for c in tokens.a.id_to_token(i))) for i in tokens.a.encode(" " + text, add_special_tokens=False).ids]
    names_b = [(i, tokens.b.id_to_piece(i)) for i in tokens.b.encode(text)]
    spelled_b = [(i, bytes([int(n[3:5], 16)]) if tokens.b.is_byte(i) else n.replace("▁", " ").encode()) for i, n in names_b]
    for spelled in (spelled_a, spelled_b):
        at, out = 0, []
        for i, part in spelled:
            out.append((i, at, at + len(part)))
            at += len(part)
        if b"".join(p for _, p in spelled) != meant:
            return None
        sides.append(out)
    return sides


def brute(rows):
    parts, holders = [], Counter()
    for doc_id, text in rows:
        both = tokens(text) if text else None
        if both is None:
            parts.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        a, b = both
        links = Counter((x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]) if len(a) * len(b) < 10**6 else swept(a, b)
        holders.update(links.keys())
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        ia = ib = 0
        for high in ends:
            ga, gb = [], []
            while ia < len(a) and a[ia][2] <= high:
                ga.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][2] <= high:
                gb.append(str(b[ib][0]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
            low = high
        assert low == a[-1][2]
        parts.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (x, _), n in holders.items():
        most[x] = max(most.get(x, 0), n)
    return sorted(
        ((i, na, nb, g, sum(k.values()), sum(n for p, n in k.items() if holders[p] == most[p[0]]), sum(n * holders[p] for p, n in k.items()), sha) for i, na, nb, g, k, sha in parts),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1:]),
    )


def swept(a, b):
    out, j = Counter(), 0
    for x in a:
        while b[j][2] <= x[1]:
            j += 1
        k = j
        while k < len(b) and b[k][1] < x[2]:
            out[x[0], b[k][0]] += 1
            k += 1
    return out


def check(df, **options):
    found = alignment.align(df, **options)
    assert found.columns == NAMES
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    assert got == brute([tuple(r) for r in df.select("doc_id", "text").collect()])
    return got


TEXTS = [
    "Hello, world", "  two  spaces ", "tabs\tand\n\nlines \n x", "it's 'tis  's", "naïve café — 東京タワー 😀👩‍👩‍👧 x", "a b 　c", "U+2581 ▁ here", "▁", " ", "\n", "\x00 \x7f \x1c x",
    "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 3000, " ".join(["ab"] * 2000), "é ﬁ Ｆ", "don't  do\tit", "12345 67,890.12", "  para  ", "ends with space ", "a,b.c;d>e>f 's't it's. (x) [y]{z} a-b_c/d\\e x,\n\ny, z . w", "é,x x,é \u3000,a a,\u3000", " starts", "﻿bom",
]


def test_against_loops(spark):
    rows = list(enumerate(TEXTS)) + [(100 + k, fixtures.prose(k, 150)) for k in range(30)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert any(r[1] == 0 for r in got[: len(TEXTS)]) and sum(r[1] > 0 for r in got[: len(TEXTS)]) > 15


def test_odd_tables(spark):
    odd = fixtures.table(spark).withColumnRenamed("bucket", "a.b").withColumnRenamed("key", "chunk")
    least = spark.createDataFrame([(-(2**63), "the least"), (2**63 - 1, "the greatest"), (None, None), (None, "none"), (None, "none")], "doc_id long, text string")
    check(odd.select("doc_id", "text").union(least))
    assert alignment.align(odd).count() == odd.count()
    assert alignment.align(fixtures.empty(spark)).collect() == []


@pytest.mark.parametrize("size", [1, 500])
def test_chunks_do_not_matter(spark, size):
    df = fixtures.table(spark).where(F.length("text") < 3000).repartition(2)
    check(df, chunk_bytes=size)


def test_a_small_cache_changes_nothing(monkeypatch):
    import pyarrow as pa

    paths = alignment.default_vocabularies()
    ids, texts = pa.array(range(40)), pa.array([fixtures.prose(k, 60) for k in range(40)])
    wanted = alignment.Aligner(paths).align(ids, texts)
    monkeypatch.setattr(alignment, "CACHE", 50)
    small = alignment.Aligner(paths)
    small.align(ids, pa.array([fixtures.prose(k + 7, 50) for k in range(40)]))
    got = small.align(ids, texts)
    assert got[0].equals(wanted[0]) and (got[1] == wanted[1]).all() and (got[2] == wanted[2]).all() and got[3] == wanted[3]


def test_frequent_pairs(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words "), (F.col("id") % 7).cast("string")).alias("text")).repartition(40)
    got = check(df)
    assert max(r[6] for r in got) > 3 * 4000
