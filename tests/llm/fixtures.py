"""Small tables with the cases every operator must stand: nulls, empty and long texts, ties, repeats, more columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, size string, key long, shard string, `_id` string, `_kept` int, found string, node string, label string"

#: Values of the columns beyond those of documents.
MORE = ("b", "z", 7, "x", "y", 0, "f", None, "l")


def prose(seed, n):
    r = random.Random(seed)
    syllables = ["an", "the", "or", "ti", "és", "on", "er", "wh", "ing", "ß", "日", "x"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
    out = []
    for w in words:
        out.append(w + r.choice(["", "", "", ".", ",", "!!"]))
        out.append(r.choice([" ", " ", " ", " ", "\n", "\n\n", "\t"]))
    return "".join(out)


def rows():
    out = []

    def add(doc_id, text, source="s1", lang="en"):
        out.append((doc_id, text, lang, source, len(text or ""), *MORE))

    base = prose(1, 200)
    add(0, base)
    add(1, base, "s2")  # an exact copy
    add(2, base.replace("the", "than", 1), None)
    for k in range(3, 25):
        add(k, prose(k, 5 * k), f"s{k % 4}", ["en", "fr", None][k % 3])
    add(25, None, None, None)
    add(26, "")
    add(27, " \n \t")
    add(28, prose(28, 6000), "long")  # longer than a sequence
    add(29, "a", "one")
    add(30, prose(31, 30) + base[:400] + prose(32, 30), "s3")
    add(31, "😀 é́ <|endoftext|> \x00 ﻿", "\U0001f600")
    for _ in range(3):
        add(40, "a row that repeats\nwhole", "s1")
    add(None, "no id", "s1")
    add(50, base, "s1")
    return out


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
