"""Queries that do the whole job where an older one, bound to its SQL, reads a part."""

import re

import numpy as np
import pytest

from quillon.plans import queries


def test_token_split_reads_whole_texts(spark, tmp_path):
    texts = [
        ("en", "a b the " + "word " * 300 + "the end of it"),
        ("de", "ein the Wort\nund  noch eins"),
        ("fr", "sans"),
        ("en", "x " * 1000 + "the " + "yy " * 2000),
        ("es", "x " * 3000 + "the y"),
        ("en", "ends with the"),
    ]
    spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n"], r["comp_start"], r["n_completion"], r["mask_sum"]) for r in queries.QUERIES["q58_token_split_whole"](spark, str(tmp_path)).collect()}
    for k, (_, text) in enumerate(texts):
        ids = [7 if w == "the" else len(w) + 100 for w in re.split("[ \n]+", text)]
        start = max((i + 1 for i, x in enumerate(ids) if x == 7), default=None)
        fits = start is not None and (len(ids) <= 2048 or start < 2048)  # a header at the end leaves an empty completion
        rest = ids[start:2048] if fits else []
        assert got[k] == ((len(ids), start, len(rest), sum(rest) - 100 * start) if fits else (len(ids), None, None, None))


def test_covariance_of_all_coordinates(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(90, 64))
    spark.createDataFrame([(k, k % 3, v) for k, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["i"], r["j"]): r["cov"] for r in queries.QUERIES["q59_covariance_whole"](spark, str(tmp_path)).collect()}
    want = np.cov((x * (1 + np.arange(90) * 37 % 100 / 10)[:, None]).T)
    assert len(got) == 64 * 65 // 2
    assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-6) for i in range(64) for j in range(i, 64))
