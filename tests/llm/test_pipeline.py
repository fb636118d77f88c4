from collections import Counter

from pyspark.sql.functions import lit

import corpus_pipeline as pipeline
from tests.llm.fixtures import empty, table
from tests.llm.test_linededup import brute as lines_brute
from tests.llm.test_minhash import brute as classes_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    columns = docs.columns
    results = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    good, lines, near, mixed, packed = results
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert kept and all(labels.get(i) != 0 for i in kept)
    gone = lines_brute([tuple(r) for r in good])
    want = {r["doc_id"]: "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone.get(r["doc_id"], ())) for r in good}
    assert {r["doc_id"]: r["text"] for r in lines} == {i: t for i, t in want.items() if t.strip()}
    assert sorted(r["doc_id"] for r in near) == [i for i, _, k in classes_brute([tuple(r) for r in lines]) if k]
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)
    assert all(r["length"] == len(r["ids"]) and r["ids"] != [0] for r in packed)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty, blank and long texts, repeated rows, clashing columns; and a table without rows."""
    for k, df in enumerate((table(spark), empty(spark))):
        docs, columns = df, df.columns
        for name, stage in pipeline.STAGES:
            path = str(tmp_path / f"{name}-{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "packing":
                assert docs.columns == columns
            if name == "line_dedup" and not k:
                texts = {r["doc_id"]: r["text"] for r in docs.collect()}
                assert 0 in texts and not {1, 50} & set(texts)  # copies lost their last word, and no blank rest stays
        assert (docs.count() > 0) == (k == 0)


def test_stages_keep_columns_with_dots(spark, tmp_path):
    docs = table(spark).withColumn("a.b", lit(1)).withColumn("c d.e", lit("x"))
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
    assert docs.count() > 0
