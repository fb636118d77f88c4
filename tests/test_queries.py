"""Every reference query against its SQL on the small tables."""

import duckdb
import pytest

from quillon.plans import oracles, queries
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_rows(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    con.execute(oracles.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in con.description], con.fetchall())


def test_every_oracle_has_a_query():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
    assert set(queries.QUERIES) - set(oracles.ORACLES) == {"q39_spherical_kmeans", "q40_k_sweep", "q107_control_weights"}


def test_batches_against_a_loop(spark):
    from quillon.operators.batching import cut

    import numpy as np

    rows = queries.q44_batch_pack(spark, SF).collect()
    by_lang = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        by_lang.setdefault(r["lang"], []).append(r)
    for part in by_lang.values():
        assert [r["batch"] for r in part] == cut(np.array([r["n_chars"] for r in part])).tolist()
