"""Driver contract and a fast oracle check at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF0001
from kestrel.sources.tables import TABLES


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "product_id_label" in df.columns


def test_oracles_are_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


FAST = ["star_orders", "prior_customer_history", "price_percentile", "audit_chain", "audit_verify",
        "run_history", "scorecard_overall", "column_profile", "stratified_split", "return_auc"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle_at_sf0001(spark, name):
    from tools.check_oracle import rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df = entry.queries()[name](spark, SF0001)
    res = con.execute(entry.oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(o_cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(o_cols, res.fetchall())
