"""Every query of these operators that has SQL gives its rows."""

import duckdb
import pytest

from conftest import SF0001
from kestrel.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df = QUERIES[name](spark, SF0001)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want)) and want


def test_chat_sql_counts_escapes(spark, monkeypatch):
    """Control strings, backslashes and odd roles, by SQL and by the operator."""
    from kestrel.llm import chat_format as cf

    rows = [(1, 0, "us|>er", "a\\\\b <s> </s> <<SYS>> <</SYS>> [INST] [/INST] <|x|> [| <| <<s>"), (1, 1, "assistant", "é <|user|> \\"), (1, 1, "assistant", "é <|user|> \\"),
            (2, None, None, None), (2, 3, "assistant", "x"), (2, 4, "user", "[INST"), (3, 0, "<s>|>", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(cf, "read", lambda *a: df)
    got = cf.op9_chat_format(spark, "")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({cf.ORACLE_SQL})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
