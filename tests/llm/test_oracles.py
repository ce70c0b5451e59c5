"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from dayledger.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    clean = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))
    want = clean([tuple(r[names.index(c)] for c in columns) for r in found.fetchall()])
    assert clean([tuple(r) for r in df.select(*columns).collect()]) == want and want
