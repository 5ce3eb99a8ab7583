"""Queries with SQL against DuckDB over the smallest tables; the others must run."""

import os

import pytest

from loomstone.plans.engine import CATALOGUE

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"context_decision", "index_totals", "list_paths", "path_lookup", "archive_verify", "rt_container", "rt_container_encrypted"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def norm(rows):
    f = lambda v: "~" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)
    return sorted(tuple(map(f, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in CATALOGUE.queries if n not in SLOW])
def test_query(spark, duck, name):
    df = CATALOGUE.queries[name](spark, SF)
    cols = sorted(df.columns)
    got = norm(map(tuple, df.select(*cols).collect()))
    assert got
    if name in CATALOGUE.sql:
        rel = duck.sql(CATALOGUE.sql[name])
        assert sorted(rel.columns) == cols
        assert got == norm(duck.sql(f"SELECT {', '.join(cols)} FROM ({CATALOGUE.sql[name]})").fetchall())
