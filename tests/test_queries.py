"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from netframe.plans import layout_queries, netlist_queries, source_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
QUERIES = layout_queries.QUERIES | netlist_queries.QUERIES | source_queries.QUERIES
ORACLES = layout_queries.ORACLES | netlist_queries.ORACLES | source_queries.ORACLES


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return made


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(df.collect(), df.columns) == ordered(found.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
