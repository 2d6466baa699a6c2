"""The driver contract, and registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import verify
from eddyline.queries import engine, general, reference

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_contract(spark):
    names = entry.queries().keys()
    assert entry.oracle_sql().keys() <= names
    assert {f"p{n}_found" for n in (1, 2, 4, 5, 7)} <= names
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    verify.register(con, DATA)
    mine = entry.queries()[name](spark, DATA).toPandas()
    assert verify.compare(mine, con.sql(entry.oracle_sql()[name]).df()) == ""


# one row for no rows: these are whole-table aggregates or do not depend on the tables; SQL gives a total of nothing where Spark's ROLLUP and CUBE give no row
ROWS_OF_NOTHING = {"global_aggregate": 1, "watermark_min_of_sources": 1, "monotone_watermark": 3, "validation_rules": 10, "trigger_inference": 6, "sql_questions": 4}


@pytest.mark.parametrize("module", [general, reference, engine], ids=lambda m: m.__name__.rpartition(".")[2])
def test_empty_tables(spark, empty_tables, module):
    found = {name: query(spark, empty_tables).count() for name, query in module.QUERIES.items()}
    assert {name: n for name, n in found.items() if n} == {name: n for name, n in ROWS_OF_NOTHING.items() if name in module.QUERIES}


@pytest.mark.parametrize("name", sorted(n for n in general.ORACLES))
def test_skewed_tables(spark, skewed_tables, name):
    con = duckdb.connect()
    verify.register(con, skewed_tables)
    assert verify.compare(general.QUERIES[name](spark, skewed_tables).toPandas(), con.sql(general.ORACLES[name]).df()) == ""
