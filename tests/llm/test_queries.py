"""The registered queries: columns, and those with SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from docloom.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL

COLUMNS = {
    "p1_found": [("doc_id", "string"), ("line_no", "int")], "p2_found": [("field_name", "string"), ("item_id", "string")], "p3_found": [("doc_id_a", "string"), ("doc_id_b", "string")],
    "p4_found": [("doc_id", "string"), ("start_pos", "int"), ("end_pos", "int")], "p5_found": [("doc_id", "string"), ("field_name", "string"), ("markup", "string")], "p6_found": [("doc_id", "string"), ("line_no", "int")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "string")], "p9_found": [("doc_id", "bigint"), ("kind", "string"), ("start_pos", "int"), ("end_pos", "int")],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.dtypes == COLUMNS.get(name, df.dtypes)
    assert df.count() == df.distinct().count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = QUERIES[name](spark, SMALL)
    theirs = con.execute(ORACLES[name]).df()[df.columns]
    assert sorted(map(tuple, theirs.values)) == sorted(map(tuple, df.collect()))


def test_registered():
    assert QUERIES.keys() <= contract.queries().keys()
