"""Registered queries of the optional part next to their SQL."""

import duckdb
import pytest

from __spark_entry__ import queries
from mildtext.llm.queries import ORACLE_SQL
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert compare(queries()[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()) == "ok"
