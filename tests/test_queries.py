"""Every registered query next to its SQL, and the shape of some plans."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from mildtext.plans.oracle import ORACLE_SQL
from mildtext.plans.queries import QUERIES
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    got = queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(oracle_sql()[name]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    rows = queries()[name](spark, SF).toPandas()
    assert len(rows) > 0
    assert not rows.duplicated().any()


def test_all_are_registered():
    assert set(QUERIES) <= set(queries()) and set(ORACLE_SQL) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["delete_exact", "delete_prefix", "toxicity_lexicon", "preprocess_pairs",
                                  "split_pairs", "bigram_perplexity", "preprocess_funnel", "tokenize_pairs"])
def test_native_plans(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_scan_reads_needed_columns(spark):
    plan = queries()["toxicity_lexicon"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan or "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = queries()["load_inputs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(lang, [en,es])" in plan
