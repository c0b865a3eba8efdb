"""Registered queries against their SQL, and plan shape."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canon

#: All that have SQL; those of the training-data operators are tested beside them.
CHECKED = sorted(name for name in entry.oracle_sql() if not re.match(r"op\d+_|pipeline$", name))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, duck, name):
    mine = entry.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canon(mine) == canon(theirs)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["t7_redact", "r10_score_v2", "p4_parse_webhooks", "g2_running_balance", "u2_fold_charges"])
def test_no_python_in_plan(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["m7_match_pairs", "c1_match_score"])
def test_words_of_documents_stay_in_place(spark, sf_dir, name):
    """The words near a requirement go to the documents' words, which are many, and often the same."""
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan
