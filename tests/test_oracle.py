"""Every registered query against its SQL on the same tables."""

import math

import pytest
from support import SMALL, duck

import __spark_entry__ as contract
from lapsewise.operators import ranking

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def compare(spark, con, name):
    got = QUERIES[name](spark, SMALL)
    want = con.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    a = sorted(tuple(canonical(r[c]) for c in cols) for r in got.collect())
    b = sorted(tuple(canonical(r[i]) for i in order) for r in want.fetchall())
    assert a == b
    assert a or name == "d4_fk_check"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    compare(spark, con, name)


@pytest.mark.parametrize(
    "name",
    ["a4_concentration", "f9_peer", "f11_impute", "f12_winsorize", "r5_risk_rank", "g5_profile",
     "g6_migration", "c5_budget", "m6_auc_by_region", "m8_lift"],
)
def test_matches_sql_without_single_task_windows(spark, con, name, monkeypatch):
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 0)
    compare(spark, con, name)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_segments(spark):
    sizes = QUERIES["g2_rule_segment"](spark, "/root/testdata/sf0.01").collect()
    assert {r["segment"]: r["customers"] for r in sizes} == {
        "at_risk": 169, "champions": 306, "hibernating": 316, "new": 169, "regular": 538,
    }
    assert contract.entry(spark).count() == 150
