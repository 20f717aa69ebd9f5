"""Queries of this package against their SQL, and that every operator has its query."""

import pytest
from support import SMALL
from test_oracle import canonical

import corpus_pipeline
from lapsewise.llm.queries import ORACLE, QUERIES
from support import duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    got, want = QUERIES[name](spark, SMALL), duck(SMALL).sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    a = sorted(tuple(canonical(r[c]) for c in cols) for r in got.collect())
    b = sorted(tuple(canonical(r[i]) for i in order) for r in want.fetchall())
    assert a and a == b


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
