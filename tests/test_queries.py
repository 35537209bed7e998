from __future__ import annotations

import pytest

from __spark_entry__ import entry
from compare_oracle import connect, differences
from table_values import values
from tablelink.operators.comparing import hard_case_count
from tablelink.operators.scoring import run_accuracy, score_rows
from tablelink.plans.oracle import ORACLE
from tablelink.plans.queries import QUERIES
from tablelink.plans import bindings as b


@pytest.fixture(scope="module")
def connection(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, tiny, connection, name):
    assert differences(QUERIES[name](spark, tiny), connection, ORACLE[name]) == []


def test_entry(spark):
    assert entry(spark).count() == 7


def test_every_sql_has_a_query():
    assert set(ORACLE) == set(QUERIES)


def test_bindings_have_the_documented_size(spark):
    folder = "/root/testdata/sf0.01"
    counts = {
        name: getattr(b, name)(spark, folder).count()
        for name in ("entities", "rows", "cells", "candidates", "meta", "allow", "allow_tables", "runs", "examples")
    }
    assert counts == {
        "entities": 2000, "rows": 2000, "cells": 6000, "candidates": 60000, "meta": 25,
        "allow": 1333, "allow_tables": 760, "runs": 5960, "examples": 233,
    }
    scored = score_rows(b.answered_runs(spark, folder))
    assert values(run_accuracy(scored), "iter", "n", "accuracy") == [
        (0, 2000, 0.769), (1, 2000, 0.7185), (2, 1960, 0.6663265306122449),
    ]
    assert hard_case_count(scored).first()["n_hard"] == 1176
