"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from frameflow import catalog
from tests.oracle import same

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF).toPandas(), ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    rows = {r["clip_no"]: r for r in entry.entry(spark).collect()}
    assert len(rows) == 2
    assert all(r["team_1"] + r["team_2"] + r["no_holder"] + r["unlabelled"] == r["n_frames"] == 500 for r in rows.values())


def test_entry_has_all():
    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
