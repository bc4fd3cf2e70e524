"""Every core query against its SQL."""

import pytest
from compare import same_rows

from tempolith.plans import CORE

ORACLES = CORE.oracle_sql()
#: Queries whose oracle has rows that need more than the smallest tables.
MAY_BE_EMPTY = {"jn_anti", "br_embedding_gate", "gr_path_aggregate", "txt_phrase", "tm_provenance"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    same_rows(CORE.queries()[name](spark, sf_dir), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(CORE.entries) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert CORE.queries()[name](spark, sf_dir).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_inventory_ids_are_known():
    covered = {i for x in CORE.entries.values() for i in x.operators}
    for family in ("SRC", "EXT", "FLT", "JN", "AG", "WN", "SL", "ST", "GR", "TM", "PL", "SIM", "TXT"):
        assert any(i.startswith(family) for i in covered)
