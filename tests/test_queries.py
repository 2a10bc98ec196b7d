"""Registered queries against their SQL on the smallest driver tables, where present."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tools.check import TABLES, compare  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables absent")

NAMES = ["t3_stream_signals", "t3_stream_signals_backlog", "o9_reinsert_rename", "g2_sma_rsi_reversal",
         "a1_resample_45m", "a2_resample_for_strategies", "w5_rsi_wilder", "w8_hot_mask", "g1_sma_cross",
         "g3_runners_swing", "b4_pair_trades", "o2_order_intents", "o4_apply_fills", "o9_apply_registry_changes",
         "s2_read_series_values", "t4_late_rows"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    out = entry(spark)
    assert out.count() > 0 and "signal" in out.columns


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result = compare(spark, con, name, queries()[name], oracle_sql()[name], SF_DIR)
    assert result.startswith("ok") and "TYPES" not in result, result
