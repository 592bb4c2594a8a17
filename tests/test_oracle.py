"""Registered queries against plain SQL on the small tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "bars_events_hourly", "bars_panel_daily", "resample_weekly", "tail_bars", "macro_asof", "moving_averages", "candles_1",
    "signals_two_mean_events_1", "signals_gaps", "signals_pivot_levels", "top_n_momentum", "psar", "truth_trades_suffix", "trade_ledger",
    "reversal_ledger", "robust_scale", "sliding_windows", "time_folds", "vote_ensemble", "stream_bars",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_registry_is_complete():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 120
    assert set(SAMPLE) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    got = rows_of(entry.queries()[name](spark, SF).toPandas())
    want = rows_of(con.execute(entry.oracle_sql()[name]).df())
    assert got == want
