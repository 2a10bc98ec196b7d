"""Golden cases and edge frames of candles, filters, checks, orders and readers."""

import json
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import by_series, random_bars, to_spark
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions.rounding import round_array_style, round_exact, round_price
from tickloom.operators import backtest as bt
from tickloom.operators import orders as od
from tickloom.operators import quality as q
from tickloom.operators import resample as rs
from tickloom.operators import strategies as st
from tickloom.operators.indicators import daily_percent_change, true_range
from tickloom.sources import payloads, store


def minutes(n, start="2025-10-27 09:30", symbol="test"):
    i = np.arange(n, dtype=float)
    return pd.DataFrame({"symbol": symbol, "ts": pd.date_range(start, periods=n, freq="min"), "open": i,
                         "high": i + 1, "low": i, "close": i + 1, "volume": 100.0})


# ---- candles ----

def test_five_minute_candles(spark):
    out = by_series(rs.resample_ohlcv(to_spark(spark, minutes(10)), 5))["test"]
    assert len(out) == 2
    assert out.loc[0, ["open", "high", "low", "close", "volume"]].tolist() == [0, 5, 0, 5, 500]


def test_too_few_rows_give_an_empty_frame_with_the_schema(spark):
    for df in (to_spark(spark, minutes(3)), to_spark(spark, minutes(3)).limit(0)):
        for width in (5, 7):
            out = rs.resample_ohlcv(df, width)
            assert out.count() == 0 and out.columns == schema.BAR_COLUMNS


def test_bad_widths_and_columns(spark):
    df = to_spark(spark, minutes(3))
    for width, error in ((0, ValueError), (-5, ValueError), (2.5, TypeError), (True, TypeError)):
        with pytest.raises(error):
            rs.resample_ohlcv(df, width)
    with pytest.raises(ValueError, match="volume"):
        rs.resample_ohlcv(df.drop("volume"), 5)


def test_first_and_last_skip_nulls_and_dead_bins_drop(spark):
    pdf = minutes(10)
    pdf.loc[0, "open"] = np.nan
    pdf.loc[4, "close"] = np.nan
    pdf.loc[5:9, "high"] = np.nan
    pdf.loc[0:4, "volume"] = np.nan
    out = by_series(rs.resample_ohlcv(to_spark(spark, pdf), 5))["test"]
    assert len(out) == 1
    assert out.loc[0, ["open", "close", "volume"]].tolist() == [1, 4, 0]


def test_partial_bin_is_kept_unless_complete_only(spark):
    df = to_spark(spark, minutes(12))
    assert rs.resample_ohlcv(df, 5).count() == 3
    assert rs.resample_ohlcv(df, 5, complete_only=True).count() == 2


@pytest.mark.parametrize("width", [5, 7, 45, 90, 240, 390])
def test_grid_over_dst_matches_pandas(spark, width):
    pdf = minutes(4500, "2025-03-07 14:30")  # 09:30 on the Friday before the change
    pdf = pdf[np.random.default_rng(width).random(len(pdf)) < 0.6]
    local = pdf.set_index(pdf["ts"].dt.tz_localize("UTC").dt.tz_convert("America/New_York"))
    want = local["close"].resample(f"{width}min").last().dropna()
    got = by_series(rs.resample_ohlcv(to_spark(spark, pdf), width))["test"]
    assert got["ts"].tolist() == want.index.tz_convert("UTC").tz_localize(None).tolist()
    assert got["close"].tolist() == want.tolist()


@pytest.mark.parametrize("as_of", [None, "2025-03-07 18:07:23"])
@pytest.mark.parametrize("live_from", [None, "2025-03-07 14:41:30"])
@pytest.mark.parametrize("session_live", [True, False])
def test_shared_cells_equal_each_settings_own_rows(spark, as_of, live_from, session_live):
    """Candles from the cells of a symbol against candles of the rows that every setting sees, between odd borders."""
    pdf = random_bars({"AAA": 1500, "BBB": 40}, seed=5, nulls=0.05, gap_minutes=4)
    pdf["ts"] += pd.to_timedelta(np.random.default_rng(6).integers(0, 60, len(pdf)), unit="s")
    pdf = pdf.drop_duplicates(["symbol", "ts"])
    bars = to_spark(spark, pdf)
    frames = [5, 7, 45, 90, 240, 1, 15, 60]
    reg = spark.createDataFrame(
        [(i, "sma_cross", frame, symbol, "market", 1 + i % 3, i % 2, 1, None, None)
         for i, (symbol, frame) in enumerate([(s, f) for f in frames for s in ("aaa", "bbb")] + [("aaa", 7), ("aaa", 45)])], schema.STRATEGIES)
    out = by_series(rs.resample_for_strategies(bars, reg, as_of, live_from, session_live), ("strategy_id", "symbol"))
    seen = rs.strategy_bars(bars, reg, as_of, live_from, session_live).persist()
    names = q.active_strategies(reg).select(F.col("id").alias("strategy_id"), *rs.SPEC)
    rows, want = seen.join(names, rs.SPEC), {}
    for frame in frames:
        own = rows.filter(F.col("time_frame") == frame).select("strategy_id", *schema.BAR_COLUMNS)
        want.update(by_series(own if frame == 1 else rs.resample_ohlcv(own, frame), ("strategy_id", "symbol")))
    assert want.keys() == out.keys() and len(out) > 8
    for key, expected in want.items():
        pd.testing.assert_frame_equal(out[key][schema.BAR_COLUMNS], expected[schema.BAR_COLUMNS])
    seen.unpersist()


def test_candles_read_their_bars_once(spark, tmp_path):
    to_spark(spark, random_bars({"AAA": 500, "BBB": 3})).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    reg = spark.createDataFrame([(i, "sma_cross", f, "aaa", "market", 3, 1, 1, None, None) for i, f in enumerate((5, 7, 45))], schema.STRATEGIES)
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    for minutes in (5, 7, 45, 240):
        assert scans(rs.resample_ohlcv(bars, minutes)) == 1
        assert {r.symbol for r in rs.resample_ohlcv(bars, minutes).collect()} == {"AAA"}
    assert rs.resample_for_strategies(bars, reg).select("strategy_id").distinct().count() == 3


def test_strategy_candles(spark):
    bars = to_spark(spark, random_bars({"AAA": 900, "BBB": 300}, seed=3))
    row = lambda i, symbol, frame, days, extended, active=1: (
        i, "sma_cross", frame, symbol, "market", days, extended, active, None, None)
    reg = spark.createDataFrame([row(1, "aaa", 5, 10, 1), row(2, "AAA", 7, 10, 1), row(3, "aaa", 1, 1, 1),
                                 row(4, "bbb", 15, 10, 0), row(5, "aaa", 5, 10, 1, 0), row(6, "aaa", 5, 10, 1)],
                                schema.STRATEGIES)
    as_of = "2025-03-07 18:00:00"
    out = by_series(rs.resample_for_strategies(bars, reg, as_of), ("strategy_id", "symbol"))
    cut = bars.filter(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    five = by_series(rs.resample_ohlcv(cut.filter("symbol = 'AAA'"), 5))["AAA"]
    seven = by_series(rs.resample_ohlcv(cut.filter("symbol = 'AAA'"), 7))["AAA"]
    rth = by_series(rs.resample_ohlcv(q.session_filter(cut.filter("symbol = 'BBB'")), 15))["BBB"]
    raw = by_series(q.lookback(cut.filter("symbol = 'AAA'"), as_of, 1))["AAA"]
    assert sorted(k[0] for k in out) == [1, 2, 3, 4, 6]
    for key, want in (((1, "AAA"), five), ((6, "AAA"), five), ((2, "AAA"), seven), ((4, "BBB"), rth), ((3, "AAA"), raw)):
        pd.testing.assert_frame_equal(out[key][schema.BAR_COLUMNS], want[schema.BAR_COLUMNS])


# ---- indicators on edge frames ----

def test_first_true_range_is_the_bar_range(spark):
    out = by_series(true_range(to_spark(spark, minutes(2))))["test"]
    assert out["true_range"].tolist() == [1.0, 1.0]


def test_monday_compares_to_friday(spark):
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.to_datetime(
        ["2025-03-06 15:00", "2025-03-07 15:00", "2025-03-07 19:00", "2025-03-10 15:00"]),
        "close": [100.0, 104.0, 110.0, 99.0]})
    df = to_spark(spark, pdf)
    now = by_series(daily_percent_change(df))["A"]["daily_pct"]
    np.testing.assert_allclose(now, [np.nan, 10, 10, -10])
    before = by_series(daily_percent_change(df, causal=True))["A"]["daily_pct"]
    np.testing.assert_allclose(before, [np.nan, np.nan, np.nan, 10])


# ---- filters and checks ----

def test_session_ends_are_inclusive(spark):
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.to_datetime(
        ["2025-03-07 14:29", "2025-03-07 14:30", "2025-03-07 21:00", "2025-03-07 21:01", "2025-03-10 13:30"])})
    kept = q.session_filter(to_spark(spark, pdf)).toPandas()["ts"].sort_values().astype(str).tolist()
    assert kept == ["2025-03-07 14:30:00", "2025-03-07 21:00:00", "2025-03-10 13:30:00"]


def test_duplicate_bars(spark):
    pdf = pd.concat([minutes(3).assign(arrived=1), minutes(2).assign(arrived=2, close=50.0)])
    out = by_series(q.dedupe_bars(to_spark(spark, pdf), "arrived"))["test"]
    assert out["close"].tolist() == [50.0, 50.0, 3.0]


def test_coerce_and_report(spark):
    df = spark.createDataFrame([("A", "1.5"), ("A", "x"), ("A", "NaN"), ("B", None)], "symbol string, close string")
    clean = q.coerce_numeric(df, ["close"])
    assert [r[0] for r in clean.select("close").collect()] == [1.5, None, None, None]
    report = {r["symbol"]: (r["nulls"], round(r["null_pct"], 2)) for r in q.quality_report(clean, ["close"]).collect()}
    assert report == {"A": (2, 66.67), "B": (1, 100.0)}
    with pytest.raises(ValueError, match="volume"):
        q.coerce_numeric(df, ["volume"])


def test_signal_contract(spark):
    df = spark.createDataFrame([("A", "BUY", 1.0), ("A", "hold", None), ("B", None, 0.0)],
                               "symbol string, signal string, quantity double")
    rows = {r["symbol"]: (r["bad_signals"], r["null_quantities"]) for r in q.validate_signals(df).collect()}
    assert rows == {"A": (1, 1), "B": (0, 0)}
    with pytest.raises(TypeError):
        q.validate_signals(df.withColumn("quantity", F.lit("1")))
    with pytest.raises(ValueError):
        q.validate_signals(df.drop("quantity"))


def test_strategy_constraints(spark):
    rows = [(1, "a", 5, "SPY", None, None, None, None, None, None), (2, None, 5, "SPY", "STOP", 11, 2, 1, None, None)]
    checked = q.check_constraints(spark.createDataFrame(rows, schema.STRATEGIES), "day_trading_strategies",
                                  now="2025-01-01 00:00:00")
    good, = q.valid_rows(checked).collect()
    assert (good["order_type"], good["lookback_days"], good["extended_hours"], good["active"]) == ("MARKET", 3, 1, 1)
    assert good["created_at"] == datetime(2025, 1, 1)
    bad, = q.rejected_rows(checked).collect()
    assert set(bad["reasons"]) == {"name is null", "order_type not allowed", "lookback_days out of range",
                                   "extended_hours not 0/1"}


# ---- signals and summaries ----

def test_cross_quantities(spark):
    pdf = minutes(6).assign(close=[10.0, 9, 8, 12, 12, 5])
    out = by_series(st.sma_cross(to_spark(spark, pdf), length=3, position_size=100))["test"]
    assert out["signal"].tolist()[3] == "BUY" and out["signal"].tolist()[5] == "SELL"
    assert out["quantity"].tolist() == [0, 0, 0, 100 / 12, 0, 20.0]
    whole = by_series(st.sma_cross(to_spark(spark, pdf), length=3, position_size=100, whole_shares=True))["test"]
    assert whole["quantity"].tolist() == [0, 0, 0, 8.0, 0, 20.0]


def test_summary_of_one_trade_and_of_winners_only(spark):
    trades = spark.createDataFrame(
        [("ONE", 5.0, 2.0, 250.0), ("WIN", 5.0, 1.0, 100.0), ("WIN", 7.0, 3.0, 300.0), ("LOSE", -1.0, 0.0, 10.0)],
        "symbol string, profit double, profit_pct double, total_cost double")
    s = {r["symbol"]: r for r in bt.performance_summary(trades).collect()}
    assert s["ONE"]["std_pct"] is None and s["ONE"]["return_risk_ratio"] == 0
    assert s["WIN"]["win_loss_ratio"] == float("inf") and s["WIN"]["total_return_pct"] == 4
    assert s["WIN"]["return_risk_ratio"] == round(2 / np.std([1, 3], ddof=1), 2)
    assert (s["LOSE"]["losing_trades"], s["LOSE"]["win_rate_pct"], s["LOSE"]["avg_win_pct"]) == (1, 0, 0)


def test_status_without_signal_column(spark):
    status = bt.analysis_status(to_spark(spark, minutes(2))).collect()
    assert [r["status"] for r in status] == ["no data or signal column missing"]


# ---- rounding and orders ----

TIES = [0.0, 0.00004, 0.00005, 0.99995, 1.005, 2.675, 0.125, 2.5, 1e-9, 123456.785, 0.12345, 1.0049999999, 99.995]


def test_rounding_is_exact_on_ties(spark):
    df = spark.createDataFrame([(v,) for v in TIES], "v double")
    got = df.select("v", round_exact(F.col("v"), 2).alias("two"), round_exact(F.col("v"), 4).alias("four"),
                    round_exact(-F.col("v"), 2).alias("minus"), round_price(F.col("v")).alias("price"),
                    round_array_style(F.col("v")).alias("array")).collect()
    for r in got:
        assert r["two"] == round(r["v"], 2) and r["four"] == round(r["v"], 4) and r["minus"] == -round(r["v"], 2)
        assert r["price"] == round(r["v"], 4 if r["v"] < 1 else 2)
        assert r["array"] == np.round(r["v"], 2)


@settings(max_examples=3, deadline=None)
@given(hs.lists(hs.integers(-10**9, 10**9), min_size=200, max_size=400))
def test_rounding_matches_python(spark, whole):
    values = [w / 1000 for w in whole] + [w / 100000 for w in whole]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", round_exact(F.col("v"), 2).alias("r")).collect()
    assert all(r["r"] == round(r["v"], 2) for r in got)


def registry(spark, *rows):
    return spark.createDataFrame(
        [(i, "sma_cross", frame, "spy", kind, 3, 1, 1, None, None) for i, frame, kind in rows], schema.STRATEGIES)


def test_order_rows(spark):
    strategies = registry(spark, (1, 5, "MARKET"), (2, 15, "limit"))
    signals = spark.createDataFrame(
        [(1, "spy", "BUY", 2.5, 10.0), (2, "spy", "buy", 1.0, 0.00004), (2, "spy", "SELL", 3.0, 20.125),
         (2, "", "BUY", 0.0, 5.0), (2, "spy", "HOLD", 1.0, 5.5)],
        "strategy_id bigint, symbol string, signal string, quantity double, close double")
    rows = od.order_intents(signals, strategies, as_of="2025-01-02 10:00:00.123456").collect()
    place = {("SPY", 2.5): 0, ("SPY", 3.0): 2, ("", 0.0): 3}
    out = sorted(rows, key=lambda r: place.get((r["symbol"], r["quantity"]), 1 if r["instruction"] == "BUY" else 4))
    body = [json.loads(r["body"]) for r in out]
    market, tiny, sell, bad, hold = out
    assert market["order_type"] == "MARKET" and "price" not in body[0]
    assert body[0]["cancelTime"] == "2025-01-02T10:05:00.123Z"
    assert body[0]["orderLegCollection"] == [
        {"instruction": "BUY", "quantity": 2.5, "instrument": {"symbol": "SPY", "assetType": "EQUITY"}}]
    assert tiny["order_type"] == "MARKET" and tiny["price"] == 0
    assert (sell["price"], sell["expiry_minutes"], body[2]["price"]) == (20.12, 1440, "20.12")
    assert bad["reasons"] == ["symbol missing", "quantity not positive"]
    assert hold["reasons"] == ["instruction not allowed"] and body[4]["price"] == "5.5"


@pytest.mark.parametrize("frame,fire,expected", [
    (5, "minute", ["10:04"]), (7, "minute", ["10:06"]), (7, "bucket", ["10:06"]), (60, "minute", ["10:59"]),
    (90, "minute", []), (90, "bucket", ["11:29"]), (1, "minute", ["10:00"])])
def test_firing_rule(spark, frame, fire, expected):
    bars = to_spark(spark, minutes(120, "2025-01-02 10:00", "SPY"))
    candle = spark.createDataFrame([(1, "SPY", datetime(2025, 1, 2, 10, 0), 5.0, "BUY", 1.0)],
                                   "strategy_id bigint, symbol string, ts timestamp, close double, signal string, quantity double")
    out = od.signals_to_act_on(candle, bars, registry(spark, (1, frame, "MARKET")), fire).collect()
    assert [r["fired_at"].strftime("%H:%M") for r in out] == expected


def test_seven_minute_candle_fires_by_the_hour(spark):
    # The candle 11:03-11:09 ends between two firing minutes; 11:06 lies inside it.
    bars = to_spark(spark, minutes(120, "2025-01-02 10:00", "SPY"))
    candle = spark.createDataFrame([(1, "SPY", datetime(2025, 1, 2, 11, 3), 5.0, "BUY", 1.0)],
                                   "strategy_id bigint, symbol string, ts timestamp, close double, signal string, quantity double")
    out = od.signals_to_act_on(candle, bars, registry(spark, (1, 7, "MARKET"))).collect()
    assert [r["fired_at"].strftime("%H:%M") for r in out] == ["11:06"]


def test_sells_and_fills(spark):
    at = lambda h: datetime(2025, 1, 2, h)
    positions = spark.createDataFrame([(1, 1, "a", 2.0, 5.0, at(1)), (2, 1, "b", 2.0, 5.0, at(1)), (3, 1, "c", 1.0, 5.0, at(1)),
                                       (4, 1, "d", 1.0, 5.0, at(1)), (5, 2, "e", 1.0, 5.0, at(1))], schema.POSITIONS)
    status = spark.createDataFrame([("a", "FILLED", 2.0, at(1)), ("b", "FILLED", 0.0, at(1)), ("c", "WORKING", 0.0, at(1))],
                                   schema.ORDER_STATUS)
    sells = spark.createDataFrame([(1, "SPY", 7.0, at(4)), (1, "SPY", 6.0, at(3))],
                                  "strategy_id bigint, symbol string, price double, decided_at timestamp")
    plan = {r["order_id"]: (r["action"], r["quantity"], r["price"]) for r in
            od.reconcile_sells(sells, positions, status).collect()}
    assert plan == {"a": ("SELL", 2.0, 6.0), "b": ("NONE", None, None), "c": ("CANCEL", None, None),
                    "d": ("SKIP", None, None)}
    buys = spark.createDataFrame([(1, "old", 1.0, 9.0, at(2)), (1, "new", 1.0, 9.005, at(5)), (3, "x", 1.0, 0.5, at(1))],
                                 "strategy_id bigint, order_id string, quantity double, price double, decided_at timestamp")
    after = {r["order_id"]: r["entry_price"] for r in od.apply_fills(positions, buys, sells).collect()}
    assert after == {"e": 5.0, "new": round(9.005, 2), "x": 0.5}


# ---- readers ----

def write(path, *docs):
    path.mkdir()
    for i, doc in enumerate(docs):
        (path / f"spy.{i}.json").write_text(json.dumps(doc) + "\n")
    return str(path)


def candle(ms, **more):
    return {"datetime": ms, "open": "1.5", "high": 2, "low": "bad", "close": 1.75, "volume": 10, **more}


def test_history_payloads(spark, tmp_path):
    ok = write(tmp_path / "ok", {"candles": [candle(1735812000000)]}, {"symbol": "qqq", "candles": []})
    row, = payloads.read_history_candles(spark, ok).collect()
    assert (row["symbol"], row["ts"], row["open"], row["low"]) == ("SPY", datetime(2025, 1, 2, 10), 1.5, None)
    assert payloads.read_history_candles(spark, ok).columns == schema.BAR_COLUMNS
    broken = write(tmp_path / "broken", {"symbol": "A"}, {"candles": [candle(0)]})
    with pytest.raises(Exception, match="no candles"):
        payloads.read_history_candles(spark, broken).collect()
    assert payloads.read_history_candles(spark, broken, on_error="skip").count() == 1


def test_series_payloads(spark, tmp_path):
    value = {"datetime": "2025-03-10 09:30:00", "open": "1", "high": "2", "low": "1", "close": "2", "volume": "5"}
    late = {**value, "datetime": "2025-03-10 16:01:00"}
    path = write(tmp_path / "ok", {"status": "ok", "meta": {"symbol": "spy"}, "values": [value, late]})
    row, = payloads.read_series_values(spark, path).collect()
    assert (row["symbol"], row["ts"]) == ("SPY", datetime(2025, 3, 10, 13, 30))
    assert payloads.read_series_values(spark, path, extended_hours=True).count() == 2
    failed = write(tmp_path / "failed", {"status": "error", "message": "limit reached"})
    with pytest.raises(Exception, match="limit reached"):
        payloads.read_series_values(spark, failed).collect()


def test_aggregate_payloads(spark, tmp_path):
    full = {"t": 1735812000000, "o": 1, "h": 2, "l": 1, "c": 2, "v": 3}
    path = write(tmp_path / "ok", {"status": "OK", "ticker": "spy", "results": [full, {**full, "v": None}]})
    assert payloads.read_agg_results(spark, path).count() == 1
    failed = write(tmp_path / "failed", {"status": "NOT_FOUND"})
    with pytest.raises(Exception, match="NOT_FOUND"):
        payloads.read_agg_results(spark, failed).collect()


def test_csv_append(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "name string, n int")
    path = str(tmp_path / "out")
    store.append_csv(df, path)
    store.append_csv(df, path)
    assert spark.read.option("header", True).csv(path).count() == 2
    with pytest.raises(ValueError):
        store.append_csv(df.limit(0), path)


def test_bar_store(spark, tmp_path):
    path = str(tmp_path / "bars")
    store.write_bars(to_spark(spark, random_bars({"A": 600})), path, by_symbol=True)
    assert store.read_bars(spark, path).count() == 600
    days = store.read_bars(spark, path, "2025-03-06", "2025-03-06")
    assert 0 < days.count() < 600
    assert "PartitionFilters: [isnotnull(day" in days._jdf.queryExecution().toString()


def test_live_bars_can_skip_the_session_filter(spark):
    bars = to_spark(spark, minutes(4, "2025-01-02 21:58", "SPY"))  # 16:58 to 17:01 market time
    early = to_spark(spark, minutes(2, "2025-01-02 20:00", "SPY"))
    reg = spark.createDataFrame([(1, "sma_cross", 1, "spy", "MARKET", 3, 0, 1, None, None)], schema.STRATEGIES)
    count = lambda **more: rs.resample_for_strategies(
        bars.unionByName(early), reg, live_from="2025-01-02 21:59:00", **more).count()
    assert count() == 2
    assert count(session_live=False) == 5


def test_rounding_beyond_a_hundred_billion(spark):
    from tickloom.functions.rounding import round_exact
    values = [123456789012.345, 1e12 + 0.125, 4503599627370497.5, -987654321098.765]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(round_exact(F.col("v"), 2)).collect()] == [round(v, 2) for v in values]


def test_rejected_buys_open_nothing(spark):
    from tickloom.operators.orders import apply_fills
    positions = spark.createDataFrame([], "id bigint, strategy_id bigint, order_id string, quantity bigint, entry_price double, opened_at timestamp")
    buys = spark.sql("select * from values (1L, 'a', 2L, 5.0D, timestamp'2025-01-02 10:00:00', cast(array() as array<string>)), "
                     "(2L, 'b', 2L, 5.0D, timestamp'2025-01-02 10:00:00', array('quantity')) as t(strategy_id, order_id, quantity, price, decided_at, reasons)")
    sells = spark.createDataFrame([], "strategy_id bigint, decided_at timestamp")
    assert [r.strategy_id for r in apply_fills(positions, buys, sells).collect()] == [1]


def test_changes_act_in_sequence(spark):
    old = spark.createDataFrame([(i, n, 5, "x", "MARKET", 3, 1, 1, None, None) for i, n in ((1, "a"), (2, "b"), (4, "d"))], schema.STRATEGIES)
    log = spark.createDataFrame([
        (1, "DELETE", 1, None, None, None), (2, "UPDATE", 1, None, None, 9), (3, "INSERT", 1, None, "c", 15),
        (4, "UPDATE", None, "b", "e", None), (5, "UPDATE", None, "b", None, 60), (6, "UPDATE", None, "e", "f", None),
        (7, "UPDATE", None, "f", None, 30), (8, "UPDATE", 3, None, None, 7), (9, "DELETE", None, "d", None, None),
        (10, "UPDATE", None, "d", None, 45)], "seq int, op string, id long, match_name string, name string, time_frame int")
    history = spark.createDataFrame([(1, 2.0), (2, 3.0), (4, 1.0)], "strategy_id long, quantity double")
    after = od.apply_registry_changes(old, log, "2024-02-01 00:00:00", positions=history)
    got = sorted((r.id, r.name, r.time_frame) for r in after.strategies.collect())
    assert got == [(1, "c", 15), (2, "f", 30)]
    assert [r.strategy_id for r in after.positions.collect()] == [2]


def test_look_back_prunes_days(spark, tmp_path):
    path = str(tmp_path / "pruned")
    store.write_bars(to_spark(spark, minutes(3000)), path)
    kept = q.lookback(store.read_bars(spark, path, keep_day=True), "2025-10-29 00:00:00", 1)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert kept.count() == q.lookback(store.read_bars(spark, path), "2025-10-29 00:00:00", 1).count() > 0
