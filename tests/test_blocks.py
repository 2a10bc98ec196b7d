"""Split series give the same results as whole ones, and as pandas."""

import re

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL, by_series, random_bars, to_spark
from pyspark.sql import functions as F

from tickloom.operators import backtest as bt
from tickloom.operators import indicators as ind
from tickloom.operators import strategies as st
from tickloom.operators.resample import resample_ohlcv
from tickloom.plans.blocks import BlockSize, running_sum, split_blocks

ROWS = {"HOT": 900, "MID": 130, "TINY": 7}


@pytest.fixture(scope="module")
def bars(spark):
    return to_spark(spark, random_bars(ROWS)).cache()


def test_blocks_own_every_row_once_and_have_full_halo(spark, bars):
    halo = 25
    blocks = split_blocks(bars, halo, SMALL)
    assert blocks.split
    pdf = blocks.frame.toPandas()
    own = pdf[pdf["_own"]]
    assert len(own) == sum(ROWS.values())
    assert not own.duplicated(["symbol", "ts"]).any()
    whole = pdf[pdf["symbol"] == "TINY"]
    assert (whole["_block"] == 0).all() and not whole["_split"].any()
    hot = pdf[pdf["symbol"] == "HOT"]
    assert hot["_block"].nunique() > 5
    times = np.sort(hot[hot["_own"]]["ts"].to_numpy())
    for _, block in hot.groupby("_block"):
        start = block[block["_own"]]["ts"].min()
        before = times[times < start][-halo:]
        copies = block[~block["_own"]]["ts"].to_numpy()
        assert set(before) <= set(copies)
        assert len(copies) == len(set(copies))


def test_dense_series_get_shorter_units(bars):
    # Every row of the series lies in one week-long unit.
    blocks = split_blocks(bars, 10, BlockSize(rows=100))
    sizes = blocks.own(blocks.frame).filter("symbol = 'HOT'").groupBy("_block").count().toPandas()["count"]
    assert sizes.sum() == ROWS["HOT"] and len(sizes) >= 6 and sizes.max() <= 150


def test_short_series_are_left_alone(bars):
    blocks = split_blocks(bars, 10, BlockSize())
    assert not blocks.split and blocks.frame is bars


CASES = {
    "sma": lambda df, s: ind.sma(df, 20, size=s),
    "ewm": lambda df, s: ind.ewm(df, "close", 0.5, size=s),
    "atr": lambda df, s: ind.atr_wilder(df, 3, size=s),
    "rsi": lambda df, s: ind.rsi_wilder(df, 3, size=s),
    "rsi_ratio": lambda df, s: ind.rsi_ratio(df, 3, size=s),
    "true_range": lambda df, s: ind.true_range(df, size=s),
    "prev": lambda df, s: ind.prev(df, ["close", "low"], 2, size=s),
    "hot": lambda df, s: ind.hot_mask(df, 0.1, size=s),
    "cross": lambda df, s: st.sma_cross(df, length=10, size=s),
    "reversal": lambda df, s: st.sma_rsi_reversal(df, 5, 12, 3, 55, 60, size=s),
    "swing": lambda df, s: st.runners_swing(df, 0.05, 3, size=s),
}


@pytest.mark.parametrize("name", CASES)
def test_split_equals_whole(bars, name):
    # Halos of the smoothed columns exceed the small limit; the limit then is the halo.
    whole, split = (by_series(CASES[name](bars, s)) for s in (BlockSize(), SMALL))
    assert whole.keys() == split.keys()
    for symbol in whole:
        pd.testing.assert_frame_equal(whole[symbol], split[symbol], rtol=1e-9, atol=1e-9)


def pandas_rsi(close, period):
    change = close.diff()
    gain = change.clip(lower=0).ewm(alpha=1 / period, adjust=False).mean()
    loss = (-change.clip(upper=0)).ewm(alpha=1 / period, adjust=False).mean()
    return gain, loss


@pytest.mark.parametrize("size", [BlockSize(), SMALL], ids=["whole", "split"])
@pytest.mark.parametrize("nulls", [0.0, 0.08], ids=["dense", "gaps"])
def test_indicators_match_pandas(spark, size, nulls):
    source = random_bars({"HOT": 2500, "B": 60}, seed=4, nulls=nulls)
    df = to_spark(spark, source)
    ours = {
        "SMA10": by_series(ind.sma(df, 10, size=size)), "close_ewm": by_series(ind.ewm(df, "close", 0.4, size=size)),
        "ATR": by_series(ind.atr_wilder(df, 4, size=size)), "RSI": by_series(ind.rsi_wilder(df, 4, size=size)),
        "RSI_4": by_series(ind.rsi_ratio(df, 4, size=size))}
    for symbol, g in source.groupby("symbol"):
        g = g.sort_values("ts", ignore_index=True)
        before = g["close"].shift(1)
        tr = pd.concat([g["high"] - g["low"], (g["high"] - before).abs(), (g["low"] - before).abs()], axis=1).max(axis=1)
        gain, loss = pandas_rsi(g["close"], 4)
        ratio = (100 * gain / (gain + loss)).where(g["close"].diff().notna().cumsum() >= 4)
        expected = {
            "SMA10": g["close"].rolling(10).mean(), "close_ewm": g["close"].ewm(alpha=0.4, adjust=False).mean(),
            "ATR": tr.ewm(alpha=0.25, adjust=False).mean(),
            "RSI": 100 - 100 / (1 + gain / loss.replace(0, np.nan)), "RSI_4": ratio}
        for name, values in expected.items():
            np.testing.assert_allclose(
                ours[name][symbol][name].to_numpy(float), values.to_numpy(float), rtol=1e-8, atol=1e-8, err_msg=name)


def test_long_decay_does_not_overflow(spark):
    n = 30_000
    x = np.random.default_rng(0).normal(0, 1, n).cumsum() + 500
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2025-01-01", periods=n, freq="min"), "close": x})
    for size in (BlockSize(), BlockSize(rows=8000, unit_seconds=86_400)):
        got = by_series(ind.ewm(to_spark(spark, pdf), "close", 1 / 14, size=size))["A"]["close_ewm"]
        want = pdf["close"].ewm(alpha=1 / 14, adjust=False).mean()
        np.testing.assert_allclose(got, want, rtol=1e-12)


def test_gap_rows_repeat_and_reweigh(spark):
    x = [np.nan, 1.0, 2.0, np.nan, np.nan, 5.0, 4.0, np.nan]
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2025-01-01", periods=8, freq="min"), "close": x})
    got = by_series(ind.ewm(to_spark(spark, pdf), "close", 0.3))["A"]["close_ewm"]
    np.testing.assert_allclose(got, pdf["close"].ewm(alpha=0.3, adjust=False).mean(), rtol=1e-13)


def test_rsi_without_losses_is_null_and_short_series_too(spark):
    rising = pd.DataFrame({"symbol": "UP", "ts": pd.date_range("2025-01-01", periods=45, freq="min"),
                           "close": np.arange(45.0)})
    short = rising.head(41).assign(symbol="SHORT", close=lambda d: np.sin(d["close"]))
    df = to_spark(spark, pd.concat([rising, short]))
    assert by_series(ind.rsi_wilder(df))["UP"]["RSI"].isna().all()
    assert by_series(ind.rsi_wilder(df))["SHORT"]["RSI"].isna().all()
    assert (by_series(ind.rsi_ratio(df))["UP"]["RSI_14"].dropna() == 100).all()
    with pytest.raises(Exception, match="too short"):
        ind.rsi_wilder(df, strict=True).collect()


def test_running_sum(spark, bars):
    got = by_series(running_sum(bars, "volume", "total", ["symbol"], ["ts"], 6 * 3600))
    for g in got.values():
        np.testing.assert_allclose(g["total"], g["volume"].cumsum())


# ---- path-dependent strategies and trades against row loops ----

def loop_swing(g, threshold, period):
    day = (g["ts"].dt.tz_localize("UTC").dt.tz_convert("America/New_York")).dt.date
    closes = g.groupby(day)["close"].last()
    pct = day.map(100 * (closes.ffill() / closes.ffill().shift(1) - 1))
    before = g["close"].shift(1)
    tr = pd.concat([g["high"] - g["low"], (g["high"] - before).abs(), (g["low"] - before).abs()], axis=1).max(axis=1)
    atr = tr.ewm(alpha=1 / period, adjust=False).mean().shift(1)
    level = before - 2.5 * atr
    hot = (pct > threshold) & (pct.shift(1) > threshold) & (pct.shift(2) > threshold)
    held, out = None, []
    for i in range(len(g)):
        action = None
        if held is None:
            if hot[i] and g["low"][i] > level[i]:
                held, action = g["close"][i], "BUY"
        elif g["low"][i] < level[i] or g["close"][i] < held - 1.5 * atr[i] or pct[i] < -10:
            held, action = None, "SELL"
        out.append(action)
    return out


def loop_reversal(g, short, long, n, low_rsi, high_rsi):
    gain, loss = pandas_rsi(g["close"], n)
    rsi = (100 * gain / (gain + loss)).where(g["close"].diff().notna().cumsum() >= n)
    enter = (rsi < low_rsi) & (g["low"] > g["close"].rolling(short).mean())
    leave = (rsi > high_rsi) | (g["low"] <= g["close"].rolling(long).mean())
    held, out = False, []
    for e, x in zip(enter, leave):
        action = "BUY" if not held and e else "SELL" if held and x else None
        held = held ^ (action is not None)
        out.append(action)
    return out


def same(actions, expected):
    assert [a if isinstance(a, str) else None for a in actions] == expected


@pytest.mark.parametrize("size", [BlockSize(), SMALL], ids=["whole", "split"])
def test_strategies_match_row_loops(spark, size):
    source = random_bars({"HOT": 3000, "B": 300}, seed=11, drift=0.5)
    df = to_spark(spark, source)
    swing = by_series(st.runners_swing(df, 0.05, 2, size=size))
    reversal = by_series(st.sma_rsi_reversal(df, 4, 12, 2, 55, 50, size=size))
    for symbol, g in source.groupby("symbol"):
        g = g.sort_values("ts", ignore_index=True)
        expected = loop_swing(g, 0.05, 2)
        assert symbol != "HOT" or expected.count("BUY") > 20
        same(swing[symbol]["signal"], expected)
        same(reversal[symbol]["signal"], loop_reversal(g, 4, 12, 2, 55, 50))


@pytest.mark.parametrize("size", [BlockSize(), BlockSize(rows=900, unit_seconds=86_400)], ids=["whole", "split"])
def test_opening_bracket_matches_row_loop(spark, size):
    source = random_bars({"HOT": 14000}, seed=21, drift=0.2, gap_minutes=2)
    out = by_series(st.opening_bracket(to_spark(spark, source), pt=1.5, window=("09:30", "15:00"), rsi_jump=4,
                                       notional=3000, size=size))["HOT"]
    held, signals, prices = None, [], []
    for r in out.itertuples():
        price, action = held, None
        if held is None:
            if r.in_buy_window and r.is_bullish and r.meets_volume_req and r.meets_rsi_req:
                held = price = r.close
                action = "BUY"
        elif r.low < held - 0.9 * r.ATR or r.high >= held + 1.5 * r.ATR or r.is_4pm_or_later:
            held, action = None, "SELL"
        signals.append(action)
        prices.append(np.nan if price is None else price)
    assert signals.count("BUY") > 20
    same(out["signal"], signals)
    np.testing.assert_allclose(out["EntryPrice"].to_numpy(float), prices)
    np.testing.assert_allclose(out["HighATR"].to_numpy(float), np.array(prices) + 1.5 * out["ATR"])
    assert (out["quantity"] == out["signal"].notna().astype(float)).all()


def loop_trades(g):
    trades, held = [], []
    for r in g.itertuples():
        if r.signal not in ("BUY", "SELL") or np.isnan(r.close) or not r.quantity > 0:
            continue
        if r.signal == "BUY":
            held.append(r)
        elif held:
            shares, cost = sum(h.quantity for h in held), sum(h.close * h.quantity for h in held)
            if cost == 0:
                continue
            trades.append((held[0].ts, r.ts, cost, shares, r.close, len(held)))
            held = []
    return trades, held


@pytest.mark.parametrize("size", [BlockSize(), SMALL, BlockSize(rows=3, unit_seconds=600)],
                         ids=["whole", "split", "finest"])
def test_trades_match_row_loop(spark, size):
    rng = np.random.default_rng(5)
    source = random_bars({"HOT": 1500, "B": 40, "QUIET": 5}, seed=6)
    source["signal"] = rng.choice(["BUY", "SELL", None], len(source), p=[0.3, 0.3, 0.4])
    source.loc[source["symbol"] == "QUIET", "signal"] = None
    source["quantity"] = rng.choice([1.0, 2.5, 0.0, -1.0], len(source), p=[0.5, 0.3, 0.1, 0.1])
    source.loc[rng.random(len(source)) < 0.25, "close"] = 0.0
    source.loc[rng.random(len(source)) < 0.05, "close"] = np.nan
    df = to_spark(spark, source)
    got = bt.pair_trades(df, decimals=None, size=size).toPandas()
    open_ = bt.open_positions(df, size=size).toPandas().set_index("symbol")
    status = bt.analysis_status(df, size=size).toPandas().set_index("symbol")
    for symbol, g in source.groupby("symbol"):
        trades, held = loop_trades(g.sort_values("ts"))
        ours = got[got["symbol"] == symbol].sort_values("exit_time")
        assert len(ours) == len(trades) == status.loc[symbol, "trades"]
        for o, (entry, exit_, cost, shares, price, buys) in zip(ours.itertuples(), trades):
            assert (o.entry_time, o.exit_time, o.number_of_buys, o.total_shares) == (entry, exit_, buys, int(shares))
            np.testing.assert_allclose([o.total_cost, o.exit_price, o.profit],
                                       [cost, price, shares * price - cost], atol=1e-9)
        assert (open_["open_buys"].get(symbol, 0)) == len(held)
    assert status.loc["QUIET", "status"] == "no signals"


def test_custom_strategy_in_blocks(bars):
    def rolling_cross(pdf):
        mean, before = pdf["close"].rolling(5).mean(), pdf["close"].shift(1)
        up = (before < mean.shift(1)) & (pdf["close"] > mean)
        return pdf[["symbol", "ts", "close"]].assign(signal=up.map({True: "BUY", False: None}))

    schema = "symbol string, ts timestamp, close double, signal string"
    whole = by_series(st.custom_strategy(bars, rolling_cross, schema))
    split = by_series(st.custom_strategy(bars, rolling_cross, schema, look_back=6, size=SMALL))
    for symbol, g in whole.items():
        pd.testing.assert_frame_equal(g, split[symbol])
    with pytest.raises(ValueError, match="look_back"):
        st.custom_strategy(bars, rolling_cross, schema, size=SMALL)


def test_folded_strategy_is_the_same_at_any_block_size(spark, bars):
    def count_up(block, state):
        """Running maximum and row number, which depend on the whole past."""
        state["seen"] += len(block)
        top = block["close"].cummax().clip(lower=state["top"])
        state["top"] = top.iloc[-1]
        return block[["symbol", "ts"]].assign(top=top, n=range(state["seen"] - len(block), state["seen"])), state

    schema = "symbol string, ts timestamp, top double, n long"
    nameless = bars.withColumn("symbol", F.when(F.col("symbol") != "MID", F.col("symbol")))  # a null key is a series
    for rows in (10**6, 100, 7, 1):
        got = st.custom_strategy(nameless, count_up, schema, state={"seen": 0, "top": -np.inf}, size=BlockSize(rows=rows)).toPandas()
        got = got.sort_values("ts")
        for symbol, g in bars.toPandas().groupby("symbol"):
            ours = got[got["symbol"].isna() if symbol == "MID" else got["symbol"] == symbol]
            g = g.sort_values("ts")
            assert ours["n"].tolist() == list(range(len(g)))
            np.testing.assert_array_equal(ours["top"], g["close"].cummax())


def with_gap():
    """Close, high and low missing for a stretch far longer than any look-back here."""
    pdf = random_bars({"HOT": 2600, "B": 50}, seed=6)
    hot = pdf.index[pdf["symbol"] == "HOT"]
    pdf.loc[hot[900:1900], ["close", "high", "low"]] = np.nan
    return pdf


SMOOTHED = {
    "ewm": lambda df, s: ind.ewm(df, "close", 0.5, size=s),
    "atr": lambda df, s: ind.atr_wilder(df, 3, size=s),
    "rsi": lambda df, s: ind.rsi_wilder(df, 3, size=s),
    "rsi_ratio": lambda df, s: ind.rsi_ratio(df, 3, size=s),
    "sma": lambda df, s: ind.sma(df, 20, size=s),
}


@pytest.mark.parametrize("name", SMOOTHED)
def test_long_stretches_of_nulls_do_not_depend_on_blocks(spark, name):
    df = to_spark(spark, with_gap())
    whole, split = (by_series(SMOOTHED[name](df, s)) for s in (BlockSize(), SMALL))
    for symbol in whole:
        pd.testing.assert_frame_equal(whole[symbol], split[symbol], rtol=1e-9, atol=1e-9)


def test_nan_is_null(spark):
    pdf = random_bars({"HOT": 300}, seed=3)
    pdf.loc[[5, 120], "close"] = np.nan
    nan, null = spark.createDataFrame(pdf), to_spark(spark, pdf)
    for add in (lambda df: ind.sma(df, 20), lambda df: ind.ewm(df, "close", 0.5), ind.rsi_ratio):
        a, b = by_series(add(nan))["HOT"], by_series(add(null))["HOT"]
        pd.testing.assert_frame_equal(a, b)
        assert a.iloc[-1, -1] == a.iloc[-1, -1]


def test_alpha_one_is_the_newest_value(spark):
    for nulls in (0.0, 0.1):
        pdf = random_bars({"HOT": 200}, seed=2, nulls=nulls)
        got = by_series(ind.ewm(to_spark(spark, pdf), "close", 1.0))["HOT"]
        pd.testing.assert_series_equal(got["close_ewm"], pdf["close"].ffill(), check_names=False)
        atr = by_series(ind.atr_wilder(to_spark(spark, pdf), 1))["HOT"]
        assert atr["ATR"].notna().mean() > 0.9
        assert set(by_series(ind.rsi_ratio(to_spark(spark, pdf), 1))["HOT"]["RSI_1"].dropna()) <= {0.0, 100.0}


@pytest.mark.parametrize("size", [BlockSize(), BlockSize(rows=600, unit_seconds=6 * 3600)], ids=["whole", "split"])
@pytest.mark.parametrize("nulls", [False, True], ids=["dense", "gaps"])
def test_flat_prices_give_no_signals(spark, size, nulls):
    pdf = random_bars({"HOT": 4000}, seed=5)
    pdf.loc[600:, ["open", "high", "low", "close"]] = 10.1
    if nulls:
        pdf.loc[3, "close"] = np.nan
    out = by_series(ind.sma(to_spark(spark, pdf), 200, size=size))["HOT"]
    assert (out["SMA200"].iloc[900:] == 10.1).all()
    signals = by_series(st.sma_rsi_reversal(to_spark(spark, pdf), entry_rsi=60, exit_rsi=99, size=size))["HOT"]
    assert signals["signal"].iloc[1100:].isna().all()


def plan_text(df):
    return re.sub(r"#\d+L?|\[[^\]]*plan_id[^\]]*\]|LogicalRDD.*|LocalRelation.*", "", df._jdf.queryExecution().optimizedPlan().toString())


def test_a_null_does_not_change_the_plan(spark):
    pdf = random_bars({"HOT": 300, "B": 80}, seed=8)
    holed = pdf.copy()
    holed.loc[3, ["close", "high", "low"]] = np.nan
    for add in (ind.atr_wilder, ind.rsi_wilder, lambda df: ind.ewm(df, "close", 0.1), lambda df: ind.sma(df, 20), st.sma_rsi_reversal, st.opening_bracket):
        assert plan_text(add(to_spark(spark, pdf))) == plan_text(add(to_spark(spark, holed)))


@pytest.mark.parametrize("size", [BlockSize(), SMALL], ids=["whole", "split"])
def test_means_of_different_decay_and_pattern_together(spark, size):
    """Slow and fast means do not share stretches, nor do columns with different nulls; blocks without any value are passed through."""
    pdf = random_bars({"HOT": 2500, "B": 90}, seed=9, nulls=0.3)
    hot = pdf.index[pdf["symbol"] == "HOT"]
    pdf.loc[hot[:200], "close"] = np.nan
    pdf.loc[hot[1000:1700], "high"] = np.nan
    wanted = {"a": ("close", 0.7), "b": ("close", 0.004), "c": ("high", 0.05), "d": ("low", 1.0), "e": ("close", 0.6)}
    df = ind.in_blocks(to_spark(spark, pdf), 1, lambda f, b: ind.add_indicators(f, b, ewm=wanted, rsi_ratio={"r": 5}, sma={"m": ("close", 3)}).drop("_run"),
                       size, ["close", "high", "low"])
    for symbol, got in by_series(df).items():
        g = pdf[pdf["symbol"] == symbol].sort_values("ts", ignore_index=True)
        for name, (c, alpha) in wanted.items():
            want = g[c].ewm(alpha=alpha, adjust=False).mean() if alpha < 1 else g[c].ffill()
            np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(float), rtol=1e-9, err_msg=name)
        gain, loss = pandas_rsi(g["close"], 5)
        ratio = (100 * gain / (gain + loss)).where(g["close"].diff().notna().cumsum() >= 5)
        np.testing.assert_allclose(got["r"].to_numpy(float), ratio.to_numpy(float), rtol=1e-8, atol=1e-8)
        np.testing.assert_allclose(got["m"].to_numpy(float), g["close"].rolling(3).mean().to_numpy(float), rtol=1e-9)
    assert not set(df.columns) - {*pdf.columns, *wanted, "r", "m"}


def test_blocks_hold_no_copies_for_smoothing(spark):
    blocks = split_blocks(to_spark(spark, with_gap()), 2, SMALL, check=["close"])
    copies = blocks.frame.filter("_split and not _own").groupBy("_block").count().toPandas()["count"]
    assert copies.max() <= 60  # a calendar unit's rows at most, whatever the smoothing


def tied_bars(rows: int = 900, seed: int = 21) -> pd.DataFrame:
    """Bars of which many share a time, told apart by their arrival number."""
    pdf = random_bars({"HOT": rows, "B": 80}, seed=seed, nulls=0.02, drift=1.0)
    pdf["ts"] = pdf["ts"].dt.floor("30min")
    pdf["seq"] = np.arange(len(pdf))
    return pdf


@pytest.mark.parametrize("size", [BlockSize(), SMALL], ids=["whole", "split"])
@pytest.mark.parametrize("run", [
    lambda df, size: ind.atr_wilder(df, 5, size=size), lambda df, size: ind.rsi_ratio(df, 5, size=size),
    lambda df, size: st.sma_cross(df, length=10, size=size),
    lambda df, size: st.sma_rsi_reversal(df, 10, 20, 5, 60, 55, size=size),
    lambda df, size: st.runners_swing(df, threshold=-50.0, size=size),
], ids=["atr", "rsi", "cross", "reversal", "swing"])
def test_arrival_orders_equal_times(spark, run, size):
    """Rows of equal time are worked off by ``seq``: the result is that of distinct times in the same order."""
    pdf = tied_bars()
    # One microsecond apart by arrival: the same order without ties, on the same days.
    spread = pdf.assign(ts=pdf["ts"] + pd.to_timedelta(pdf["seq"], unit="us")).drop(columns="seq")
    want = by_series(run(to_spark(spark, spread), BlockSize()))
    shuffled = to_spark(spark, pdf.sample(frac=1, random_state=3))
    got = run(shuffled, size).toPandas().sort_values(["symbol", "ts", "seq"], ignore_index=True)
    for symbol, w in want.items():
        g = got[got["symbol"] == symbol].reset_index(drop=True)
        assert len(g) == len(w)
        for c in (c for c in w.columns if c not in ("symbol", "ts")):
            if w[c].dtype.kind == "f":
                np.testing.assert_allclose(g[c].to_numpy(float), w[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)
            else:
                assert g[c].fillna("").tolist() == w[c].fillna("").tolist(), c


@pytest.mark.parametrize("size", [BlockSize(), SMALL], ids=["whole", "split"])
def test_trades_at_equal_times(spark, size):
    pdf = tied_bars(600)
    pdf["signal"] = np.random.default_rng(2).choice(["BUY", "SELL"], len(pdf))
    pdf["quantity"] = 1.0
    spread = pdf.assign(ts=pdf["ts"] + pd.to_timedelta(pdf["seq"], unit="us")).drop(columns="seq")
    columns = ["symbol", "avg_entry_price", "exit_price", "total_shares", "profit", "number_of_buys"]
    rows = lambda df, size: sorted(tuple(r) for r in bt.pair_trades(df, None, size).select(*columns).collect())
    assert rows(to_spark(spark, pdf.sample(frac=1, random_state=4)), size) == rows(to_spark(spark, spread), BlockSize())


def test_candles_of_equal_times_open_and_close_by_arrival(spark):
    pdf = tied_bars(400).dropna()
    got = by_series(resample_ohlcv(to_spark(spark, pdf.sample(frac=1, random_state=5)), 30))["HOT"].set_index("ts")
    hot = pdf[pdf["symbol"] == "HOT"].sort_values(["ts", "seq"]).groupby("ts")
    pd.testing.assert_series_equal(got["open"], hot["open"].first(), check_freq=False)
    pd.testing.assert_series_equal(got["close"], hot["close"].last(), check_freq=False)
