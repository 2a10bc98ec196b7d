"""Queries over signals: strategies, trades, performance."""

from __future__ import annotations

import re
from functools import partial

import pandas as pd
from pyspark.sql import functions as F

from tickloom.operators import backtest as bt
from tickloom.operators import quality as q
from tickloom.operators import resample as rs
from tickloom.operators import strategies as st
from tickloom.plans.blocks import BlockSize
from workload import fixtures as fx
from workload.bars import (
    ET_TS, RSI, SECONDS, W, atr_sql, candles_sql, hot_sql, pct_sql, rsi_sql, sma_sql,
    strategy_candles_sql,
)
from workload.fixtures import EVENT_SQL, SHIP_SQL, STRATEGIES_SQL, WALK_SQL, show
from workload.registry import query

BARS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def cross_sql(source: str, length: int, size: float = 150, by: str = "symbol", name: str = "crossed") -> str:
    """Table with signal, quantity and the mean ``m``; the mean is compared after rounding noise."""
    w = f"OVER (PARTITION BY {by} ORDER BY ts)"
    mean = sma_sql(length, "m").replace("PARTITION BY symbol", f"PARTITION BY {by}")
    return f"""{name}_m AS (SELECT *, {mean} FROM {source}),
      {name}_p AS (SELECT *, lag(close) {w} AS pc, lag(m) {w} AS pm FROM {name}_m),
      {name}_s AS (SELECT *, CASE WHEN pc < pm AND close > m THEN 'BUY'
        WHEN pc > pm AND close < m THEN 'SELL' END AS signal FROM {name}_p),
      {name} AS MATERIALIZED (SELECT *, CASE WHEN signal IS NULL THEN 0.0 ELSE {size} / close END AS quantity
        FROM {name}_s)"""


HOURLY = f"{EVENT_SQL}, {candles_sql(60)}, {cross_sql('candles', 20)}"


def hourly_cross(spark, sf):
    return st.sma_cross(fx.stored(rs.resample_ohlcv(fx.event_bars(spark, sf), 60)), length=20)


@query("g1_sma_cross", f"""WITH {HOURLY} SELECT symbol, ts, round(close, 4) AS close,
    round(m, 4) AS "SMA20", signal, round(quantity, 4) AS quantity FROM crossed""")
def g1(spark, sf):
    return show(hourly_cross(spark, sf), "symbol", "ts", "close", "SMA20", "signal", "quantity")


@query("g1_sma_cross_daily", f"""WITH {SHIP_SQL}, {cross_sql('bars', 200)} SELECT symbol, ts,
    round(close, 8) AS close, signal, round(quantity, 8) AS quantity FROM crossed WHERE signal IS NOT NULL""")
def g1_daily(spark, sf):
    signals = st.sma_cross(fx.stored(fx.ship_bars(spark, sf))).filter(F.col("signal").isNotNull())
    return show(signals, "symbol", "ts", "close", "signal", "quantity", fine=("close", "quantity"))


# Bars of one hour bear one time; the arrival number orders them.
TIED_SQL = """tied AS (SELECT upper(event_type) AS symbol, date_trunc('hour', ts) AS ts, event_id AS seq, value AS close,
    1.0 + user_id % 5 AS quantity, CASE event_id % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' END AS signal FROM events)"""


def in_arrival(sql: str) -> str:
    return re.sub(r"ORDER BY ts\b", "ORDER BY ts, seq", sql)


def tied(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.upper("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"), F.col("event_id").alias("seq"),
        F.col("value").alias("close"), (F.col("user_id") % 5 + 1.0).alias("quantity"),
        F.expr("CASE event_id % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' END").alias("signal"))


@query("g1_sma_cross_ties", f"""WITH bars AS (WITH {TIED_SQL} SELECT symbol, ts, seq, close + 1.0::DOUBLE AS close FROM tied),
    {in_arrival(cross_sql('bars', 20))} SELECT symbol, ts, seq, round(close, 4) AS close, round(m, 4) AS "SMA20", signal,
    round(quantity, 4) AS quantity FROM crossed""")
def g1_ties(spark, sf):
    return show(st.sma_cross(tied(spark, sf).select("symbol", "ts", "seq", (F.col("close") + 1.0).alias("close")), length=20),
                "symbol", "ts", "seq", "close", "SMA20", "signal", "quantity")


def reversal_sql(short: int = 200, long: int = 400, n: int = 14, low: float = 40, high: float = 55) -> str:
    """Tables over ``bars`` up to ``acted`` (symbol, ts, close, signal, quantity)."""
    return f"""{atr_sql('bars')}, {rsi_sql('tr', period=n)},
  m AS (SELECT *, CASE WHEN t >= {n} THEN 100 * gain / nullif(gain + loss, 0) END AS rsi,
    {sma_sql(short, 's1')}, {sma_sql(long, 's2')} FROM rsi_g),
  masks AS MATERIALIZED (SELECT symbol, ts, close, t, coalesce(rsi < {low} AND low > s1, false) AS e,
    coalesce(rsi > {high}, false) OR coalesce(low <= s2, false) AS x FROM m),
  walk(symbol, t, pos, signal) AS (
    SELECT symbol, t, e::INT, CASE WHEN e THEN 'BUY' END FROM masks WHERE t = 0
    UNION ALL SELECT m.symbol, m.t,
      CASE WHEN w.pos = 0 AND m.e THEN 1 WHEN w.pos = 1 AND m.x THEN 0 ELSE w.pos END,
      CASE WHEN w.pos = 0 AND m.e THEN 'BUY' WHEN w.pos = 1 AND m.x THEN 'SELL' END
    FROM walk w JOIN masks m ON m.symbol = w.symbol AND m.t = w.t + 1),
  acted AS MATERIALIZED (SELECT symbol, ts, close, signal,
    CASE WHEN signal IS NULL THEN 0.0 ELSE 1.0 END AS quantity FROM walk JOIN masks USING (symbol, t))"""


REVERSAL = f"{WALK_SQL}, {reversal_sql()}"


@query("g2_sma_rsi_reversal", f"""WITH RECURSIVE {REVERSAL} SELECT symbol, ts, round(close, 4) AS close,
    signal, round(quantity, 4)::DOUBLE AS quantity FROM acted WHERE signal IS NOT NULL""")
def g2(spark, sf):
    signals = st.sma_rsi_reversal(fx.stored(fx.walk_bars(spark, sf))).filter(F.col("signal").isNotNull())
    return show(signals, "symbol", "ts", "close", "signal", "quantity")


def holding_sql(rows: str, stop: str, extra: str = "") -> str:
    """Recursive walk over ``rows`` (symbol, t, close, e); ``stop`` may use w.entry and m.*."""
    return f"""walk(symbol, t, entry, signal, held) AS (
        SELECT symbol, t, CASE WHEN e THEN close END, CASE WHEN e THEN 'BUY' END, CASE WHEN e THEN close END
        FROM {rows} WHERE t = 0
        UNION ALL SELECT m.symbol, m.t,
          CASE WHEN w.entry IS NULL THEN CASE WHEN m.e THEN m.close END WHEN {stop} THEN NULL ELSE w.entry END,
          CASE WHEN w.entry IS NULL THEN CASE WHEN m.e THEN 'BUY' END WHEN {stop} THEN 'SELL' END,
          CASE WHEN w.entry IS NULL THEN CASE WHEN m.e THEN m.close END ELSE w.entry END
        FROM walk w JOIN {rows} m ON m.symbol = w.symbol AND m.t = w.t + 1)"""


# Daily candles of the driver's tables are stamped 16:00 UTC, inside the same market-local day.
def swing_sql(threshold: float = 5, period: int = 14) -> str:
    return f"""{pct_sql()}, {hot_sql(threshold)}, {atr_sql('hot', period)},
  lagged AS (SELECT *, pc - 2.5 * lag(ATR) {W} AS s, lag(ATR) {W} AS pa FROM atr),
  rules AS MATERIALIZED (SELECT symbol, ts, t, close, hot AND coalesce(low > s, false) AS e,
    coalesce(low < s, false) OR coalesce(daily_pct < -10, false) AS out, pa FROM lagged),
  {holding_sql('rules', 'm.out OR coalesce(m.close < w.entry - 1.5 * m.pa, false)')},
  acted AS MATERIALIZED (SELECT symbol, ts, close, signal,
    CASE WHEN signal IS NULL THEN 0.0 ELSE 1.0 END AS quantity FROM walk JOIN rules USING (symbol, t))"""


SWING = f"{SHIP_SQL}, {swing_sql()}"


@query("g3_runners_swing", f"""WITH RECURSIVE {SWING} SELECT symbol, ts, round(close, 8) AS close, signal,
    round(quantity, 4)::DOUBLE AS quantity FROM acted WHERE signal IS NOT NULL""")
def g3(spark, sf):
    signals = st.runners_swing(fx.stored(fx.ship_bars(spark, sf))).filter(F.col("signal").isNotNull())
    return show(signals, "symbol", "ts", "close", "signal", "quantity", fine=("close",))


def bracket_sql(opens: int = 34200, closes: int = 43200, jump: float = 5, target: float = 5) -> str:
    return f"""{atr_sql('bars')}, {rsi_sql('atr')},
  r AS (SELECT *, CASE WHEN total >= 41 THEN {RSI} END AS rsi FROM rsi_g),
  rp AS (SELECT *, lag(rsi) {W} AS rsi_prev FROM r),
  rules AS MATERIALIZED (SELECT *, in_buy_window AND is_bullish AND meets_volume_req AND meets_rsi_req AS e FROM (
    SELECT symbol, ts, t, open, high, low, close, ATR, {SECONDS} >= {opens} AND {SECONDS} < {closes} AS in_buy_window,
      coalesce(close > pc, false) AS is_bullish, coalesce(volume > 3000 / close * 100, false) AS meets_volume_req,
      coalesce(rsi - rsi_prev > {jump}, false) AS meets_rsi_req, {SECONDS} >= 57600 AS four FROM rp)),
  {holding_sql('rules', f'm.four OR m.low < w.entry - 0.9 * m.ATR OR m.high >= w.entry + {target} * m.ATR')},
  acted AS MATERIALIZED (SELECT symbol, ts, close, signal,
    CASE WHEN signal IS NULL THEN 0.0 ELSE 1.0 END AS quantity FROM walk JOIN rules USING (symbol, t))"""


BRACKET = f"{WALK_SQL}, {bracket_sql()}"
FLAGS = ["in_buy_window", "is_bullish", "meets_volume_req", "meets_rsi_req"]


@query("g4_opening_bracket", f"""WITH RECURSIVE {BRACKET} SELECT symbol, ts, round(close, 4) AS close, signal,
    round(held, 4) AS "EntryPrice", round(held + 5 * ATR, 4) AS "HighATR", round(held - 0.9 * ATR, 4) AS "LowATR",
    four AS is_4pm_or_later, {', '.join(FLAGS)}, CASE WHEN signal IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS quantity
    FROM walk JOIN rules USING (symbol, t)""")
def g4(spark, sf):
    out = st.opening_bracket(fx.stored(fx.walk_bars(spark, sf)), window=("09:30", "12:00"), rsi_jump=5)
    return show(out, "symbol", "ts", "close", "signal", "EntryPrice", "HighATR", "LowATR", "is_4pm_or_later", *FLAGS, "quantity")


def pandas_cross(pdf: pd.DataFrame) -> pd.DataFrame:
    """A user's strategy in pandas: crossing of the 20-row mean."""
    mean = pdf["close"].rolling(20).mean()
    before, close = pdf["close"].shift(1), pdf["close"]
    up = (before < mean.shift(1)) & (close > mean)
    down = (before > mean.shift(1)) & (close < mean)
    out = pdf[["symbol", "ts", "close"]].copy()
    out["signal"] = up.map({True: "BUY", False: None}).where(~down, "SELL")
    out["quantity"] = (150 / close).where(up | down, 0.0)
    return out


@query("g5_custom_strategy", f"""WITH {HOURLY} SELECT symbol, ts, round(close, 4) AS close, signal,
    round(quantity, 4) AS quantity FROM crossed""")
def g5(spark, sf):
    candles = rs.resample_ohlcv(fx.event_bars(spark, sf), 60)
    schema = "symbol string, ts timestamp, close double, signal string, quantity double"
    return show(st.custom_strategy(candles, pandas_cross, schema))


def folded_cross(block: pd.DataFrame, last: pd.DataFrame | None):
    """``pandas_cross`` on one block after the other; the last 20 rows are carried."""
    rows = pd.concat([last, block], ignore_index=True) if last is not None else block
    return pandas_cross(rows).iloc[len(rows) - len(block):], rows.tail(20)


@query("g5_custom_strategy_fold", f"""WITH {HOURLY} SELECT symbol, ts, round(close, 4) AS close, signal,
    round(quantity, 4) AS quantity FROM crossed""")
def g5_fold(spark, sf):
    candles = rs.resample_ohlcv(fx.event_bars(spark, sf), 60)
    schema = "symbol string, ts timestamp, close double, signal string, quantity double"
    return show(st.custom_strategy(candles, folded_cross, schema, state=None, size=BlockSize(rows=50)))


# The live loop's registry; two names stay unregistered there, so their candles give no rows.
CROSSES = {"sma_cross": partial(st.sma_cross, length=20),
           "runners_swing": partial(st.sma_cross, length=5, position_size=1000)}
# The four strategies, with periods that suit candles of the driver's tables.
RULES = {"sma_cross": partial(st.sma_cross, length=20),
         "sma_rsi_reversal": partial(st.sma_rsi_reversal, short=30, long=60, rsi_len=5, entry_rsi=50, exit_rsi=60),
         "runners_swing": partial(st.runners_swing, threshold=1, atr_len=5),
         "opening_bracket": partial(st.opening_bracket, pt=1.5, window=("09:30", "15:00"), rsi_jump=2, notional=3000)}


def named_cross(name, length, size, out, by="strategy_id"):
    return (f"{out}_in AS (SELECT * FROM candles WHERE name = '{name}'), "
            + cross_sql(f"{out}_in", length, size, by, out))


def ruled(name: str, tables: str) -> str:
    """Rows of the strategies called ``name``, each strategy being a symbol of ``tables``."""
    return f"""{name} AS MATERIALIZED (WITH RECURSIVE bars AS MATERIALIZED (
        SELECT CAST(strategy_id AS VARCHAR) AS symbol, ts, open, high, low, close, volume FROM candles WHERE name = '{name}'),
      {tables} SELECT CAST(symbol AS BIGINT) AS strategy_id, ts, close, signal, quantity FROM acted)"""


FAN_OUT = f"""{EVENT_SQL}, {STRATEGIES_SQL}, {strategy_candles_sql()},
  {named_cross('sma_cross', 20, 150, 'first_rule')}, {ruled('sma_rsi_reversal', reversal_sql(30, 60, 5, 50, 60))},
  {ruled('runners_swing', swing_sql(1, 5))}, {ruled('opening_bracket', bracket_sql(34200, 54000, 2, 1.5))},
  signals AS MATERIALIZED (SELECT r.strategy_id, a.symbol, ts, close, signal, quantity FROM (
    SELECT strategy_id, ts, close, signal, quantity FROM first_rule UNION ALL SELECT * FROM sma_rsi_reversal
    UNION ALL SELECT * FROM runners_swing UNION ALL SELECT * FROM opening_bracket) r JOIN active_s a ON a.id = r.strategy_id)"""


def strategy_signals(spark, sf):
    candles = rs.resample_for_strategies(fx.event_bars(spark, sf), fx.strategies(spark, sf))
    return st.run_strategies(candles, RULES)


@query("g6_run_strategies", f"""WITH {FAN_OUT} SELECT strategy_id, symbol, ts, round(close, 4) AS close,
    signal, round(quantity, 4) AS quantity FROM signals""")
def g6(spark, sf):
    return show(strategy_signals(spark, sf), "strategy_id", "symbol", "ts", "close", "signal", "quantity")


@query("g6_unknown_strategies", f"""WITH {STRATEGIES_SQL} SELECT id, name FROM strategies
    WHERE active = 1 AND name NOT IN ('sma_cross', 'runners_swing')""")
def g6_unknown(spark, sf):
    return st.unknown_strategies(fx.strategies(spark, sf), CROSSES).select("id", "name")


@query("f8_validate_signals", f"""WITH {HOURLY} SELECT symbol, count(*) AS rows,
    count(*) FILTER (hour(ts) = 3 AND signal IS NOT NULL) AS bad_signals,
    count(*) FILTER (hour(ts) = 5) AS null_quantities FROM crossed GROUP BY 1""")
def f8(spark, sf):
    hour = F.hour("ts")
    spoiled = hourly_cross(spark, sf).withColumns({
        "signal": F.when((hour == 3) & F.col("signal").isNotNull(), "HOLD").otherwise(F.col("signal")),
        "quantity": F.when(hour != 5, F.col("quantity"))})
    return q.validate_signals(spoiled)


@query("q4_normalize_signals", f"WITH {HOURLY} SELECT symbol, ts, signal FROM crossed WHERE signal IS NOT NULL")
def q4(spark, sf):
    older = hourly_cross(spark, sf).withColumn("strategy", F.lower("signal")).drop("signal")
    return show(q.normalize_signals(older).filter(F.col("signal").isNotNull()), "symbol", "ts", "signal")


# ---- trades ----

@query("b1_signal_counts", f"""WITH {HOURLY} SELECT symbol, count(*) AS rows,
    count(*) FILTER (signal = 'BUY') AS buys, count(*) FILTER (signal = 'SELL') AS sells FROM crossed GROUP BY 1""")
def b1(spark, sf):
    return bt.signal_counts(hourly_cross(spark, sf))


@query("b2_recent_signals", f"""WITH {HOURLY} SELECT symbol, ts, signal, round(close, 4) AS close FROM
    (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM crossed WHERE signal IS NOT NULL)
    WHERE r <= 10""")
def b2(spark, sf):
    return show(bt.recent_signals(hourly_cross(spark, sf)), "symbol", "ts", "signal", "close")


@query("b3_signal_points", f"""WITH {HOURLY} SELECT symbol, ts, round(close, 4) AS close, signal
    FROM crossed WHERE signal IS NOT NULL""")
def b3(spark, sf):
    return show(bt.signal_points(hourly_cross(spark, sf)))


# The walk carries position and totals row by row, unlike the grouping the operator uses.
PAIRING = """v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM {source}
    WHERE signal IN ('BUY', 'SELL') AND close IS NOT NULL AND quantity > 0),
  ledger(symbol, rn, shares, cost, buys, since, sold, s_shares, s_cost, s_buys, s_since) AS (
    SELECT symbol, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::BIGINT, NULL::TIMESTAMP, false, 0::DOUBLE, 0::DOUBLE, 0::BIGINT,
      NULL::TIMESTAMP FROM (SELECT DISTINCT symbol FROM v)
    UNION ALL SELECT v.symbol, v.rn,
      CASE WHEN signal = 'BUY' THEN shares + quantity WHEN cost <> 0 THEN 0 ELSE shares END,
      CASE WHEN signal = 'BUY' THEN cost + close * quantity WHEN cost <> 0 THEN 0 ELSE cost END,
      CASE WHEN signal = 'BUY' THEN buys + 1 WHEN cost <> 0 THEN 0 ELSE buys END,
      CASE WHEN signal = 'BUY' THEN coalesce(since, v.ts) WHEN cost <> 0 THEN NULL ELSE since END,
      signal = 'SELL' AND buys > 0 AND cost <> 0, shares, cost, buys, since
    FROM ledger l JOIN v ON v.symbol = l.symbol AND v.rn = l.rn + 1),
  trades AS MATERIALIZED (SELECT l.symbol, s_since AS entry_time, v.ts AS exit_time, s_cost / s_shares AS avg_entry_price,
    v.close AS exit_price, CAST(floor(s_shares) AS BIGINT) AS total_shares, s_cost AS total_cost,
    s_shares * v.close AS exit_value, s_shares * v.close - s_cost AS profit,
    (s_shares * v.close - s_cost) / s_cost * 100 AS profit_pct, s_buys AS number_of_buys
    FROM ledger l JOIN v USING (symbol, rn) WHERE sold)"""

# Repeated buys, unpriced buys and bad quantities, so that every pairing rule is met.
MESSY = f"""{SHIP_SQL}, {cross_sql('bars', 5, 100000)}, messy AS (SELECT symbol, ts,
    CASE WHEN day(ts) % 11 = 0 THEN 0.0 ELSE close END AS close,
    CASE WHEN day(ts) % 7 = 0 AND signal = 'SELL' THEN 'BUY' ELSE signal END AS signal,
    CASE WHEN day(ts) % 13 = 0 THEN -1.0 ELSE quantity END AS quantity FROM crossed)"""

FINE = ("avg_entry_price", "exit_price")
TRADE_SQL = """symbol, entry_time, exit_time, round(avg_entry_price, 8) AS avg_entry_price,
    round(exit_price, 8) AS exit_price, total_shares, round(total_cost, 4) AS total_cost,
    round(exit_value, 4) AS exit_value, round(profit, 4) AS profit, round(profit_pct, 4) AS profit_pct, number_of_buys"""

# One share per signal keeps these amounts at price precision.
TRADE_FINE_SQL = TRADE_SQL.replace("total_cost, 4", "total_cost, 8").replace(
    "exit_value, 4", "exit_value, 8").replace("profit, 4", "profit, 8")


def messy_signals(spark, sf):
    day = F.dayofmonth("ts")
    return st.sma_cross(fx.stored(fx.ship_bars(spark, sf)), position_size=100000, length=5).withColumns({
        "close": F.when(day % 11 == 0, 0.0).otherwise(F.col("close")),
        "signal": F.when((day % 7 == 0) & (F.col("signal") == "SELL"), "BUY").otherwise(F.col("signal")),
        "quantity": F.when(day % 13 == 0, -1.0).otherwise(F.col("quantity"))})


@query("b4_pair_trades", f"WITH RECURSIVE {MESSY}, {PAIRING.format(source='messy')} SELECT {TRADE_SQL} FROM trades")
def b4(spark, sf):
    return show(bt.pair_trades(messy_signals(spark, sf), decimals=None), fine=FINE)


@query("b4_pair_trades_ties", f"WITH RECURSIVE {TIED_SQL}, {in_arrival(PAIRING.format(source='tied'))} SELECT {TRADE_SQL} FROM trades")
def b4_ties(spark, sf):
    """Many signals of a series bear one time."""
    return show(bt.pair_trades(tied(spark, sf), decimals=None), fine=FINE)


@query("b4_pair_trades_swing", f"WITH RECURSIVE {SWING}, {PAIRING.format(source='acted')} SELECT {TRADE_FINE_SQL} FROM trades")
def b4_swing(spark, sf):
    return show(bt.pair_trades(st.runners_swing(fx.stored(fx.ship_bars(spark, sf))), decimals=None),
                fine=(*FINE, "total_cost", "exit_value", "profit"))


@query("b5_open_positions", f"""WITH RECURSIVE {MESSY}, {PAIRING.format(source='messy')}
    SELECT symbol, since AS entry_time, round(shares, 4) AS open_shares, round(cost, 4) AS open_cost, buys AS open_buys
    FROM ledger l WHERE buys > 0 AND rn = (SELECT max(rn) FROM v WHERE v.symbol = l.symbol)""")
def b5(spark, sf):
    return show(bt.open_positions(messy_signals(spark, sf)))


SUMMARY_SQL = """SELECT symbol, count(*) AS total_trades, count(*) FILTER (profit_pct > 0) AS winning_trades,
    count(*) FILTER (profit_pct <= 0) AS losing_trades,
    round(100.0 * count(*) FILTER (profit_pct > 0) / count(*), 4) AS win_rate_pct,
    round(sum(profit), 4) AS total_profit, round(avg(profit), 4) AS avg_profit,
    round(max(profit), 4) AS max_win, round(min(profit), 4) AS max_loss, round(avg(total_cost), 4) AS avg_capital,
    round(sum(profit_pct), 4) AS total_return_pct, round(avg(profit_pct), 4) AS avg_return_pct,
    round(coalesce(avg(profit_pct) FILTER (profit_pct > 0), 0), 4) AS avg_win_pct,
    round(coalesce(avg(profit_pct) FILTER (profit_pct <= 0), 0), 4) AS avg_loss_pct,
    round(CASE WHEN coalesce(avg(profit_pct) FILTER (profit_pct <= 0), 0) = 0 THEN 'inf'::DOUBLE ELSE
      abs(coalesce(avg(profit_pct) FILTER (profit_pct > 0), 0) / avg(profit_pct) FILTER (profit_pct <= 0)) END, 4)
      AS win_loss_ratio,
    round(stddev_samp(profit_pct), 4) AS std_pct,
    round(CASE WHEN stddev_samp(profit_pct) > 0 THEN avg(profit_pct) / stddev_samp(profit_pct) ELSE 0 END, 4)
      AS return_risk_ratio FROM trades GROUP BY 1"""


@query("b6_performance_summary", f"WITH RECURSIVE {MESSY}, {PAIRING.format(source='messy')} {SUMMARY_SQL}")
def b6(spark, sf):
    trades = bt.pair_trades(messy_signals(spark, sf), decimals=None)
    return show(bt.performance_summary(trades, decimals=None))


@query("b7_analysis_status", f"""WITH RECURSIVE {MESSY},
  spoiled AS (SELECT symbol, ts, close, quantity, CASE WHEN symbol = 'AF' THEN NULL
    WHEN symbol = 'NF' AND signal = 'SELL' THEN NULL ELSE signal END AS signal FROM messy),
  {PAIRING.format(source='spoiled')},
  o AS (SELECT symbol, arg_max(buys, rn) AS open_buys FROM ledger GROUP BY 1),
  t AS (SELECT symbol, count(*) AS n FROM trades GROUP BY 1),
  s AS (SELECT symbol, count(signal) AS signals FROM spoiled GROUP BY 1)
  SELECT symbol, coalesce(t.n, 0) AS trades, coalesce(open_buys, 0) AS open_buys,
    CASE WHEN signals = 0 THEN 'no signals' WHEN t.n > 0 THEN 'ok'
      WHEN open_buys > 0 THEN 'no complete trades (' || open_buys || ' open)'
      ELSE 'no complete trades' END AS status
  FROM s LEFT JOIN o USING (symbol) LEFT JOIN t USING (symbol)""")
def b7(spark, sf):
    quiet = (F.col("symbol") == "AF") | ((F.col("symbol") == "NF") & (F.col("signal") == "SELL"))
    spoiled = messy_signals(spark, sf).withColumn("signal", F.when(~F.coalesce(quiet, F.lit(False)), F.col("signal")))
    return bt.analysis_status(spoiled)
