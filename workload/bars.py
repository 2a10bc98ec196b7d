"""Queries over bars: readers, filters, candles, indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.clock import local
from tickloom.operators import indicators as ind
from tickloom.operators import quality as q
from tickloom.operators import resample as rs
from tickloom.sources import payloads, store
from tickloom.sources.scratch import scratch_path
from workload import fixtures as fx
from workload.fixtures import EVENT_SQL, SHIP_SQL, STRATEGIES_SQL, TICKS_SQL, WALK_SQL, et, show
from workload.registry import query

OHLCV = """symbol, ts, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low,
    round(close, 4) AS close, round(volume, 4) AS volume"""
ET_TS = et("ts")
SECONDS = f"(hour({ET_TS}) * 3600 + minute({ET_TS}) * 60 + second({ET_TS}))"
RTH = f"{SECONDS} BETWEEN 34200 AND 57600"


# ---- sources and sinks ----

def _land(spark, df, name: str) -> str:
    """Write payload rows as JSON lines; returns the folder."""
    path = scratch_path(spark, name)
    df.write.json(path, ignoreNullFields=True)
    return path


def _day_groups(bars, item):
    return bars.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(
        F.collect_list(item).alias("items"))


def _text(*columns):
    return [F.col(c).cast("string").alias(c) for c in columns]


@query("s1_read_history_candles", f"WITH {EVENT_SQL} SELECT {OHLCV} FROM bars")
def s1(spark, sf):
    item = F.struct(F.unix_millis("ts").alias("datetime"), *_text("open", "high", "low", "close", "volume"))
    days = _day_groups(fx.event_bars(spark, sf), item)
    path = _land(spark, days.select("symbol", F.col("items").alias("candles")), "history")
    return show(payloads.read_history_candles(spark, path))


@query("s2_read_series_values", f"WITH {EVENT_SQL} SELECT {OHLCV} FROM bars WHERE {RTH}")
def s2(spark, sf):
    item = F.struct(F.date_format(local(F.col("ts")), payloads.SERIES_TIME).alias("datetime"),
                    *_text("open", "high", "low", "close", "volume"))
    days = _day_groups(fx.event_bars(spark, sf), item)
    path = _land(spark, days.select(F.lit("ok").alias("status"), F.struct("symbol").alias("meta"),
                                    F.col("items").alias("values")), "series")
    return show(payloads.read_series_values(spark, path))


@query("s3_read_agg_results",
       f"WITH {EVENT_SQL} SELECT {OHLCV} FROM bars WHERE CAST(volume AS BIGINT) % 70000 <> 0")
def s3(spark, sf):
    volume = F.when(F.col("volume") % 70000 != 0, F.col("volume"))
    item = F.struct(F.unix_millis("ts").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"),
                    F.col("low").alias("l"), F.col("close").alias("c"), volume.alias("v"))
    days = _day_groups(fx.event_bars(spark, sf), item)
    path = _land(spark, days.select(F.lit("OK").alias("status"), F.col("symbol").alias("ticker"),
                                    F.col("items").alias("results")), "aggs")
    return show(payloads.read_agg_results(spark, path))


@query("s6_read_news", """SELECT date_trunc('millisecond', ts) AS published_utc, upper(event_type) AS ticker,
    props AS title FROM events""")
def s6(spark, sf):
    items = payloads.read_news(spark, _land(spark, fx.news_payloads(spark, sf), "news"))
    return show(items.select("published_utc", F.element_at("tickers", 1).alias("ticker"), "title"))


@query("s7_append_csv", f"""WITH {EVENT_SQL} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS at,
    round(close, 4) AS close FROM bars UNION ALL
    SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS at, round(open, 4) AS close FROM bars""")
def s7(spark, sf):
    path = scratch_path(spark, "csv")
    bars = fx.event_bars(spark, sf).withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm"))
    store.append_csv(bars.select("symbol", "at", "close"), path)
    store.append_csv(bars.select("symbol", "at", F.col("open").alias("close")), path)
    return show(spark.read.schema("symbol string, at string, close double")
                .option("header", True).csv(path))


@query("s8_read_registry", f"""WITH {STRATEGIES_SQL}, {fx.POSITIONS_SQL}
    SELECT s.id AS strategy_id, s.name, count(p.order_id) AS orders, round(sum(p.quantity), 4) AS quantity
    FROM strategies s JOIN positions p ON p.strategy_id = s.id GROUP BY 1, 2""")
def s8(spark, sf):
    path = scratch_path(spark, "registry")
    fx.strategies(spark, sf).write.parquet(f"{path}/day_trading_strategies")
    fx.positions(spark, sf).write.parquet(f"{path}/active_positions")
    fx.trade_history(spark, sf).write.parquet(f"{path}/trade_history")
    tables = store.read_registry(spark, path)
    s, p = tables["day_trading_strategies"], tables["active_positions"]
    totals = p.groupBy("strategy_id").agg(
        F.count("order_id").alias("orders"), F.sum("quantity").alias("quantity"))
    return show(totals.join(s.select(F.col("id").alias("strategy_id"), "name"), "strategy_id"),
                "strategy_id", "name", "orders", "quantity")


@query("s9_write_bars", f"""WITH {EVENT_SQL} SELECT {OHLCV} FROM bars
    WHERE CAST({ET_TS} AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""")
def s9(spark, sf):
    path = scratch_path(spark, "bars")
    store.write_bars(fx.event_bars(spark, sf), path)
    return show(store.read_bars(spark, path, "2024-01-05", "2024-01-12"),
                "symbol", "ts", "open", "high", "low", "close", "volume")


@query("s9_write_bars_by_symbol", f"WITH {EVENT_SQL} SELECT {OHLCV} FROM bars")
def s9_by_symbol(spark, sf):
    """Every day of the store, in folders by day and symbol."""
    path = scratch_path(spark, "bars-by-symbol")
    store.write_bars(fx.event_bars(spark, sf), path, by_symbol=True)
    return show(store.read_bars(spark, path), "symbol", "ts", "open", "high", "low", "close", "volume")


# ---- filters and quality ----

@query("f2_coerce_numeric", """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL
    ELSE round(value, 4) END AS value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id * 1.0::DOUBLE END AS amount
    FROM events""")
def f2_coerce(spark, sf):
    return show(q.coerce_numeric(_dirty(spark, sf), ["value", "amount"]), "event_id", "value", "amount")


def _dirty(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.upper("event_type").alias("symbol"), "event_id",
        F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_id") % 5 == 0, "NaN").otherwise(F.col("user_id").cast("string")).alias("amount"))


@query("f2_quality_report", """WITH c AS (SELECT upper(event_type) AS symbol, count(*) AS rows,
    count(*) FILTER (event_id % 17 = 0) AS value, count(*) FILTER (event_id % 5 = 0) AS amount
    FROM events GROUP BY 1)
    SELECT symbol, rows, 'value' AS "column", value AS nulls, round(100.0 * value / rows, 4) AS null_pct FROM c
    UNION ALL SELECT symbol, rows, 'amount', amount, round(100.0 * amount / rows, 4) FROM c""")
def f2_report(spark, sf):
    clean = q.coerce_numeric(_dirty(spark, sf), ["value", "amount"])
    return show(q.quality_report(clean, ["value", "amount"]))


@query("f3_session_filter", f"WITH {EVENT_SQL} SELECT {OHLCV} FROM bars WHERE {RTH}")
def f3(spark, sf):
    return show(q.session_filter(fx.event_bars(spark, sf)))


@query("f4_lookback", f"""WITH {EVENT_SQL} SELECT {OHLCV} FROM bars WHERE ts BETWEEN
    TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 15 MINUTE - INTERVAL 3 DAY
    AND TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 15 MINUTE""")
def f4(spark, sf):
    return show(q.lookback(fx.event_bars(spark, sf), "2024-01-20 12:00:00", 3, delay_minutes=15))


@query("f4_lookback_sessions", f"""WITH {EVENT_SQL}, d AS (SELECT symbol, day, row_number() OVER
    (PARTITION BY symbol ORDER BY day DESC) AS r FROM (SELECT DISTINCT symbol, CAST({ET_TS} AS DATE) AS day
     FROM bars WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'))
    SELECT {OHLCV.replace('symbol,', 'b.symbol AS symbol,')} FROM bars b JOIN d ON b.symbol = d.symbol
    AND CAST({ET_TS} AS DATE) = d.day AND d.r <= 4 WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'""")
def f4_sessions(spark, sf):
    return show(q.lookback_sessions(fx.event_bars(spark, sf), "2024-01-20 12:00:00", 4))


@query("f5_news_on_half_hour", f"""SELECT {ET_TS} AS published_local, upper(event_type) AS ticker,
    props AS title FROM events WHERE ts >= TIMESTAMP '2024-01-10 08:00:00' AND minute({ET_TS}) IN (0, 30)""")
def f5(spark, sf):
    hits = q.news_on_half_hour(fx.news(spark, sf), as_of="2024-01-10 10:00:00", hours=2)
    return show(hits.select("published_local", F.element_at("tickers", 1).alias("ticker"), "title"))


@query("f6_active_strategies", f"WITH {STRATEGIES_SQL} SELECT * FROM active_s")
def f6(spark, sf):
    return show(q.active_strategies(fx.strategies(spark, sf)), "id", "name", "time_frame", "symbol",
                "order_type", "lookback_days", "extended_hours")


@query("f7_filled_orders_on_day", f"""WITH {fx.STATUS_SQL} SELECT * FROM order_status
    WHERE status = 'FILLED' AND entered_time >= TIMESTAMP '2000-08-03' AND entered_time < TIMESTAMP '2000-08-04'""")
def f7(spark, sf):
    return show(q.filled_orders_on_day(fx.order_status(spark, sf), "2000-08-03"))


@query("f9_check_constraints", f"""WITH {fx.POSITIONS_SQL}, p AS (SELECT order_id, strategy_id * 2 AS strategy_id,
    quantity - 3 AS quantity, entry_price FROM positions UNION ALL SELECT order_id, strategy_id * 2, quantity,
    entry_price - 1000000 FROM positions WHERE CAST(order_id AS BIGINT) % 9 = 0)
    SELECT order_id, strategy_id, round(quantity, 4) AS quantity, round(entry_price, 4) AS entry_price,
    concat_ws('; ', CASE WHEN quantity <= 0 THEN 'quantity not positive' END,
      CASE WHEN entry_price < 0 THEN 'entry_price negative' END,
      CASE WHEN count(*) OVER (PARTITION BY order_id) > 1 THEN 'order_id not unique' END,
      CASE WHEN strategy_id NOT IN (SELECT n_nationkey FROM nation) THEN 'strategy unknown' END) AS reasons
    FROM p""")
def f9(spark, sf):
    base = fx.positions(spark, sf).withColumn("strategy_id", F.col("strategy_id") * 2)
    again = base.filter(F.col("order_id").cast("bigint") % 9 == 0).withColumn(
        "entry_price", F.col("entry_price") - 1000000)
    rows = base.withColumn("quantity", F.col("quantity") - 3).unionByName(again)
    checked = q.check_constraints(rows, "active_positions", fx.strategies(spark, sf))
    return show(checked.withColumn("reasons", F.concat_ws("; ", "reasons")),
                "order_id", "strategy_id", "quantity", "entry_price", "reasons")


@query("f9_check_trade_history", f"""WITH {fx.HISTORY_SQL}, h AS (SELECT id, CASE WHEN id % 17 <> 0 THEN strategy_id * 2 END
    AS strategy_id, quantity - 2 AS quantity, CASE WHEN id % 29 <> 0 THEN price - 1000 END AS price,
    CASE WHEN id % 7 = 0 THEN 'HOLD' WHEN id % 11 <> 0 THEN side END AS side FROM history)
    SELECT id, strategy_id, round(quantity, 4) AS quantity, round(price, 8) AS price, side,
    concat_ws('; ', CASE WHEN strategy_id IS NULL THEN 'strategy_id is null' END,
      CASE WHEN price IS NULL THEN 'price is null' END, CASE WHEN side IS NULL THEN 'side is null' END,
      CASE WHEN quantity <= 0 THEN 'quantity not positive' END, CASE WHEN price < 0 THEN 'price negative' END,
      CASE WHEN side NOT IN ('BUY', 'SELL') THEN 'side not allowed' END,
      CASE WHEN strategy_id NOT IN (SELECT n_nationkey FROM nation) THEN 'strategy unknown' END) AS reasons FROM h""")
def f9_history(spark, sf):
    rows = fx.trade_history(spark, sf).select(
        "id", F.expr("CASE WHEN id % 17 <> 0 THEN strategy_id * 2 END").alias("strategy_id"), (F.col("quantity") - 2).alias("quantity"),
        F.expr("CASE WHEN id % 29 <> 0 THEN price - 1000 END").alias("price"),
        F.expr("CASE WHEN id % 7 = 0 THEN 'HOLD' WHEN id % 11 <> 0 THEN side END").alias("side"))
    checked = q.check_constraints(rows, "trade_history", fx.strategies(spark, sf))
    return show(checked.withColumn("reasons", F.concat_ws("; ", "reasons")),
                "id", "strategy_id", "quantity", "price", "side", "reasons", fine=("price",))


# One strategy row per customer; what is null takes the table's default before it is checked.
TERMS = """c_custkey AS id, CASE WHEN c_custkey % 17 <> 0 THEN 'sma_cross' END AS name,
    CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS time_frame, lower(c_mktsegment) AS symbol,
    CASE c_custkey % 5 WHEN 0 THEN 'STOP' WHEN 1 THEN NULL ELSE 'LIMIT' END AS order_type,
    CASE WHEN c_custkey % 19 <> 0 THEN c_custkey % 13 END AS lookback_days, c_custkey % 3 AS extended_hours,
    CASE WHEN c_custkey % 23 <> 0 THEN c_custkey % 4 END AS active"""


@query("f9_check_strategies", f"""WITH t AS (SELECT {TERMS} FROM customer), d AS (SELECT id, name, time_frame, symbol,
    coalesce(order_type, 'MARKET') AS order_type, coalesce(lookback_days, 3) AS lookback_days, extended_hours,
    coalesce(active, 1) AS active FROM t)
    SELECT *, concat_ws('; ', CASE WHEN name IS NULL THEN 'name is null' END,
      CASE WHEN time_frame IS NULL THEN 'time_frame is null' END,
      CASE WHEN order_type NOT IN ('MARKET', 'LIMIT') THEN 'order_type not allowed' END,
      CASE WHEN lookback_days NOT BETWEEN 1 AND 10 THEN 'lookback_days out of range' END,
      CASE WHEN extended_hours NOT IN (0, 1) THEN 'extended_hours not 0/1' END,
      CASE WHEN active NOT IN (0, 1) THEN 'active not 0/1' END) AS reasons FROM d""")
def f9_strategies(spark, sf):
    customers = fx.table(spark, sf, "customer")
    customers.createOrReplaceTempView("strategy_customers")
    rows = spark.sql(f"SELECT {TERMS} FROM strategy_customers")
    checked = q.check_constraints(rows, "day_trading_strategies")
    return show(checked.withColumn("reasons", F.concat_ws("; ", "reasons")), "id", "name", "time_frame", "symbol",
                "order_type", "lookback_days", "extended_hours", "active", "reasons")


@query("f10_symbols_to_track", f"WITH {STRATEGIES_SQL} SELECT DISTINCT symbol FROM active_s")
def f10(spark, sf):
    return q.symbols_to_track(fx.strategies(spark, sf))


@query("q9_dedupe_bars", f"WITH {EVENT_SQL} SELECT {OHLCV} FROM bars")
def q9(spark, sf):
    bars = fx.event_bars(spark, sf)
    stale = bars.withColumn("close", F.lit(0.0)).withColumn("arrived", F.lit(1))
    both = stale.unionByName(bars.withColumn("arrived", F.lit(2)))
    return show(q.dedupe_bars(both, "arrived").drop("arrived"))


# ---- candles ----

def grid_sql(minutes: str, first: str, ts: str = "ts") -> str:
    """Candle start on the grid anchored at the local midnight of ``first``."""
    origin = f"timezone('UTC', timezone('America/New_York', date_trunc('day', {et(first)})))"
    return (f"make_timestamp(epoch_us({origin}) + ((epoch_us({ts}) - epoch_us({origin})) "
            f"// (60000000::BIGINT * {minutes})) * (60000000::BIGINT * {minutes}))")


def candles_sql(minutes: int, bars: str = "bars", name: str = "candles") -> str:
    return f"""{name} AS MATERIALIZED (SELECT symbol, {grid_sql(str(minutes), 'f')} AS ts,
        first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
        last(close ORDER BY ts) AS close, sum(volume) AS volume
        FROM (SELECT *, min(ts) OVER (PARTITION BY symbol) AS f, count(*) OVER (PARTITION BY symbol) AS n
              FROM {bars}) WHERE n >= {minutes} GROUP BY 1, 2)"""


def _resample(minutes):
    @query(f"a1_resample_{minutes}m", f"WITH {EVENT_SQL}, {candles_sql(minutes)} SELECT {OHLCV} FROM candles")
    def a1(spark, sf):
        return show(rs.resample_ohlcv(fx.event_bars(spark, sf), minutes))


for _m in (5, 60, 45, 240):
    _resample(_m)


@query("a1_resample_complete_only", f"""WITH {EVENT_SQL} SELECT symbol, to_timestamp(epoch(ts)
    // 120 * 120)::TIMESTAMP AS ts, round(first(open ORDER BY ts), 4) AS open, round(max(high), 4) AS high,
    round(min(low), 4) AS low, round(last(close ORDER BY ts), 4) AS close, round(sum(volume), 4) AS volume
    FROM bars GROUP BY 1, 2 HAVING count(*) = 2""".replace(
    "to_timestamp(epoch(ts)\n    // 120 * 120)::TIMESTAMP", "make_timestamp(epoch_us(ts) // 120000000 * 120000000)"))
def a1_complete(spark, sf):
    return show(rs.resample_ohlcv(fx.event_bars(spark, sf), 2, complete_only=True))


def strategy_candles_sql(as_of: str | None = None) -> str:
    cut = f"AND b.ts <= TIMESTAMP '{as_of}' AND b.ts >= TIMESTAMP '{as_of}' - to_days(s.lookback_days)" if as_of else ""
    return f"""joined AS (SELECT s.id AS strategy_id, s.name, s.time_frame, b.* FROM bars b JOIN active_s s
        ON b.symbol = s.symbol WHERE (s.extended_hours = 1 OR {RTH.replace('ts)', 'b.ts)')}) {cut}),
      counted AS (SELECT *, min(ts) OVER (PARTITION BY strategy_id) AS f,
        count(*) OVER (PARTITION BY strategy_id) AS n FROM joined),
      candles AS MATERIALIZED (SELECT strategy_id, name, symbol, time_frame,
        {grid_sql('time_frame', 'f')} AS ts, first(open ORDER BY ts) AS open, max(high) AS high,
        min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume
        FROM counted WHERE n >= time_frame GROUP BY ALL)"""


AS_OF = "2024-01-25 20:00:00"


@query("a2_resample_for_strategies", f"""WITH {EVENT_SQL}, {STRATEGIES_SQL}, {strategy_candles_sql(AS_OF)}
    SELECT strategy_id, name, time_frame, {OHLCV} FROM candles""")
def a2(spark, sf):
    return show(rs.resample_for_strategies(
        fx.event_bars(spark, sf), fx.strategies(spark, sf), as_of=AS_OF))


@query("a3_daily_close", f"""WITH {EVENT_SQL} SELECT symbol, CAST({ET_TS} AS DATE) AS day,
    round(last(close ORDER BY ts), 4) AS daily_close FROM bars GROUP BY 1, 2""")
def a3(spark, sf):
    return show(rs.daily_close(fx.event_bars(spark, sf)))


@query("a4_ticks_to_bars", f"WITH {EVENT_SQL} SELECT {OHLCV} FROM bars")
def a4(spark, sf):
    return show(fx.event_bars(spark, sf))


@query("a4_walk_bars", f"WITH {WALK_SQL} SELECT {OHLCV} FROM bars")
def a4_walk(spark, sf):
    return show(fx.walk_bars(spark, sf))


# ---- indicators ----

W = "OVER (PARTITION BY symbol ORDER BY ts)"


def sma_sql(length: int, out: str, col: str = "close") -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {over} = {length} THEN avg({col}) {over} END AS {out}"


def ewm_sql(x: str, alpha: float, at: str) -> str:
    """Closed form of the seeded exponential mean; ``at`` counts rows from the seed."""
    keep = repr(1 - alpha)
    return (f"pow({keep}, {at}) * sum(CASE WHEN {at} = 0 THEN {x} ELSE {alpha!r} * {x} END "
            f"* pow({keep}, -({at}))) OVER (PARTITION BY symbol ORDER BY ts "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def atr_sql(source: str, period: int = 14, extra: str = "") -> str:
    """Tables ``tr`` and ``atr``: the source's rows with t, pc, true_range, ATR."""
    return f"""tr AS (SELECT *, row_number() {W} - 1 AS t, lag(close) {W} AS pc{extra} FROM {source}),
      tr2 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range FROM tr),
      atr AS MATERIALIZED (SELECT *, {ewm_sql('true_range', 1 / period, 't')} AS ATR FROM tr2)"""


def rsi_sql(source: str, name: str = "rsi", period: int = 14) -> str:
    """``source`` needs t and pc; adds gain, loss."""
    return f"""{name}_d AS (SELECT *, close - pc AS d FROM {source}),
      {name}_g AS MATERIALIZED (SELECT * EXCLUDE (d),
        CASE WHEN t > 0 THEN {ewm_sql('greatest(d, 0)', 1 / period, '(t - 1)')} END AS gain,
        CASE WHEN t > 0 THEN {ewm_sql('greatest(-d, 0)', 1 / period, '(t - 1)')} END AS loss,
        count(*) OVER (PARTITION BY symbol) AS total FROM {name}_d WHERE t > 0
        UNION ALL SELECT * EXCLUDE (d), NULL, NULL, 1000 FROM {name}_d WHERE t = 0)"""


RSI = "100 - 100 / (1 + gain / nullif(loss, 0))"


@query("w1_sma", f"WITH {EVENT_SQL} SELECT symbol, ts, round(s, 4) AS \"SMA50\" FROM (SELECT *, {sma_sql(50, 's')} FROM bars)")
def w1(spark, sf):
    return show(ind.sma(fx.event_bars(spark, sf), 50), "symbol", "ts", "SMA50")


@query("w2_ewm_mean", f"""WITH {WALK_SQL}, n AS (SELECT *, row_number() {W} - 1 AS t FROM bars)
    SELECT symbol, ts, round({ewm_sql('close', 0.1, 't')}, 4) AS close_ewm FROM n""")
def w2(spark, sf):
    return show(ind.ewm(fx.walk_bars(spark, sf), "close", 0.1), "symbol", "ts", "close_ewm")


@query("w3_true_range", f"WITH {EVENT_SQL}, {atr_sql('bars')} SELECT symbol, ts, round(true_range, 4) AS true_range FROM tr2")
def w3(spark, sf):
    return show(ind.true_range(fx.event_bars(spark, sf)), "symbol", "ts", "true_range")


@query("w4_atr_wilder", f"WITH {EVENT_SQL}, {atr_sql('bars')} SELECT symbol, ts, round(ATR, 4) AS \"ATR\" FROM atr")
def w4(spark, sf):
    return show(ind.atr_wilder(fx.event_bars(spark, sf)), "symbol", "ts", "ATR")


@query("w5_rsi_wilder", f"""WITH {EVENT_SQL}, {atr_sql('bars')}, {rsi_sql('tr')}
    SELECT symbol, ts, round({RSI}, 4) AS "RSI" FROM rsi_g""")
def w5(spark, sf):
    return show(ind.rsi_wilder(fx.event_bars(spark, sf)), "symbol", "ts", "RSI")


# Bars with prices missing on some minutes, and for a week of one symbol.
GAP = """(epoch_us(ts) // 60000000) % 7 IN (2, 3) OR (symbol = 'VIEW' AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15')"""
GAP_SQL = f"""gapped AS MATERIALIZED (SELECT symbol, ts, CASE WHEN NOT ({GAP}) THEN high END AS high,
    CASE WHEN NOT ({GAP}) THEN low END AS low, CASE WHEN NOT ({GAP}) THEN close END AS close FROM bars)"""


def gap_bars(spark, sf):
    gone = F.expr("(unix_seconds(ts) div 60) % 7 IN (2, 3) OR (symbol = 'VIEW' AND ts >= timestamp'2024-01-08' AND ts < timestamp'2024-01-15')")
    return fx.event_bars(spark, sf).withColumns({c: F.when(~gone, F.col(c)) for c in ("high", "low", "close")})


def gap_ewm_sql(source: str, columns: dict[str, str], alpha: float, name: str) -> str:
    """Adds exponential means of expressions that are null on the same rows; a value after m rows weighs a / ((1-a)^m + a)."""
    x, keep = next(iter(columns.values())), repr(1 - alpha)
    means = ", ".join(f"exp(-aa) * sum(ww * ({e}) * exp(aa)) {W} AS {o}" for o, e in columns.items())
    return f"""{name}_i AS (SELECT *, row_number() {W} AS ii FROM {source}),
      {name}_m AS (SELECT *, ii - max(CASE WHEN ({x}) IS NOT NULL THEN ii END) OVER (PARTITION BY symbol ORDER BY ts
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mm FROM {name}_i),
      {name}_w AS (SELECT *, CASE WHEN mm IS NULL THEN 1 ELSE {alpha!r} / (pow({keep}, mm) + {alpha!r}) END AS ww,
        coalesce(sum(CASE WHEN ({x}) IS NOT NULL AND mm IS NOT NULL THEN ln(1 + {alpha!r} * pow({keep}, -mm)) END) {W}, 0) AS aa FROM {name}_m),
      {name} AS MATERIALIZED (SELECT * EXCLUDE (ii, mm, ww, aa), {means} FROM {name}_w)"""


@query("w2_ewm_gaps", f"""WITH {EVENT_SQL}, {GAP_SQL}, {gap_ewm_sql('gapped', {'y': 'close'}, 0.1, 'e')}
    SELECT symbol, ts, round(y, 4) AS close_ewm FROM e""")
def w2_gaps(spark, sf):
    return show(ind.ewm(gap_bars(spark, sf), "close", 0.1), "symbol", "ts", "close_ewm")


_GAP_TR = f"""{EVENT_SQL}, {GAP_SQL}, p AS (SELECT *, lag(close) {W} AS pc FROM gapped)"""


@query("w4_atr_gaps", f"""WITH {_GAP_TR}, {gap_ewm_sql('p', {'y': 'greatest(high - low, abs(high - pc), abs(low - pc))'}, 1 / 14, 'e')}
    SELECT symbol, ts, round(y, 4) AS "ATR" FROM e""")
def w4_gaps(spark, sf):
    return show(ind.atr_wilder(gap_bars(spark, sf)), "symbol", "ts", "ATR")


_GAP_RSI = gap_ewm_sql("c", {"gain": "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "loss": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END"}, 1 / 14, "e")


@query("w5_rsi_gaps", f"""WITH {_GAP_TR}, c AS (SELECT *, close - pc AS d, count(*) OVER (PARTITION BY symbol) AS n FROM p), {_GAP_RSI}
    SELECT symbol, ts, CASE WHEN n >= 42 THEN round(100 - 100 / (1 + gain / nullif(loss, 0)), 4) END AS "RSI" FROM e""")
def w5_gaps(spark, sf):
    return show(ind.rsi_wilder(gap_bars(spark, sf)), "symbol", "ts", "RSI")


@query("w6_rsi_ratio", f"""WITH {EVENT_SQL}, {atr_sql('bars')}, {rsi_sql('tr')} SELECT symbol, ts,
    CASE WHEN t >= 14 THEN round(100 * gain / nullif(gain + loss, 0), 4) END AS "RSI_14" FROM rsi_g""")
def w6(spark, sf):
    return show(ind.rsi_ratio(fx.event_bars(spark, sf)), "symbol", "ts", "RSI_14")


def pct_sql(bars: str = "bars") -> str:
    return f"""days AS (SELECT symbol, CAST({ET_TS} AS DATE) AS day, last(close ORDER BY ts) AS dc FROM {bars} GROUP BY 1, 2),
      pct AS (SELECT symbol, day, 100.0 * (dc / lag(dc) OVER d - 1) AS pct FROM days
        WINDOW d AS (PARTITION BY symbol ORDER BY day)),
      pct2 AS (SELECT *, lag(pct) OVER (PARTITION BY symbol ORDER BY day) AS prior FROM pct),
      dbars AS MATERIALIZED (SELECT b.*, p.pct AS daily_pct, p.prior FROM {bars} b JOIN pct2 p
        ON b.symbol = p.symbol AND CAST({et('b.ts')} AS DATE) = p.day)"""


@query("w7_daily_percent_change", f"WITH {EVENT_SQL}, {pct_sql()} SELECT symbol, ts, round(daily_pct, 4) AS daily_pct FROM dbars")
def w7(spark, sf):
    return show(ind.daily_percent_change(fx.event_bars(spark, sf)), "symbol", "ts", "daily_pct")


@query("w7b_daily_percent_change_causal",
       f"WITH {EVENT_SQL}, {pct_sql()} SELECT symbol, ts, round(prior, 4) AS daily_pct FROM dbars")
def w7b(spark, sf):
    return show(ind.daily_percent_change(fx.event_bars(spark, sf), causal=True), "symbol", "ts", "daily_pct")


def hot_sql(level: float = 5) -> str:
    return f"""hot AS MATERIALIZED (SELECT *, coalesce(daily_pct > {level} AND lag(daily_pct, 1) {W} > {level}
    AND lag(daily_pct, 2) {W} > {level}, false) AS hot FROM dbars)"""


@query("w8_hot_mask", f"WITH {EVENT_SQL}, {pct_sql()}, {hot_sql()} SELECT symbol, ts, hot FROM hot")
def w8(spark, sf):
    return show(ind.hot_mask(fx.event_bars(spark, sf)), "symbol", "ts", "hot")


@query("w9_prev", f"""WITH {EVENT_SQL} SELECT symbol, ts, round(lag(close) {W}, 4) AS close_prev,
    round(lag(low) {W}, 4) AS low_prev FROM bars""")
def w9(spark, sf):
    return show(ind.prev(fx.event_bars(spark, sf), ["close", "low"]), "symbol", "ts", "close_prev", "low_prev")
