"""Bars, registry and order tables derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.resample import ticks_to_bars
from tickloom.plans.blocks import running_sum
from tickloom.sources.scratch import materialize

NAMES = ["sma_cross", "sma_rsi_reversal", "runners_swing", "opening_bracket"]
FRAMES = [1, 5, 15, 30, 60]
EVENT_SYMBOLS = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.upper("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.col("value").alias("price"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("double") * 10000).alias("volume"))


def event_bars(spark, sf_dir) -> DataFrame:
    return ticks_to_bars(event_ticks(spark, sf_dir), 1, ("ts", "event_id"))


def walk_ticks(spark, sf_dir) -> DataFrame:
    step = (F.col("event_id") * 7919) % 2001 - 1000
    ticks = running_sum(event_ticks(spark, sf_dir).withColumn("_step", step), "_step", "_walk",
                        ["symbol"], ["ts", "event_id"])
    return ticks.withColumn("price", (F.col("_walk") + 100000) / 1000.0).drop("_step", "_walk")


def walk_bars(spark, sf_dir) -> DataFrame:
    return ticks_to_bars(walk_ticks(spark, sf_dir), 1, ("ts", "event_id"))


def ship_bars(spark, sf_dir, by: str = "flag") -> DataFrame:
    symbol = (F.concat("l_returnflag", "l_linestatus") if by == "flag"
              else F.col("l_suppkey").cast("string"))
    # One number per line item (line numbers stay below 8), so the aggregation can hash.
    order = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        symbol.alias("symbol"), F.col("l_shipdate").cast("date").alias("day"), order.alias("o"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity")
    return rows.groupBy("symbol", "day").agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", "o").alias("close"),
        F.sum("l_quantity").alias("volume"),
    ).select("symbol", (F.col("day").cast("timestamp") + F.expr("interval 16 hours")).alias("ts"),
             "open", "high", "low", "close", "volume")


def stored(bars: DataFrame) -> DataFrame:
    """Bars as a table of their own, as strategies read them more than once."""
    return materialize(bars, "bars")


def strategies(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    pick = lambda items, i: F.element_at(F.array(*map(F.lit, items)), (i + 1).cast("int"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "nation").select(
        k.cast("bigint").alias("id"), pick(NAMES, k % 4).alias("name"),
        pick(FRAMES, k % 5).alias("time_frame"),
        F.lower(pick(EVENT_SYMBOLS, F.floor(k / 5))).alias("symbol"),
        F.when(k % 2 == 0, "market").otherwise("limit").alias("order_type"),
        (k % 10 + 1).cast("int").alias("lookback_days"), (k % 2).cast("int").alias("extended_hours"),
        F.when(k % 7 == 0, 0).otherwise(1).alias("active"),
        at.alias("created_at"), at.alias("updated_at"))


def positions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("strategy_id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        (F.col("o_orderkey") % 10 + 1).cast("double").alias("quantity"),
        F.col("o_totalprice").alias("entry_price"), F.col("o_orderdate").cast("timestamp").alias("opened_at"))


def order_status(spark, sf_dir) -> DataFrame:
    filled = F.col("o_orderstatus") == "F"
    quantity = F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(
        (F.col("o_orderkey") % 10 + 1).cast("double"))
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 13 != 0).select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.when(filled, "FILLED").when(F.col("o_orderstatus") == "O", "WORKING")
        .otherwise("CANCELED").alias("status"),
        F.when(filled, quantity).otherwise(0.0).alias("filled_quantity"),
        F.col("o_orderdate").cast("timestamp").alias("entered_time"))


def trade_history(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.col("l_suppkey") % 25).alias("strategy_id"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_linestatus") == "F", "SELL").otherwise("BUY").alias("side"),
        F.col("l_shipdate").cast("timestamp").alias("date"))


def news(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("published_utc"),
        F.array(F.upper("event_type")).alias("tickers"), F.col("props").alias("title"))


def news_payloads(spark, sf_dir, size: int = 100) -> DataFrame:
    """News as payload rows of at most ``size`` items, by ranges of the unique event id."""
    item = F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("published_utc"),
                    F.array(F.upper("event_type")).alias("tickers"), F.col("props").alias("title"))
    return (table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / size).alias("page"))
            .agg(F.collect_list(item).alias("results")).select("results"))


# ---- SQL counterparts: each is a list of common table expressions ending in the named one ----

_BAR_SQL = """(SELECT symbol, date_trunc('minute', ts) AS ts,
    first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM {ticks} GROUP BY 1, 2)"""

TICKS_SQL = """ticks AS (SELECT event_id, upper(event_type) AS symbol, ts, value AS price,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 10000 AS volume FROM events)"""
EVENT_SQL = TICKS_SQL + ", bars AS MATERIALIZED " + _BAR_SQL.format(ticks="ticks")
WALK_SQL = TICKS_SQL + """, walked AS (SELECT event_id, symbol, ts, volume,
    (sum((event_id * 7919) % 2001 - 1000) OVER (PARTITION BY symbol ORDER BY ts, event_id) + 100000) / 1000.0
    AS price FROM ticks), bars AS MATERIALIZED """ + _BAR_SQL.format(ticks="walked")
SHIP_SQL = """bars AS MATERIALIZED (SELECT l_returnflag || l_linestatus AS symbol,
    CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL 16 HOUR AS ts,
    first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS close,
    sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""


def _pick(items, index):
    return f"([{', '.join(repr(i) for i in items)}])[CAST({index} AS INTEGER) + 1]"


STRATEGIES_SQL = f"""strategies AS (SELECT CAST(n_nationkey AS BIGINT) AS id,
    {_pick(NAMES, 'n_nationkey % 4')} AS name, {_pick(FRAMES, 'n_nationkey % 5')} AS time_frame,
    lower({_pick(EVENT_SYMBOLS, 'n_nationkey // 5')}) AS symbol,
    CASE WHEN n_nationkey % 2 = 0 THEN 'market' ELSE 'limit' END AS order_type,
    n_nationkey % 10 + 1 AS lookback_days, n_nationkey % 2 AS extended_hours,
    CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE 1 END AS active FROM nation),
  active_s AS (SELECT id, name, time_frame, upper(symbol) AS symbol, upper(order_type) AS order_type,
    lookback_days, extended_hours FROM strategies WHERE active = 1)"""
POSITIONS_SQL = """positions AS (SELECT o_orderkey AS id, o_custkey % 25 AS strategy_id,
    CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderkey % 10 + 1 AS DOUBLE) AS quantity,
    o_totalprice AS entry_price, o_orderdate AS opened_at FROM orders)"""
STATUS_SQL = """order_status AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
    CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'WORKING' ELSE 'CANCELED' END AS status,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 10 + 1 AS DOUBLE)
         ELSE 0.0 END AS filled_quantity, o_orderdate AS entered_time
    FROM orders WHERE o_orderkey % 13 <> 0)"""
HISTORY_SQL = """history AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 25 AS strategy_id,
    l_quantity AS quantity, l_extendedprice / l_quantity AS price,
    CASE WHEN l_linestatus = 'F' THEN 'SELL' ELSE 'BUY' END AS side, l_shipdate AS date FROM lineitem)"""


# ---- Output shaping: timestamps without zone, rounded doubles ----

def show(df: DataFrame, *columns: str, decimals: int = 4, fine: tuple[str, ...] = ()) -> DataFrame:
    """Chosen columns, doubles rounded and timestamps without zone, for comparison with SQL.

    ``fine`` columns keep 8 decimals: quotients of two-decimal prices by small counts often lie
    halfway between two 4-decimal values.
    """
    out = df.select(*columns) if columns else df
    kind = dict(out.dtypes)
    return out.select(*[
        F.round(c, 8 if c in fine else decimals).alias(c) if kind[c] == "double"
        else F.col(c).cast("timestamp_ntz").alias(c) if kind[c] == "timestamp"
        else F.col(c) for c in out.columns])


ET = "timezone('America/New_York', timezone('UTC', {}))"


def et(expr: str) -> str:
    return ET.format(expr)
