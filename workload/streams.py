"""Streaming queries: each runs to the end of its input and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.sources import days
from tickloom.sources.scratch import materialize, scratch_path
from tickloom.streaming import live
from tickloom.streaming import sources as ss
from workload import fixtures as fx
from workload.bars import OHLCV, RTH, grid_sql
from workload.fixtures import EVENT_SQL, STRATEGIES_SQL, et, show
from workload.orders import round_price_sql
from workload.registry import query
from workload.signals import CROSSES, named_cross


def run_to_table(stream, name: str):
    """Drain a stream into parquet and read the result."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    drain(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


def drain(stream, out: str, checkpoint: str):
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def bar_stream(spark, bars, name: str):
    """The bars as a file stream."""
    stored = materialize(bars, name)
    return spark.readStream.schema(stored.schema).parquet(stored.inputFiles()[0].rsplit("/", 1)[0])


@query("s4_stream_chart_bars", f"""WITH {EVENT_SQL} SELECT symbol, ts, round(open, 4) AS open, round(high, 4) AS high,
    CASE WHEN minute(ts) % 9 = 0 THEN 0 ELSE round(low, 4) END AS low, round(close, 4) AS close,
    round(volume, 4) AS volume FROM bars WHERE minute(ts) % 10 <> 0""")
def s4(spark, sf):
    minute = F.minute("ts")
    item = F.struct(
        F.when(minute % 10 != 0, F.lower("symbol")).otherwise("").alias("key"),
        F.unix_millis("ts").alias("CHART_TIME_MILLIS"), F.col("open").alias("OPEN_PRICE"),
        F.col("high").alias("HIGH_PRICE"), F.when(minute % 9 != 0, F.col("low")).alias("LOW_PRICE"),
        F.col("close").alias("CLOSE_PRICE"), F.col("volume").cast("bigint").alias("VOLUME"))
    messages = fx.event_bars(spark, sf).groupBy("ts").agg(F.collect_list(item).alias("content"))
    path = scratch_path(spark, "chart")
    messages.select(F.to_json(F.struct("content")).alias("value")).write.text(path)
    return show(run_to_table(ss.stream_chart_bars(spark, path, missing_as_zero=True), "chart-bars"))


@query("s5_stream_agg_events", f"WITH {EVENT_SQL} SELECT {OHLCV} FROM bars WHERE minute(ts) % 4 <> 0")
def s5(spark, sf):
    item = F.struct(
        F.when(F.minute("ts") % 4 != 0, "A").otherwise("T").alias("ev"), F.col("symbol").alias("sym"),
        F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
        F.col("close").alias("c"), F.col("volume").alias("v"), F.unix_millis("ts").alias("s"))
    messages = fx.event_bars(spark, sf).groupBy("ts").agg(F.collect_list(item).alias("items"))
    path = scratch_path(spark, "agg-events")
    messages.select(F.to_json("items").alias("value")).write.text(path)
    return show(run_to_table(ss.stream_agg_events(spark, path), "agg-bars"))


START = "2024-01-15 10:07:00"
LATCH_SQL = f"""joined AS (SELECT s.id AS strategy_id, s.time_frame, b.* FROM bars b JOIN active_s s USING (symbol)),
  latch AS (SELECT strategy_id, min(ts) AS latch FROM joined WHERE ts >= TIMESTAMP '{START}'
    AND minute({et('ts')}) % time_frame = 0 GROUP BY 1)"""


@query("t1_alignment_latch", f"""WITH {EVENT_SQL}, {STRATEGIES_SQL}, {LATCH_SQL}
    SELECT strategy_id, symbol, time_frame, ts, round(close, 4) AS close FROM joined LEFT JOIN latch USING (strategy_id)
    WHERE ts < TIMESTAMP '{START}' OR ts >= latch""")
def t1(spark, sf):
    kept = live.alignment_latch(fx.event_bars(spark, sf), fx.strategies(spark, sf), START)
    return show(kept, "strategy_id", "symbol", "time_frame", "ts", "close")


@query("t1_stream_alignment_latch", f"""WITH {EVENT_SQL}, {STRATEGIES_SQL}, {LATCH_SQL}
    SELECT strategy_id, symbol, time_frame, ts, round(close, 4) AS close FROM joined JOIN latch USING (strategy_id)
    WHERE ts >= latch""")
def t1_stream(spark, sf):
    later = fx.event_bars(spark, sf).filter(F.col("ts") >= F.lit(START).cast("timestamp"))
    state, out, checkpoint = (scratch_path(spark, n) for n in ("latch-state", "latch-out", "latch-checkpoint"))
    live.stream_alignment_latch(bar_stream(spark, later, "latch-in"), fx.strategies(spark, sf), state, out, checkpoint,
                                {"availableNow": True}).awaitTermination()
    return show(live.latched_bars(spark, out), "strategy_id", "symbol", "time_frame", "ts", "close")


@query("t1_stream_latch_batches", f"""WITH {EVENT_SQL}, {STRATEGIES_SQL}, {LATCH_SQL}
    SELECT strategy_id, symbol, time_frame, ts, round(close, 4) AS close FROM joined JOIN latch USING (strategy_id)
    WHERE ts >= latch""")
def t1_batches(spark, sf):
    """The same bars in ten micro-batches, the first an hour long."""
    bars, chosen = materialize(fx.event_bars(spark, sf), "latch-batches-in"), fx.strategies(spark, sf)
    state, out = (scratch_path(spark, n) for n in ("latch-batches-state", "latch-batches-out"))
    borders = [START, "2024-01-15 11:07:00", *(f"2024-01-{d} 10:07:00" for d in range(16, 24)), "2999-01-01"]
    for number, (since, until) in enumerate(zip(borders, borders[1:])):
        part = bars.filter((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp")))
        live.latch_batch(part, number, chosen, state, out)
    return show(live.latched_bars(spark, out), "strategy_id", "symbol", "time_frame", "ts", "close")


TEN = "make_timestamp(epoch_us(ts) // 600000000 * 600000000)"
CANDLE_SQL = f"""SELECT symbol, {TEN} AS ts, round(first(open ORDER BY ts), 4) AS open, round(max(high), 4) AS high,
    round(min(low), 4) AS low, round(last(close ORDER BY ts), 4) AS close, round(sum(volume), 4) AS volume"""


@query("t2_stream_resample", f"""WITH {EVENT_SQL} {CANDLE_SQL} FROM bars WHERE {TEN} + INTERVAL 10 MINUTE
    <= (SELECT max(ts) FROM bars) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def t2(spark, sf):
    candles = live.stream_resample(bar_stream(spark, fx.event_bars(spark, sf), "candles-in"), 10)
    return show(run_to_table(candles, "candles"))


# One slice of the bars per firing bar; what a strategy decides there is the newest candle's signal.
SLICES = f"""{EVENT_SQL}, {STRATEGIES_SQL},
  due AS (SELECT s.*, b.ts AS as_of FROM bars b JOIN active_s s ON b.symbol = s.symbol
    WHERE (minute(b.ts) + 1) % s.time_frame = 0 AND s.name IN ('sma_cross', 'runners_swing')),
  joined AS (SELECT d.id AS strategy_id, d.name, d.time_frame, d.order_type, d.as_of, b.* FROM bars b JOIN due d
    ON b.symbol = d.symbol AND b.ts <= d.as_of AND b.ts >= d.as_of - to_days(d.lookback_days)
    WHERE d.extended_hours = 1 OR {RTH.replace('ts)', 'b.ts)')}),
  counted AS (SELECT *, min(ts) OVER (PARTITION BY strategy_id, as_of) AS f,
    count(*) OVER (PARTITION BY strategy_id, as_of) AS n FROM joined),
  candles AS MATERIALIZED (SELECT strategy_id, name, symbol, time_frame, order_type, as_of, {grid_sql('time_frame', 'f')} AS ts,
    last(close ORDER BY ts) AS close FROM counted WHERE n >= time_frame GROUP BY ALL),
  {named_cross('sma_cross', 20, 150, 'first_rule', 'strategy_id, as_of')},
  {named_cross('runners_swing', 5, 1000, 'second_rule', 'strategy_id, as_of')},
  signals AS (SELECT * FROM first_rule UNION ALL SELECT * FROM second_rule)
  SELECT strategy_id, symbol, signal AS instruction, round(quantity, 4) AS quantity,
    round(CASE WHEN order_type = 'LIMIT' THEN {round_price_sql('close')} ELSE 0 END, 4) AS price, as_of AS decided_at
  FROM signals WHERE signal IS NOT NULL AND ts + to_minutes(time_frame) > as_of"""
ORDERS = ("strategy_id", "symbol", "instruction", "quantity", "price", "decided_at")


@query("t3_stream_signals", f"WITH {SLICES}")
def t3(spark, sf):
    """All bars in one micro-batch."""
    store, out, checkpoint = (scratch_path(spark, n) for n in ("live-store", "live-out", "live-checkpoint"))
    bars = bar_stream(spark, fx.event_bars(spark, sf), "live-in")
    live.stream_signals(bars, fx.strategies(spark, sf), store, out, checkpoint, registry=CROSSES,
                        trigger={"availableNow": True}).awaitTermination()
    return show(live.fired_orders(spark, out), *ORDERS)


@query("t3_stream_signals_backlog", f"WITH {SLICES}")
def t3_backlog(spark, sf):
    """The same bars in three micro-batches, ten days each."""
    store, out = (scratch_path(spark, n) for n in ("backlog-store", "backlog-out"))
    bars, chosen = materialize(fx.event_bars(spark, sf), "backlog-in"), fx.strategies(spark, sf)
    borders = ["1970-01-01", "2024-01-11", "2024-01-21", "2999-01-01"]
    for number, (since, until) in enumerate(zip(borders, borders[1:])):
        part = bars.filter((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp")))
        live.process_batch(part, number, chosen, store, out, CROSSES)
    return show(live.fired_orders(spark, out), *ORDERS)


@query("t3_compacted_store", f"""WITH {EVENT_SQL} SELECT symbol, ts, round(open, 4) AS open, round(high, 4) AS high,
    round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume, CAST(minute(ts) % 10 AS INTEGER) AS batch FROM bars""")
def t3_compacted(spark, sf):
    """Ten batches that all reach into every day; days closed after the fifth and again after the ninth."""
    path, bars = scratch_path(spark, "compacted-store"), materialize(fx.event_bars(spark, sf), "compacted-in")
    for number in range(10):
        days.write_days(bars.filter(F.minute("ts") % 10 == number), "ts", path, number)
        if number == 4:
            days.compact_days(spark, path, "2024-01-15", number)
        if number == 8:
            days.compact_days(spark, path, "2024-01-25", number)
    return show(days.read_days(spark, path), "symbol", "ts", "open", "high", "low", "close", "volume", "batch")


LATE = "minute(ts) % 7 = 0"


@query("t4_late_rows", f"""WITH {EVENT_SQL}, w AS (SELECT max(ts) FILTER (NOT {LATE}) - INTERVAL 10 MINUTE AS first_mark,
    max(ts) - INTERVAL 10 MINUTE AS last_mark FROM bars)
    {CANDLE_SQL} FROM bars, w WHERE (NOT {LATE} OR {TEN} + INTERVAL 10 MINUTE > first_mark)
    AND {TEN} + INTERVAL 10 MINUTE <= last_mark GROUP BY 1, 2""")
def t4(spark, sf):
    """Two runs of one query: bars that arrive in the second, behind the watermark, are dropped."""
    bars = fx.event_bars(spark, sf)
    late = F.minute("ts") % 7 == 0
    path, out, checkpoint = (scratch_path(spark, n) for n in ("late-in", "late-out", "late-checkpoint"))
    for part in (bars.filter(~late), bars.filter(late)):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(bars.schema).parquet(path)
        candles = live.stream_resample(stream, 10)
        drain(candles, out, checkpoint)
    return show(spark.read.schema(candles.schema).parquet(out))


@query("t5_stream_news", f"""SELECT {et("date_trunc('millisecond', ts)")} AS published_local,
    upper(event_type) AS ticker, props AS title FROM events WHERE minute({et('ts')}) IN (0, 30)""")
def t5(spark, sf):
    path = scratch_path(spark, "news")
    fx.news_payloads(spark, sf).write.json(path)
    messages = spark.readStream.schema(
        "results array<struct<published_utc:string, tickers:array<string>, title:string>>").json(path)
    hits = run_to_table(live.stream_news(messages), "half-hour")
    return show(hits.select("published_local", F.element_at("tickers", 1).alias("ticker"), "title"))
