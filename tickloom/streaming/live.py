"""Live processing: alignment latch, streaming candles, the signal loop, news."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.clock import instant, local_minute
from tickloom.operators.orders import MINUTE, order_intents
from tickloom.operators.quality import active_strategies, dedupe_bars, news_on_half_hour, normalize_signals
from tickloom.operators.resample import resample_for_strategies
from tickloom.operators.strategies import STRATEGIES, run_strategies
from tickloom.schema import BAR, BAR_COLUMNS, PRICE_COLUMNS, require_columns
from tickloom.sources.days import compact_days, newest_day, read_days, write_days
from tickloom.sources.payloads import news_items
from tickloom.sources.scratch import materialize


def _with_strategies(bars: DataFrame, strategies: DataFrame) -> DataFrame:
    terms = active_strategies(strategies).select(F.col("id").alias("strategy_id"), "symbol", "time_frame")
    return bars.select(*BAR_COLUMNS).join(terms, "symbol")


def _aligned():
    return F.pmod(local_minute(F.col("ts")), F.col("time_frame")) == 0


def alignment_latch(bars: DataFrame, strategies: DataFrame, start_ts) -> DataFrame:
    """Each strategy's usable bars: history before ``start_ts``, and live bars from the first one
    whose minute is a multiple of the strategy's time frame."""
    rows = _with_strategies(bars, strategies)
    start = instant(start_ts)
    latch = (rows.filter((F.col("ts") >= start) & _aligned())
             .groupBy("strategy_id").agg(F.min("ts").alias("_latch")))
    return (
        rows.join(latch, "strategy_id", "left")
        .filter((F.col("ts") < start) | (F.col("ts") >= F.col("_latch"))).drop("_latch")
    )


LATCHED = T.StructType([
    T.StructField("strategy_id", T.LongType()), T.StructField("symbol", T.StringType()), T.StructField("time_frame", T.IntegerType()),
    T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in (*PRICE_COLUMNS, "volume"))])
_LATCHES = "symbol string, time_frame int, latch timestamp"


def latched_bars(spark, out: str) -> DataFrame:
    """The bars that ``latch_batch`` has let through so far."""
    return spark.read.schema(LATCHED).parquet(out)


def latch_batch(batch: DataFrame, batch_id: int, strategies: DataFrame, state: str, out: str) -> None:
    """One micro-batch of ``alignment_latch`` on live bars: those from their setting's latch on go to ``out``.

    The latch of a setting, a symbol and time frame, is the least aligned time of the first batch that holds one. ``state`` keeps it
    as one row, written by that batch, so the bars themselves are neither grouped nor ordered: the minimum is combined
    before its shuffle, and bars meet latches and then names in joins on a few rows. Batches without a new latch
    write no state. A repeated batch replaces what it wrote.
    """
    spark = batch.sparkSession
    terms = active_strategies(strategies).select(F.col("id").alias("strategy_id"), "symbol", F.col("time_frame").cast("int").alias("time_frame"))
    bars, settings = batch.select(*BAR_COLUMNS), terms.select("symbol", "time_frame").distinct()
    known = _latches(spark, state, batch_id)
    waiting = settings.join(known, ["symbol", "time_frame"], "left_anti")
    fresh = materialize(bars.join(waiting, "symbol").filter(_aligned()).groupBy("symbol", "time_frame").agg(F.min("ts").alias("latch")), "latches")
    if not fresh.isEmpty():
        fresh.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
    latches = known.unionByName(fresh)
    kept = bars.join(latches, "symbol").filter(F.col("ts") >= F.col("latch")).join(terms, ["symbol", "time_frame"])
    kept.select(*[F.col(f.name).cast(f.dataType) for f in LATCHED]).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def _latches(spark, state: str, batch_id: int) -> DataFrame:
    """The latches that batches before ``batch_id`` have opened."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    names = [f.getPath().getName() for f in found]
    paths = [f"{state}/{n}" for n in names if int(n.removeprefix("batch=")) < batch_id]
    return spark.read.schema(_LATCHES).parquet(*paths) if paths else spark.createDataFrame([], _LATCHES)


def stream_alignment_latch(bars: DataFrame, strategies: DataFrame, state: str, out: str, checkpoint: str, trigger=None):
    """Start ``latch_batch`` on a stream of live bars; returns the running query."""
    def each(batch, batch_id):
        latch_batch(batch, batch_id, strategies, state, out)

    return (bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())


def stream_resample(bars: DataFrame, minutes: int, watermark: str = "10 minutes") -> DataFrame:
    """Tumbling candles; a candle is emitted once the watermark passes its end, later bars drop."""
    if 60 % minutes:
        raise ValueError("a streaming time frame must divide 60 minutes")
    require_columns(bars, BAR_COLUMNS, "bars")
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("ts"))
    return (
        bars.withWatermark("ts", watermark)
        .groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("_w"))
        .agg(F.min_by("open", at("open")).alias("open"), F.max("high").alias("high"),
             F.min("low").alias("low"), F.max_by("close", at("close")).alias("close"),
             F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
        .dropna(subset=PRICE_COLUMNS)
        .select("symbol", F.col("_w.start").alias("ts"), *PRICE_COLUMNS, "volume")
    )


def stored_bars(spark, store: str) -> DataFrame:
    """The bars the signal loop has stored so far."""
    found = read_days(spark, store)
    return spark.createDataFrame([], BAR) if found is None else found.drop("day", "batch")


ORDERS = ("strategy_id long, symbol string, instruction string, quantity double, price double, order_type string, "
          "expiry_minutes int, decided_at timestamp, body string, reasons array<string>, candle_ts timestamp")


def fired_orders(spark, out: str) -> DataFrame:
    """The orders the signal loop has written so far."""
    found = read_days(spark, out)
    none = spark.createDataFrame([], ORDERS)
    return none if found is None else found.select(*none.columns)


def firings(fresh: DataFrame, strategies: DataFrame) -> DataFrame:
    """The active strategies once per minute of ``fresh`` they fire on, with the firing bar's time as ``as_of``.

    A bar fires when its minute + 1 is a multiple of the time frame.
    """
    terms = active_strategies(strategies)
    return (
        fresh.select("symbol", "ts").join(terms, "symbol")
        .filter(F.pmod(F.minute("ts") + 1, F.col("time_frame")) == 0)
        .groupBy(*terms.columns, F.date_trunc("minute", "ts").alias("_minute"))
        .agg(F.max("ts").alias("as_of")).drop("_minute")
    )


def fired_signals(bars: DataFrame, fresh: DataFrame, strategies: DataFrame,
                  registry: dict[str, Callable] = STRATEGIES, live_from=None) -> DataFrame:
    """Signals of the newest candle at each firing bar of ``fresh``, as the strategy sees it then.

    Every firing has its own slice of ``bars``, from its look-back up to the firing bar, so the result does not
    depend on which bars arrive together, and a candle that is still open is judged as far as it
    has come. The work is the sum of the slices.
    """
    due = firings(fresh, strategies).filter(F.col("name").isin(*registry))
    due = materialize(due.withColumn("firing", F.monotonically_increasing_id()), "firings")
    candles = resample_for_strategies(bars, due.withColumn("id", F.col("firing")), live_from=live_from)
    signals = normalize_signals(run_strategies(candles, registry)).filter(F.col("signal").isNotNull()).select(
        F.col("strategy_id").alias("firing"), F.col("ts").alias("candle_ts"), "signal", "quantity", "close")
    ends = F.unix_micros("candle_ts") + F.col("time_frame").cast("bigint") * F.lit(MINUTE)
    return due.join(signals, "firing").filter(ends > F.unix_micros("as_of")).select(
        F.col("id").alias("strategy_id"), "symbol", "candle_ts", F.col("as_of").alias("fired_at"),
        "signal", "quantity", "close")


def process_batch(batch: DataFrame, batch_id: int, strategies: DataFrame, store: str, out: str,
                  registry: dict[str, Callable], dedupe: bool = True, live_from=None) -> None:
    """One micro-batch of the signal loop.

    Bars go to ``store``, then the look-back of the touched symbols is read back, and the signals that fire on
    this batch's bars go to ``out``. Both lie by market day, of the bar and of the candle, and batch number:
    a batch reads only the days it needs, and a repeated batch replaces its own output. A candle of a
    strategy that has fired before is not fired again.
    """
    spark = batch.sparkSession
    write_days(batch.select(*BAR_COLUMNS), "ts", store, batch_id)
    first = batch.agg(F.min("ts")).first()[0]
    days = active_strategies(strategies).agg(F.max("lookback_days")).first()[0]
    if first is None or days is None:
        return
    history = read_days(spark, store, _since(first - timedelta(days=int(days)))).filter(F.col("batch") <= batch_id)
    fresh = read_days(spark, store, _since(first)).filter(F.col("batch") == batch_id)
    bars = history.join(fresh.select("symbol").distinct(), "symbol", "left_semi").drop("day")
    if dedupe:
        bars = dedupe_bars(bars, arrival="batch")
    fired = materialize(fired_signals(bars, fresh, strategies, registry, live_from), "fired")
    orders = order_intents(fired, strategies).join(
        fired.select("strategy_id", "candle_ts", F.col("fired_at").alias("decided_at")),
        ["strategy_id", "decided_at"])
    done = read_days(spark, out, _since(first))
    if done is not None:
        done = done.filter(F.col("batch") < batch_id).select("strategy_id", "candle_ts")
        orders = orders.join(done, ["strategy_id", "candle_ts"], "left_anti")
    write_days(orders, "candle_ts", out, batch_id)


def _since(first) -> str:
    """The day two before ``first``, which covers any zone and a candle's length."""
    return str((first - timedelta(days=2)).date())


def compact_store(spark, store: str, out: str, upto: int) -> int:
    """Compact the days of bars and orders before the newest stored day; returns how many were rewritten."""
    newest = newest_day(spark, store)
    if newest is None:
        return 0
    return compact_days(spark, store, newest, upto) + compact_days(spark, out, newest, upto, ("symbol", "candle_ts"))


def stream_signals(bars: DataFrame, strategies: DataFrame, store: str, out: str, checkpoint: str,
                   registry: dict[str, Callable] = STRATEGIES, dedupe: bool = True, live_from=None,
                   trigger=None, compact_every: int | None = None):
    """Start the signal loop on a stream of bars; returns the running query.

    ``compact_every`` batches, the days before the newest stored one are compacted, but for the last batch, which may be repeated.
    """
    def each(batch, batch_id):
        process_batch(batch, batch_id, strategies, store, out, registry, dedupe, live_from)
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact_store(batch.sparkSession, store, out, batch_id - 1)

    return (bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())


def stream_news(messages: DataFrame, as_of=None, hours: int = 2) -> DataFrame:
    """Half-hour news of a stream of news payload rows."""
    return news_on_half_hour(news_items(messages), as_of, hours)
