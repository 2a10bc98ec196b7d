"""Row filters, numeric coercion, contract and constraint checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.clock import clock_seconds, instant, local, local_date, local_minute, second_of_day
from tickloom.schema import require_columns, series_keys

NUMBERS = ["open", "high", "low", "close", "volume"]


def coerce_numeric(df: DataFrame, cols: Sequence[str] = NUMBERS) -> DataFrame:
    """Columns as doubles; text that is no number and NaN become null."""
    require_columns(df, cols)
    number = lambda c: F.col(c).try_cast("double")
    return df.withColumns({c: F.when(~F.isnan(number(c)), number(c)) for c in cols})


def quality_report(df: DataFrame, cols: Sequence[str] = NUMBERS) -> DataFrame:
    """Nulls per series and column, as a count and as percent of rows."""
    require_columns(df, cols)
    keys = series_keys(df)
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return (
        counts.unpivot([*keys, "rows"], list(cols), "column", "nulls")
        .withColumn("null_pct", 100.0 * F.col("nulls") / F.col("rows"))
    )


def session_filter(bars: DataFrame, start: str = "09:30", end: str = "16:00") -> DataFrame:
    """Bars whose market-local time lies in [start, end], both ends included."""
    return bars.filter(
        second_of_day(F.col("ts")).between(clock_seconds(start), clock_seconds(end)))


def lookback(bars: DataFrame, as_of, days: int, delay_minutes: int = 0) -> DataFrame:
    """Bars in [as_of - delay - days, as_of - delay]; both bounds are literals and reach the scan.

    A column ``day`` of market-local dates, as the bar store keeps, is bounded too and prunes partitions.
    """
    until = instant(as_of) - F.make_dt_interval(mins=F.lit(delay_minutes))
    since = until - F.make_dt_interval(days=F.lit(days))
    kept = bars.filter(F.col("ts").between(since, until))
    return kept.filter(F.col("day").between(local_date(since), local_date(until))) if "day" in bars.columns else kept


def lookback_sessions(bars: DataFrame, as_of, n: int) -> DataFrame:
    """Bars of each series' last ``n`` market-local dates up to ``as_of``.

    A column ``day``, as the bar store keeps, stands for the date and prunes partitions.
    """
    keys = series_keys(bars)
    past = bars.filter(F.col("ts") <= instant(as_of))
    if "day" in bars.columns:
        past = past.filter(F.col("day") <= local_date(instant(as_of))).withColumn("_day", F.col("day"))
    else:
        past = past.withColumn("_day", local_date("ts"))
    latest = Window.partitionBy(*keys).orderBy(F.desc("_day"))
    days = (
        past.select(*keys, "_day").distinct()
        .withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= n)
    )
    return past.join(days, [*keys, "_day"], "left_semi").drop("_day")


def dedupe_bars(bars: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row per (series, ts): the latest arrival, or the largest row where no arrival is known."""
    keys = [*series_keys(bars), "ts"]
    rest = [c for c in bars.columns if c not in keys]
    row = F.struct(*rest)
    best = F.max_by(row, F.struct(arrival, *rest)) if arrival else F.max(row)
    return bars.groupBy(*keys).agg(best.alias("_row")).select(*[
        F.col(c) if c in keys else F.col(f"_row.{c}") for c in bars.columns])


def news_on_half_hour(news: DataFrame, as_of=None, hours: int = 2) -> DataFrame:
    """News whose market-local minute is 0 or 30, optionally of the last ``hours``; batch or stream."""
    if as_of is not None:
        since = instant(as_of) - F.make_dt_interval(hours=F.lit(hours))
        news = news.filter(F.col("published_utc") >= since)
    return (
        news.filter(local_minute(F.col("published_utc")).isin(0, 30))
        .select(local(F.col("published_utc")).cast("timestamp_ntz").alias("published_local"),
                "tickers", "title")
    )


def active_strategies(registry: DataFrame) -> DataFrame:
    """Active rows, with symbol and order type in upper case."""
    require_columns(registry, ["id", "symbol", "order_type", "active"], "registry")
    return registry.filter(F.col("active") == 1).withColumns(
        {"symbol": F.upper("symbol"), "order_type": F.upper("order_type")})


def symbols_to_track(registry: DataFrame) -> DataFrame:
    return active_strategies(registry).select("symbol").distinct()


def filled_orders_on_day(orders: DataFrame, day) -> DataFrame:
    """FILLED orders entered in [day 00:00 UTC, next day 00:00 UTC)."""
    start = F.lit(str(day)).cast("date").cast("timestamp")
    return orders.filter(
        (F.col("status") == "FILLED") & (F.col("entered_time") >= start)
        & (F.col("entered_time") < start + F.make_dt_interval(days=F.lit(1))))


SIGNAL_WORDS = ["BUY", "SELL", "buy", "sell"]


def validate_signals(df: DataFrame) -> DataFrame:
    """Contract check of a signal frame: schema now, rows as a count of violations per series."""
    require_columns(df, ["signal", "quantity"], "signal frame")
    if not isinstance(df.schema["quantity"].dataType, T.NumericType):
        raise TypeError("quantity must be numeric")
    bad = F.col("signal").isNotNull() & ~F.col("signal").isin(*SIGNAL_WORDS)
    return df.groupBy(*series_keys(df)).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad_signals"),
        F.count_if(F.col("quantity").isNull()).alias("null_quantities"))


def normalize_signals(df: DataFrame) -> DataFrame:
    """One shape for signal frames: ``signal`` in upper case, from ``signal`` or ``strategy``."""
    source = "signal" if "signal" in df.columns else "strategy"
    require_columns(df, [source], "signal frame")
    out = df.withColumn("signal", F.upper(F.trim(source)))
    if source == "strategy":
        out = out.drop("strategy")
    return out if "quantity" in out.columns else out.withColumn("quantity", F.lit(0.0))


def _defaults(table: str, now) -> dict:
    stamp = instant(now) if now is not None else F.current_timestamp()
    return {
        "day_trading_strategies": {
            "order_type": F.lit("MARKET"), "lookback_days": F.lit(3), "extended_hours": F.lit(1),
            "active": F.lit(1), "created_at": stamp, "updated_at": stamp},
        "active_positions": {"opened_at": stamp},
        "trade_history": {"date": stamp},
    }[table]


def fill_defaults(df: DataFrame, table: str, now=None) -> DataFrame:
    """Column defaults of a registry table, for absent columns and null values."""
    for name, value in _defaults(table, now).items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def _row_rules(table: str) -> dict:
    missing = lambda *cols: {f"{c} is null": F.col(c).isNull() for c in cols}
    return {
        "day_trading_strategies": lambda: {
            **missing("name", "time_frame", "symbol"),
            "order_type not allowed": ~F.col("order_type").isin("MARKET", "LIMIT"),
            "lookback_days out of range": ~F.col("lookback_days").between(1, 10),
            "extended_hours not 0/1": ~F.col("extended_hours").isin(0, 1),
            "active not 0/1": ~F.col("active").isin(0, 1)},
        "active_positions": lambda: {
            **missing("strategy_id", "order_id", "quantity", "entry_price"),
            "quantity not positive": F.col("quantity") <= 0,
            "entry_price negative": F.col("entry_price") < 0},
        "trade_history": lambda: {
            **missing("strategy_id", "quantity", "price", "side"),
            "quantity not positive": F.col("quantity") <= 0,
            "price negative": F.col("price") < 0,
            "side not allowed": ~F.col("side").isin("BUY", "SELL")},
    }[table]()


def check_constraints(df: DataFrame, table: str, strategies: DataFrame | None = None,
                      now=None) -> DataFrame:
    """Fill defaults and add ``reasons``: the constraints a row breaks, empty for a valid row.

    ``strategies`` turns on the foreign-key check of positions and history. Order ids that occur
    more than once are found by a count with map-side combine and joined back.
    """
    df = fill_defaults(df, table, now)
    rules = dict(_row_rules(table))
    if table == "active_positions":
        repeated = (df.filter(F.col("order_id").isNotNull()).groupBy("order_id")
                    .agg(F.count(F.lit(1)).alias("_uses")).filter(F.col("_uses") > 1))
        df = df.join(repeated, "order_id", "left")
        rules["order_id not unique"] = F.col("_uses").isNotNull()
    if strategies is not None and table != "day_trading_strategies":
        known = strategies.select(F.col("id").alias("strategy_id"), F.lit(True).alias("_known"))
        df = df.join(known, "strategy_id", "left")
        rules["strategy unknown"] = F.col("strategy_id").isNotNull() & F.col("_known").isNull()
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(why)) for why, broken in rules.items()]))
    return df.withColumn("reasons", reasons).drop("_uses", "_known")


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)
