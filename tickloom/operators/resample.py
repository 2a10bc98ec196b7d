"""Candles: 1-minute bars or raw ticks to N-minute bars, per symbol or per strategy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.clock import (
    clock_seconds, even_bucket, grid_bucket, instant, local_date, local_minute,
    second_of_day,
)
from tickloom.operators.quality import active_strategies
from tickloom.schema import BAR_COLUMNS, PRICE_COLUMNS, require_columns, series_keys, time_columns, time_key


def _ohlcv(order) -> list[Column]:
    """Open and close skip nulls; an all-null volume sums to 0."""
    at = lambda c: F.when(F.col(c).isNotNull(), order)
    return [
        F.min_by("open", at("open")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", at("close")).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
    ]


def _check_minutes(minutes) -> None:
    if not isinstance(minutes, int) or isinstance(minutes, bool):
        raise TypeError(f"minutes must be an integer, got {minutes!r}")
    if minutes <= 0:
        raise ValueError(f"minutes must be positive, got {minutes}")


def resample_ohlcv(bars: DataFrame, minutes: int, complete_only: bool = False) -> DataFrame:
    """N-minute candles labelled by their left edge.

    Candles without a full OHLC are dropped, partial ones are kept unless ``complete_only``; a
    series with fewer rows than ``minutes`` gives none.
    """
    _check_minutes(minutes)
    require_columns(bars, BAR_COLUMNS, "bars")
    keys = series_keys(bars)
    cells = _cells(bars, keys, math.gcd(minutes, 60))
    if minutes > 1:
        cells = _regrouped(cells, keys, F.lit(minutes), joins=60 % minutes != 0)
    candles = cells.dropna(subset=PRICE_COLUMNS)
    if complete_only:
        candles = candles.filter(F.col("_n") == minutes)
    return candles.select(*keys, F.col("_cell").alias("ts"), *PRICE_COLUMNS, _volume())


# Candles come in two levels. Every grid of ``minutes`` begins at a local midnight, a full hour in absolute time, so its
# edges lie on the grid of gcd(minutes, 60) minutes. Cells of that grid need neither the series' first time nor its number
# of rows; they are combined before the shuffle and carry both. Windows over the cells of a series are then bounded by
# the calendar, however many rows a cell holds, and group by the series as the candles do.

def _volume() -> Column:
    return F.coalesce("volume", F.lit(0.0)).alias("volume")


def _cells(bars: DataFrame, keys, grid, *parts: Column) -> DataFrame:
    """Candles of ``grid`` minutes, apart by ``parts``, with their rows, first time and the times of open and close."""
    at = lambda c: F.when(F.col(c).isNotNull(), time_key(bars))
    return bars.groupBy(*keys, even_bucket(F.col("ts"), grid).alias("_cell"), *parts).agg(
        F.min_by("open", at("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", at("close")).alias("close"), F.sum("volume").alias("volume"),
        F.min(at("open")).alias("_opened"), F.max(at("close")).alias("_closed"),
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_first"))


def _regrouped(cells: DataFrame, keys, minutes: Column, joins: bool = True) -> DataFrame:
    """Cells of series with at least ``minutes`` rows, joined to the candles of the series' own grid if ``joins``."""
    series = Window.partitionBy(*keys)
    cells = cells.withColumn("_rows", F.sum("_n").over(series))
    if joins:
        cells = cells.withColumn("_begin", F.min("_first").over(series))
    cells = cells.filter(F.col("_rows") >= minutes)
    if not joins:
        return cells
    return cells.groupBy(*keys, grid_bucket(F.col("_cell"), minutes, F.col("_begin")).alias("_cell")).agg(
        F.min_by("open", "_opened").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "_closed").alias("close"), F.sum("volume").alias("volume"), F.sum("_n").alias("_n"))


def daily_close(bars: DataFrame, day: str = "day") -> DataFrame:
    """Last non-null close of each market-local calendar day."""
    return (
        bars.groupBy(*series_keys(bars), local_date("ts").alias(day))
        .agg(F.max_by("close", F.when(F.col("close").isNotNull(), time_key(bars))).alias("daily_close"))
    )


def ticks_to_bars(ticks: DataFrame, minutes: int = 1, order=("ts",)) -> DataFrame:
    """Bars from (symbol, ts, price, volume) ticks; ``order`` breaks ties between equal times."""
    _check_minutes(minutes)
    require_columns(ticks, ["symbol", "ts", "price", "volume"], "ticks")
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    prices = ticks.select(
        "symbol", "ts", *[c for c in order if c != "ts"],
        *[F.col("price").alias(c) for c in PRICE_COLUMNS], "volume")
    return (
        prices.groupBy("symbol", even_bucket(F.col("ts"), minutes).alias("_bucket"))
        .agg(*_ohlcv(position))
        .withColumnRenamed("_bucket", "ts")
        .select(*BAR_COLUMNS)
    )


SPEC = ["symbol", "time_frame", "extended_hours", "lookback_days"]
DAY = 86_400_000_000


def _spec(strategies: DataFrame) -> list[str]:
    """What two strategies must share to share a slice."""
    return [*SPEC, *(c for c in ["as_of"] if c in strategies.columns)]


def _sliced(rows: DataFrame, specs: DataFrame, until, live_from, session_live: bool, inside: Column) -> tuple[DataFrame, Column]:
    """Rows joined with the settings that see them, and which of them wait for the latch."""
    rows, began = rows.join(specs, "symbol"), None
    if until is not None:
        began = F.unix_micros(until) - F.col("lookback_days").cast("bigint") * F.lit(DAY)
        rows = rows.filter((F.col("ts") <= until) & (F.unix_micros("ts") >= began))
    live = F.lit(False) if live_from is None else F.col("ts") >= instant(live_from)
    rows = rows.filter((F.col("extended_hours") == 1) | inside | (F.lit(False) if session_live else live))
    waits = live if began is None or live_from is None else live & (F.unix_micros(instant(live_from)) >= began)
    return rows, waits


def _until(spec: list[str], as_of) -> Column | None:
    return F.col("as_of") if "as_of" in spec else None if as_of is None else instant(as_of)


def _inside(start: str, end: str) -> Column:
    return second_of_day(F.col("ts")).between(clock_seconds(start), clock_seconds(end))


def _aligned_live(live_from) -> Column:
    return (F.col("ts") >= instant(live_from)) & (F.pmod(local_minute(F.col("ts")), F.col("time_frame")) == 0)


def strategy_bars(bars: DataFrame, strategies: DataFrame, as_of=None, live_from=None,
                  session_live: bool = True, start: str = "09:30", end: str = "16:00") -> DataFrame:
    """Each active strategy setting's own slice of the bars: its look-back and its session.

    Settings that several strategies share appear once. A column ``as_of`` of ``strategies`` gives each row its
    own end; without it and without ``as_of`` there is no look-back cut. With ``live_from``, live bars count
    from the first one aligned with the time frame, unless the look-back begins later, when that bar has
    long passed. Without ``session_live`` the session filter leaves live bars alone.
    """
    spec = _spec(strategies)
    specs = active_strategies(strategies).select(*spec).distinct()
    rows, waits = _sliced(bars.select(*BAR_COLUMNS, *time_columns(bars)[1:]), specs, _until(spec, as_of),
                          live_from, session_live, _inside(start, end))
    if live_from is not None:
        latch = rows.filter(_aligned_live(live_from)).groupBy(*spec).agg(F.min("ts").alias("_latch"))
        rows = rows.join(latch, spec, "left").filter(
            ~waits | (F.col("ts") >= F.col("_latch"))).drop("_latch")
    return rows


DIVISORS = [60, 30, 20, 15, 12, 10, 6, 5, 4, 3, 2, 1]


def _slice_cells(bars: DataFrame, specs: DataFrame, spec: list[str], as_of, live_from, start: str, end: str) -> DataFrame:
    """Cells of the finest grid that the settings of a symbol share; ``ts`` is their first time, ``inside`` their session.

    A cell lies on one side of every border of every slice: the session's, ``live_from``, and the time of day at which
    all look-backs begin. Its first time so answers for all its rows. Where every setting has its own end,
    the rows themselves are the cells.
    """
    if "as_of" in spec:
        at = lambda c: F.when(F.col(c).isNotNull(), time_key(bars))
        return bars.select(*BAR_COLUMNS, F.col("ts").alias("_cell"), at("open").alias("_opened"), at("close").alias("_closed"),
                           F.lit(1).cast("bigint").alias("_n"), F.col("ts").alias("_first"), _inside(start, end).alias("inside"))
    grids = specs.groupBy("symbol").agg(F.coalesce(
        *[F.when(F.max(F.pmod("time_frame", F.lit(d))) == 0, d) for d in DIVISORS]).alias("_grid"))
    parts = [_inside(start, end).alias("inside")]
    if as_of is not None:
        bars = bars.filter(F.col("ts") <= instant(as_of))
        parts.append((F.pmod(F.unix_micros("ts"), F.lit(DAY)) >= F.pmod(F.unix_micros(instant(as_of)), F.lit(DAY))).alias("_late"))
    if live_from is not None:
        parts.append((F.col("ts") >= instant(live_from)).alias("_live"))
    return _cells(bars.join(grids, "symbol"), ["symbol"], F.col("_grid"), *parts).withColumn("ts", F.col("_first"))


def resample_for_strategies(bars: DataFrame, strategies: DataFrame, as_of=None,
                            live_from=None, session_live: bool = True) -> DataFrame:
    """Candles for every active strategy; a time frame of 1 keeps the bars as they are.

    All coarser settings share one aggregation of the bars per symbol, whose cells, not the bars, are then dealt to the
    settings. The bars of settings of 1 minute are neither grouped nor shuffled.
    """
    require_columns(bars, BAR_COLUMNS, "bars")
    spec, hours = _spec(strategies), ("09:30", "16:00")
    bars = bars.select(*BAR_COLUMNS, *time_columns(bars)[1:])
    specs = active_strategies(strategies).select(*spec).distinct()
    coarse = specs.filter(F.col("time_frame") > 1)
    cells, waits = _sliced(_slice_cells(bars, coarse, spec, as_of, live_from, *hours), coarse, _until(spec, as_of),
                           live_from, session_live, F.col("inside"))
    if live_from is not None:
        latch = F.min(F.when(_aligned_live(live_from), F.col("ts"))).over(Window.partitionBy(*spec))
        cells = cells.withColumn("_latch", latch).filter(~waits | (F.col("ts") >= F.col("_latch")))
    candles = _regrouped(cells, spec, F.col("time_frame")).dropna(subset=PRICE_COLUMNS).select(
        *spec, F.col("_cell").alias("ts"), *PRICE_COLUMNS, _volume())
    # Every minute is aligned with a time frame of 1, so no live bar waits.
    rows, _ = _sliced(bars, specs.filter(F.col("time_frame") == 1), _until(spec, as_of), live_from, session_live, _inside(*hours))
    columns = [*spec, *time_columns(bars), *PRICE_COLUMNS, "volume"]
    if "seq" in columns:  # one candle per time, so none to tell apart
        candles = candles.withColumn("seq", F.lit(None).cast(bars.schema["seq"].dataType))
    every = candles.select(*columns).unionByName(rows.select(*columns))
    names = active_strategies(strategies).select(F.col("id").alias("strategy_id"), "name", *spec)
    return every.join(names, spec).select(
        "strategy_id", "name", "symbol", "time_frame", *time_columns(every), *PRICE_COLUMNS, "volume")
