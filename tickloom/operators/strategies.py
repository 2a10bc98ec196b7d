"""Strategies: bars in, bars plus ``signal`` and ``quantity`` out."""

from __future__ import annotations

import copy
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.clock import clock_seconds, second_of_day
from tickloom.operators.indicators import (
    PRICES, add_indicators, add_prev, daily_percent_change, hot_sql, rsi_halo,
)
from tickloom.plans.blocks import BLOCK, DEFAULT, OWN, SPLIT, BlockSize, over, split_blocks
from tickloom.plans.positions import position_signals
from tickloom.plans.scans import RUN_ORDER, toggle_signals
from tickloom.schema import BAR_COLUMNS, require_columns, series_keys, time_columns
from tickloom.sources.scratch import materialize


def sma_cross(df: DataFrame, position_size: float = 150, length: int = 200,
              whole_shares: bool = False, size: BlockSize = DEFAULT) -> DataFrame:
    """BUY when the close crosses above its mean, SELL when it crosses below."""
    require_columns(df, ["symbol", "ts", "close"])
    mean = f"SMA{length}"
    blocks = split_blocks(df, length, size, check=["close"])
    b = add_indicators(blocks.frame, blocks, sma={mean: ("close", length)})
    b = add_prev(b, blocks, {"_close": "close", "_mean": mean}, order=RUN_ORDER)
    b = b.selectExpr("*", f"""CASE WHEN _close < _mean AND close > {mean} THEN 'BUY'
        WHEN _close > _mean AND close < {mean} THEN 'SELL' END AS signal""").drop("_close", "_mean", "_run")
    shares = f"try_divide({float(position_size)!r}D, close)"
    return with_quantity(blocks.finish(b), f"double(floor({shares}))" if whole_shares else shares)


def with_quantity(df: DataFrame, amount) -> DataFrame:
    """``amount`` on rows with a signal, 0 elsewhere."""
    return df.withColumn("quantity", F.expr(f"CASE WHEN signal IS NOT NULL THEN {amount} ELSE 0D END"))


def sma_rsi_reversal(df: DataFrame, short: int = 200, long: int = 400, rsi_len: int = 14,
                     entry_rsi: float = 40, exit_rsi: float = 55, shares: float = 1.0,
                     size: BlockSize = DEFAULT) -> DataFrame:
    """Enter on a weak RSI above the short mean; leave on a strong RSI or at the long mean."""
    require_columns(df, ["symbol", "ts", "low", "close"])
    blocks = split_blocks(df, max(short, long, rsi_halo(rsi_len)), size, check=["close"])
    rsi = f"RSI_{rsi_len}"

    def masks(b):
        b = add_indicators(b, blocks, rsi_ratio={rsi: rsi_len}, sma={
            f"SMA_{short}": ("close", short), f"FMA_{long}": ("close", long)})
        return b.selectExpr(
            "*", f"coalesce({rsi} < {entry_rsi} AND low > SMA_{short}, false) AS _entry",
            f"coalesce({rsi} > {exit_rsi}, false) OR coalesce(low <= FMA_{long}, false) AS _exit")

    out = toggle_signals(blocks, masks, RUN_ORDER).drop("_entry", "_exit", "_run")
    return with_quantity(blocks.finish(out), f"{float(shares)!r}D")


def runners_swing(df: DataFrame, threshold: float = 5.0, atr_len: int = 14, shares: float = 1.0,
                  size: BlockSize = DEFAULT) -> DataFrame:
    """Enter a three-bar hot run above a trailing level; leave on the level, a stop or a crash day."""
    require_columns(df, ["symbol", "ts", "high", "low", "close"])
    blocks = split_blocks(daily_percent_change(df), 3, size, check=PRICES)

    def rule(b):
        b = add_indicators(b, blocks, atr={"ATR": atr_len})
        b = b.selectExpr(
            "*", f"{hot_sql(threshold, blocks.part, RUN_ORDER)} AS hot",
            *[f"lag({c}) {over(blocks.part, RUN_ORDER)} AS {o}" for o, c in (("_close", "close"), ("_atr", "ATR"))])
        level = "(_close - _atr * 2.5D)"
        return b.selectExpr(
            "*", f"hot AND coalesce(low > {level}, false) AND close IS NOT NULL AS _entry",
            f"coalesce(low < {level}, false) OR coalesce(daily_pct < -10D, false) AS _forced",
            "close AS _low", "_atr * 1.5D AS _below", "double(NULL) AS _high", "double(NULL) AS _above").drop("_close", "_atr", "_run")

    out = position_signals(blocks, rule).drop("entry_price")
    return with_quantity(blocks.finish(out), f"{float(shares)!r}D")


def opening_bracket(df: DataFrame, pt: float = 5, stop: float = 0.9, window=("09:40", "09:50"),
                    rsi_jump: float = 10, notional: float = 300_000, shares: float = 1.0,
                    size: BlockSize = DEFAULT) -> DataFrame:
    """Enter on a bullish RSI jump with volume early in the session; leave at a target or stop that
    moves with the current ATR, or at 16:00."""
    require_columns(df, BAR_COLUMNS)
    blocks = split_blocks(df, rsi_halo(14) + 1, size, check=PRICES)
    opens, closes, four = (clock_seconds(t) for t in (*window, "16:00"))

    def rule(b):
        b = add_indicators(b, blocks, atr={"ATR": 14}, rsi={"RSI": 14})
        b = add_prev(b, blocks, {"RSI_prev": "RSI", "ATR_prev": "ATR", "close_prev": "close",
                                 "low_prev": "low"}, order=RUN_ORDER).drop("_run")
        b = b.withColumn("_clock", second_of_day(F.col("ts"))).selectExpr(
            "*", f"_clock >= {opens} AND _clock < {closes} AS in_buy_window",
            f"_clock >= {four} AS is_4pm_or_later",
            "coalesce(close > close_prev, false) AS is_bullish",
            f"coalesce(volume > try_divide({notional / 100!r}D, close) * 100, false) AS meets_volume_req",
            f"coalesce(RSI - RSI_prev > {float(rsi_jump)!r}D, false) AS meets_rsi_req").drop("_clock")
        return b.selectExpr(
            "*", "in_buy_window AND is_bullish AND meets_volume_req AND meets_rsi_req AS _entry",
            "is_4pm_or_later AS _forced", "low AS _low", f"ATR * {float(stop)!r}D AS _below",
            "high AS _high", f"ATR * {float(pt)!r}D AS _above")

    out = blocks.finish(position_signals(blocks, rule)).withColumnRenamed("entry_price", "EntryPrice")
    out = out.selectExpr("*", f"EntryPrice + ATR * {float(pt)!r}D AS HighATR",
                         f"EntryPrice - ATR * {float(stop)!r}D AS LowATR")
    return with_quantity(out, f"{float(shares)!r}D")


WHOLE = object()


def custom_strategy(df: DataFrame, fn: Callable, schema, look_back: int | None = None,
                    size: BlockSize = DEFAULT, state=WHOLE) -> DataFrame:
    """Run a user's pandas function on each series, rows in time order; its output keeps ``ts``.

    With ``state``, ``fn(block, state) -> (rows, state)`` is folded over the blocks of a series, ``size.rows`` rows
    at most, the first with a copy of ``state``. The same function serves series of any length, since no more
    than a block is held; blocks of one series follow each other in one task, as what they carry demands. With
    ``look_back``, ``fn(rows)`` whose value at a row depends on at most so many earlier rows runs on all blocks
    at once. With neither it sees whole series, and series longer than ``size.rows`` are refused.
    """
    if state is not WHOLE:
        return _folded(df, fn, schema, size, state)
    blocks = split_blocks(df, look_back or 0, size)
    if blocks.split and look_back is None:
        raise ValueError(f"a series has more than {size.rows} rows: give state, look_back or a larger size")

    def call(pdf):
        pdf = pdf.sort_values(time, na_position="first", ignore_index=True)
        if not blocks_split:
            return fn(pdf)
        out = fn(pdf.drop(columns=[SPLIT, BLOCK, OWN]))
        return out[out["ts"].isin(pdf.loc[pdf[OWN], "ts"])]

    blocks_split, time = blocks.split, time_columns(df)
    return blocks.frame.groupBy(*blocks.part).applyInPandas(call, schema)


def _folded(df: DataFrame, fn: Callable, schema, size: BlockSize, start) -> DataFrame:
    keys, rows = series_keys(df), size.rows

    def run(batches):
        held, count, now, state = [], 0, None, None

        def out():
            nonlocal held, count, state
            result, state = fn(pd.concat(held, ignore_index=True), state)
            held, count = [], 0
            return result

        for pdf in batches:
            marks = [tuple(None if pd.isna(v) else v for v in row) for row in pdf[keys].itertuples(index=False)]
            edges = [n for n in range(len(marks)) if n == 0 or marks[n] != marks[n - 1]] + [len(marks)]
            for begin, end in zip(edges, edges[1:]):
                if marks[begin] != now:
                    if held:
                        yield out()
                    now, state = marks[begin], copy.deepcopy(start)
                while begin < end:
                    part = pdf.iloc[begin:min(end, begin + rows - count)]
                    held.append(part)
                    count, begin = count + len(part), begin + len(part)
                    if count == rows:
                        yield out()
        if held:
            yield out()

    return df.repartition(*keys).sortWithinPartitions(*keys, *time_columns(df)).mapInPandas(run, schema)


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sma_cross": sma_cross,
    "sma_rsi_reversal": sma_rsi_reversal,
    "runners_swing": runners_swing,
    "opening_bracket": opening_bracket,
}


def run_strategies(candles: DataFrame, registry: dict[str, Callable] = STRATEGIES) -> DataFrame:
    """Apply to each strategy's candles the function registered under its name.

    Candles of an unregistered name give no rows; ``unknown_strategies`` lists them. The candles
    are stored once, by name, as every function reads its share more than once.
    """
    require_columns(candles, ["strategy_id", "name", *BAR_COLUMNS], "candles")
    candles = materialize(candles.filter(F.col("name").isin(*registry)), "candles", ["name"])
    results = [fn(candles.filter(F.col("name") == name)) for name, fn in registry.items()]
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def unknown_strategies(strategies: DataFrame, registry: dict[str, Callable] = STRATEGIES) -> DataFrame:
    return strategies.filter((F.col("active") == 1) & ~F.col("name").isin(*registry))
