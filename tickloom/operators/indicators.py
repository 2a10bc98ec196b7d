"""Indicator columns on bars: moving averages, Wilder smoothing, daily change, previous rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.clock import local_date
from tickloom.operators.resample import daily_close
from tickloom.plans.blocks import DEFAULT, TIME, Blocks, BlockSize, in_blocks, over
from tickloom.plans.scans import Smooth, add_means, add_smooth
from tickloom.schema import require_columns, series_keys


PRICES = ("high", "low", "close")
TRUE_RANGE = "greatest(high - low, abs(high - _pc), abs(low - _pc))"
CHANGE = "(close - _pc)"
GAIN = f"CASE WHEN {CHANGE} IS NOT NULL THEN greatest({CHANGE}, 0D) END"
LOSS = f"CASE WHEN {CHANGE} IS NOT NULL THEN greatest(-{CHANGE}, 0D) END"
WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
SHORT = "double(raise_error('series is too short for RSI'))"


def add_indicators(df: DataFrame, blocks: Blocks, sma: dict[str, tuple[str, int]] | None = None,
                   ewm: dict[str, tuple[str, float]] | None = None, atr: dict[str, int] | None = None,
                   rsi: dict[str, int] | None = None, rsi_ratio: dict[str, int] | None = None,
                   strict: bool = False) -> DataFrame:
    """All asked-for columns on a blocked frame, sharing their windows; adds ``_run`` as well.

    Further windows over the result should order by ``RUN_ORDER`` to keep its sort.
    """
    part = blocks.part
    sma, ewm, atr, rsi, rsi_ratio = (d or {} for d in (sma, ewm, atr, rsi, rsi_ratio))
    smooth = {f"_ewm_{o}": Smooth(c, a) for o, (c, a) in ewm.items()}
    smooth |= {f"_atr_{o}": Smooth(TRUE_RANGE, 1.0 / n) for o, n in atr.items()}
    for o, n in {**rsi, **rsi_ratio}.items():
        smooth |= {f"_gain_{o}": Smooth(GAIN, 1.0 / n, CHANGE), f"_loss_{o}": Smooth(LOSS, 1.0 / n, CHANGE)}

    before = [] if not (atr or rsi or rsi_ratio) else [f"lag(close) {over(part)} AS _pc"]
    rows = [f"count(*) {over(part, frame=WHOLE)} AS _rows"] if rsi else []
    df = df.selectExpr("*", f"row_number() {over(part)} - 1 AS _i", *before, *rows)
    if sma:
        df = add_means(df, part, sma)
    if smooth:
        df = add_smooth(df, blocks, smooth, {"_changes": CHANGE} if rsi_ratio else {})
    too_short = SHORT if strict else "NULL"
    df = df.selectExpr(
        "*", *[f"_ewm_{o} AS {o}" for o in ewm], *[f"_atr_{o} AS {o}" for o in atr],
        *[f"""CASE WHEN _rows < {3 * n} THEN {too_short}
            ELSE 100D - 100D / (1D + _gain_{o} / nullif(_loss_{o}, 0D)) END AS {o}""" for o, n in rsi.items()],
        *[f"""CASE WHEN _changes >= {n} THEN 100D * _gain_{o} / nullif(_gain_{o} + _loss_{o}, 0D) END AS {o}"""
          for o, n in rsi_ratio.items()])
    return df.drop("_i", "_pc", *smooth, "_rows", "_changes")


def add_true_range(df: DataFrame, blocks: Blocks, out: str = "true_range"):
    df = df.selectExpr("*", f"lag(close) {over(blocks.part)} AS _pc")
    return df.selectExpr("*", f"{TRUE_RANGE} AS {out}").drop("_pc")


def add_prev(df: DataFrame, blocks: Blocks, columns: dict[str, str], n: int = 1, order: str = TIME):
    """Previous-row values: output name -> column."""
    return df.selectExpr("*", *[f"lag({c}, {n}) {over(blocks.part, order)} AS {o}" for o, c in columns.items()])


def hot_sql(threshold: float, part, order: str = TIME, pct: str = "daily_pct") -> str:
    w, level = over(part, order), f"{float(threshold)!r}D"
    return f"coalesce({pct} > {level} AND lag({pct}, 1) {w} > {level} AND lag({pct}, 2) {w} > {level}, false)"


def rsi_halo(period: int) -> int:
    """Rows before a block that show it is no short series; smoothing itself needs one, for the change."""
    return 3 * period + 2


# Public forms: bars in, bars plus columns out.

def _indicator(df: DataFrame, halo: int, size: BlockSize, check, **wanted) -> DataFrame:
    require_columns(df, ["symbol", "ts", *check])
    return in_blocks(df, halo, lambda f, b: add_indicators(f, b, **wanted).drop("_run"), size, check)


def sma(df: DataFrame, length: int, col: str = "close", size: BlockSize = DEFAULT) -> DataFrame:
    """Mean of the last ``length`` rows as ``SMA{length}``; null until that many rows exist."""
    return _indicator(df, length - 1, size, [col], sma={f"SMA{length}": (col, length)})


def ewm(df: DataFrame, col: str, alpha: float, out: str | None = None,
        size: BlockSize = DEFAULT) -> DataFrame:
    """Exponential mean of ``col``, seeded at its first value."""
    return _indicator(df, 1, size, [col], ewm={out or f"{col}_ewm": (col, alpha)})


def true_range(df: DataFrame, size: BlockSize = DEFAULT) -> DataFrame:
    require_columns(df, ["symbol", "ts", *PRICES])
    return in_blocks(df, 1, add_true_range, size)


def atr_wilder(df: DataFrame, period: int = 14, size: BlockSize = DEFAULT) -> DataFrame:
    return _indicator(df, 2, size, PRICES, atr={"ATR": period})


def rsi_wilder(df: DataFrame, period: int = 14, strict: bool = False,
               size: BlockSize = DEFAULT) -> DataFrame:
    """RSI by Wilder smoothing; null where there was no loss, and for series under 3 periods.

    ``strict`` fails the job on a short series instead.
    """
    return _indicator(df, rsi_halo(period), size, ["close"], rsi={"RSI": period}, strict=strict)


def rsi_ratio(df: DataFrame, length: int = 14, size: BlockSize = DEFAULT) -> DataFrame:
    """RSI as 100*g/(g+l): 100 when there was no loss, null for the first ``length`` rows."""
    return _indicator(df, rsi_halo(length), size, ["close"], rsi_ratio={f"RSI_{length}": length})


def daily_percent_change(bars: DataFrame, causal: bool = False, out: str = "daily_pct") -> DataFrame:
    """Percent change of the day's last close, on every bar of that day.

    A day's own bars see its final close (look-ahead); ``causal`` gives the previous day's change.
    """
    require_columns(bars, ["symbol", "ts", "close"])
    keys = series_keys(bars)
    by_day = Window.partitionBy(*keys).orderBy("_day")
    known = F.last("daily_close", ignorenulls=True).over(
        by_day.rowsBetween(Window.unboundedPreceding, 0))
    days = (
        daily_close(bars, day="_day")
        .withColumn("_known", known)
        .withColumn("_pct", 100.0 * (F.try_divide(F.col("_known"), F.lag("_known").over(by_day)) - 1.0))
    )
    if causal:
        days = days.withColumn("_pct", F.lag("_pct").over(by_day))
    return (
        bars.withColumn("_day", local_date("ts"))
        .join(days.select(*keys, "_day", F.col("_pct").alias(out)), [*keys, "_day"], "left")
        .drop("_day")
    )


def hot_mask(bars: DataFrame, threshold: float = 5.0, size: BlockSize = DEFAULT) -> DataFrame:
    """True where the daily change exceeded ``threshold`` on this bar and the two bars before."""
    return in_blocks(
        daily_percent_change(bars), 2,
        lambda f, b: f.selectExpr("*", f"{hot_sql(threshold, b.part)} AS hot"), size)


def prev(df: DataFrame, cols, n: int = 1, size: BlockSize = DEFAULT) -> DataFrame:
    """Previous-row copies of ``cols`` as ``{col}_prev``."""
    require_columns(df, ["symbol", "ts", *cols])
    return in_blocks(
        df, n, lambda f, b: add_prev(f, b, {f"{c}_prev": c for c in cols}, n), size)
