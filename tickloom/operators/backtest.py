"""Signals to trades to performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.rounding import round_array_style, round_exact
from tickloom.operators.quality import normalize_signals
from tickloom.plans.blocks import (
    BEFORE, BLOCK, DEFAULT, SO_FAR, SPLIT, Blocks, BlockSize, over, split_blocks,
)
from tickloom.schema import require_columns, series_keys, time_columns
from tickloom.sources.scratch import materialize


def signal_counts(df: DataFrame) -> DataFrame:
    return normalize_signals(df).groupBy(*series_keys(df)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("signal") == "BUY").alias("buys"),
        F.count_if(F.col("signal") == "SELL").alias("sells"))


def recent_signals(df: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` signals of each series.

    ``row_number <= n`` runs once per source partition before the shuffle (Spark's window group
    limit), so a hot series sends at most ``n`` rows per task.
    """
    latest = Window.partitionBy(*series_keys(df)).orderBy(*map(F.desc, time_columns(df)))
    return (
        normalize_signals(df).filter(F.col("signal").isNotNull())
        .withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= n).drop("_rank")
    )


def signal_points(df: DataFrame) -> DataFrame:
    """Marker rows for a price chart."""
    return (normalize_signals(df).filter(F.col("signal").isin("BUY", "SELL"))
            .select(*series_keys(df), "ts", "close", "signal"))


def _numbered(df: DataFrame, size: BlockSize) -> tuple[DataFrame, list[str]]:
    """Valid signal rows with ``trade``: how many closing sells came before the row.

    A sell closes when a buy of non-zero cost came since the sell before it. Inside a block both
    are running counts; across blocks only the number of closing sells and whether such a buy is
    pending matter, which one row per block carries.
    """
    require_columns(df, ["ts", "close", "quantity"], "signal frame")
    keys = series_keys(df)
    rows = normalize_signals(df).filter(
        F.col("signal").isin("BUY", "SELL") & F.col("close").isNotNull() & (F.col("quantity") > 0)
    ).select(*keys, *time_columns(df), "close", "quantity", "signal")
    # Signals are few next to bars: store them once rather than run the strategy for every pass.
    rows = materialize(rows, "signals")
    blocks = split_blocks(rows, 0, size, keys)
    part = blocks.part

    def local(b):
        b = b.selectExpr("*", f"""count_if(signal = 'BUY' AND close * quantity <> 0)
            {over(part, frame=SO_FAR)} AS _priced""")
        b = b.selectExpr(
            "*", f"count_if(signal = 'SELL') {over(part, frame=BEFORE)} AS _sells",
            f"signal = 'SELL' AND _priced > coalesce(max(CASE WHEN signal = 'SELL' THEN _priced END) "
            f"{over(part, frame=BEFORE)}, 0) AS _closes")
        return b.selectExpr("*", f"count_if(_closes) {over(part, frame=BEFORE)} AS _done")

    b = local(blocks.frame)
    if not blocks.split:
        return b.selectExpr(*rows.columns, "_closes AS closes", "_done AS trade"), keys
    b = b.join(_block_trades(blocks, local(blocks.frame.filter(SPLIT))), part, "left")
    return b.selectExpr(
        *rows.columns,
        "_closes OR (signal = 'SELL' AND _sells = 0 AND coalesce(_pending, false)) AS closes",
        "coalesce(_closed, 0) + _done + CASE WHEN _sells > 0 THEN coalesce(_late, 0) ELSE 0 END AS trade"), keys


def _block_trades(blocks: Blocks, local: DataFrame) -> DataFrame:
    """Per block: closing sells before it, whether a priced buy is pending at its start, and
    whether that makes its first sell a closing one."""
    line = [*blocks.keys, SPLIT]
    ends = local.groupBy(*blocks.part).agg(
        F.expr("count_if(signal = 'SELL') AS sells"), F.expr("max(_priced) AS priced"),
        F.expr("max(CASE WHEN signal = 'SELL' THEN _priced END) AS mark"),
        F.expr("count_if(_closes) AS closes"),
        F.expr("coalesce(bool_or(_sells = 0 AND _closes), false) AS first_closes"))
    ends = ends.selectExpr("*", f"coalesce(sum(priced) {over(line, BLOCK, BEFORE)}, 0) AS _base")
    ends = ends.selectExpr(
        "*", f"_base > coalesce(max(_base + mark) {over(line, BLOCK, BEFORE)}, 0) AS _pending")
    ends = ends.selectExpr("*", "int(_pending AND sells > 0 AND NOT first_closes) AS _late")
    return ends.selectExpr(
        *blocks.part, "_pending", "_late",
        f"coalesce(sum(closes + _late) {over(line, BLOCK, BEFORE)}, 0) AS _closed")


def _positions(df: DataFrame, size: BlockSize) -> tuple[DataFrame, list[str]]:
    rows, keys = _numbered(df, size)
    buy = F.col("signal") == "BUY"
    grouped = rows.filter(buy | F.col("closes")).groupBy(*keys, "trade").agg(
        F.min(F.when(buy, F.col("ts"))).alias("entry_time"),
        F.max(F.when(F.col("closes"), F.col("ts"))).alias("exit_time"),
        F.max(F.when(F.col("closes"), F.col("close"))).alias("_exit"),
        F.sum(F.when(buy, F.col("quantity"))).alias("_shares"),
        F.sum(F.when(buy, F.col("close") * F.col("quantity"))).alias("_cost"),
        F.count(F.when(buy, 1)).alias("number_of_buys"))
    return grouped, keys


def pair_trades(df: DataFrame, decimals: int | None = 2, size: BlockSize = DEFAULT) -> DataFrame:
    """One row per full exit. Buys add up; a sell closes all of them, whatever its own quantity.

    Money is rounded to ``decimals``; None leaves it unrounded.
    """
    grouped, keys = _positions(df, size)
    value = F.col("_shares") * F.col("_exit")
    profit = value - F.col("_cost")
    amount = (lambda c: c) if decimals is None else (lambda c: round_exact(c, decimals))
    return grouped.filter(F.col("exit_time").isNotNull()).select(
        *keys, "entry_time", "exit_time",
        amount(F.col("_cost") / F.col("_shares")).alias("avg_entry_price"),
        amount(F.col("_exit")).alias("exit_price"),
        F.col("_shares").cast("bigint").alias("total_shares"),
        amount(F.col("_cost")).alias("total_cost"),
        amount(value).alias("exit_value"),
        amount(profit).alias("profit"),
        amount(F.try_divide(profit, F.col("_cost")) * 100.0).alias("profit_pct"),
        "number_of_buys")


def open_positions(df: DataFrame, size: BlockSize = DEFAULT) -> DataFrame:
    """Buys that no sell has closed, summed per series."""
    grouped, keys = _positions(df, size)
    return grouped.filter(F.col("exit_time").isNull()).select(
        *keys, "entry_time", F.col("_shares").alias("open_shares"),
        F.col("_cost").alias("open_cost"), F.col("number_of_buys").alias("open_buys"))


def performance_summary(trades: DataFrame, decimals: int | None = 2) -> DataFrame:
    """One row of metrics per series, from the trade columns as they stand."""
    require_columns(trades, ["profit", "profit_pct", "total_cost"], "trades")
    pct = F.col("profit_pct")
    m = trades.groupBy(*series_keys(trades)).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(pct > 0).alias("winning_trades"),
        F.count_if(pct <= 0).alias("losing_trades"),
        F.sum("profit").alias("total_profit"),
        F.avg("profit").alias("avg_profit"),
        F.max("profit").alias("max_win"),
        F.min("profit").alias("max_loss"),
        F.avg("total_cost").alias("avg_capital"),
        F.sum(pct).alias("total_return_pct"),
        F.avg(pct).alias("avg_return_pct"),
        F.coalesce(F.avg(F.when(pct > 0, pct)), F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(pct <= 0, pct)), F.lit(0.0)).alias("avg_loss_pct"),
        F.stddev_samp(pct).alias("std_pct"))
    m = m.withColumns({
        "win_rate_pct": 100.0 * F.col("winning_trades") / F.col("total_trades"),
        "win_loss_ratio": F.when(
            F.col("avg_loss_pct") != 0, F.abs(F.try_divide("avg_win_pct", "avg_loss_pct"))
        ).otherwise(F.lit(float("inf"))),
        "return_risk_ratio": F.when(
            F.col("std_pct") > 0, F.try_divide("avg_return_pct", "std_pct")).otherwise(F.lit(0.0))})
    if decimals is None:
        return m
    counts = {*series_keys(trades), "total_trades", "winning_trades", "losing_trades"}
    return m.withColumns({c: round_array_style(F.col(c), decimals)
                          for c in m.columns if c not in counts})


def analysis_status(df: DataFrame, size: BlockSize = DEFAULT) -> DataFrame:
    """Per series: how many trades there are, or why there are none."""
    keys = series_keys(df)
    if not {"close", "quantity"} <= set(df.columns) or not {"signal", "strategy"} & set(df.columns):
        return df.select(*keys).distinct().withColumns({
            "trades": F.lit(0).cast("bigint"), "open_buys": F.lit(0).cast("bigint"),
            "status": F.lit("no data or signal column missing")})
    counts = signal_counts(df)
    grouped, _ = _positions(df, size)
    closed = F.col("exit_time").isNotNull()
    state = grouped.groupBy(*keys).agg(
        F.count_if(closed).alias("trades"),
        F.coalesce(F.sum(F.when(~closed, F.col("number_of_buys"))), F.lit(0)).alias("open_buys"))
    joined = counts.join(state, keys, "left").na.fill(0, ["trades", "open_buys"])
    return joined.select(
        *keys, "trades", "open_buys",
        F.when(F.col("buys") + F.col("sells") == 0, "no signals")
        .when(F.col("trades") > 0, "ok")
        .when(F.col("open_buys") > 0, F.format_string("no complete trades (%d open)", "open_buys"))
        .otherwise("no complete trades").alias("status"))
