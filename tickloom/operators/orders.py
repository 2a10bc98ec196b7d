"""Signals to order rows, position snapshots and registry tables. Nothing here sends an order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.clock import instant
from tickloom.functions.rounding import round_price
from tickloom.operators.quality import fill_defaults, normalize_signals
from tickloom.schema import require_columns
from tickloom.sources.scratch import materialize

SELL_EXPIRY_MINUTES = 1440
MINUTE = 60_000_000


def _plus_minutes(ts, minutes) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + minutes.cast("bigint") * F.lit(MINUTE))


def signals_to_act_on(candles: DataFrame, bars: DataFrame, strategies: DataFrame,
                      fire: str = "minute") -> DataFrame:
    """Signals of the newest candle at each firing bar.

    ``fire="minute"``: a bar fires when minute + 1 is a multiple of the time frame, so time frames
    above 60 never fire. ``fire="bucket"``: the candle's last minute fires. Only candles with a
    signal are expanded to their possible firing minutes; those few rows meet the bars in an
    equi-join, so the bars need no shuffle while the signals fit a broadcast. The signals are those of the
    candles as given: where the time frame does not divide 60 a firing bar may lie inside its candle, and
    ``streaming.live.fired_signals`` judges the candle as far as it has come by then.
    """
    require_columns(candles, ["strategy_id", "symbol", "ts", "close", "signal", "quantity"], "candles")
    frames = strategies.select(F.col("id").alias("strategy_id"), F.col("time_frame").alias("_frame"))
    marked = (
        normalize_signals(candles).filter(F.col("signal").isNotNull())
        .select("strategy_id", "symbol", F.col("ts").alias("candle_ts"), "close", "signal", "quantity")
        .join(frames, "strategy_id")
    )
    last = F.col("_frame") - 1
    if fire == "minute":
        minutes = F.filter(
            F.transform(F.sequence(F.lit(0), last), lambda i: _plus_minutes(F.col("candle_ts"), i)),
            lambda t: F.pmod(F.minute(t) + 1, F.col("_frame")) == 0)
    elif fire == "bucket":
        minutes = F.array(_plus_minutes(F.col("candle_ts"), last))
    else:
        raise ValueError(f"fire must be 'minute' or 'bucket', got {fire!r}")
    due = marked.withColumn("_minute", F.explode(minutes))
    seen = bars.select("symbol", F.date_trunc("minute", "ts").alias("_minute"), F.col("ts").alias("_ts"))
    columns = ["strategy_id", "symbol", "candle_ts", "signal", "quantity", "close"]
    return (
        seen.join(due, ["symbol", "_minute"]).groupBy(*columns, "_minute")
        .agg(F.max("_ts").alias("fired_at"))
        .select("strategy_id", "symbol", "candle_ts", "fired_at", "signal", "quantity", "close")
    )


def _price_text(price) -> Column:
    plain = price.cast("decimal(28,4)").cast("string")
    return F.regexp_replace(plain, r"(\.\d+?)0*$", "$1")


def order_intents(signals: DataFrame, strategies: DataFrame, as_of=None) -> DataFrame:
    """One order row per signal, with its JSON body; ``reasons`` is empty for an acceptable order."""
    require_columns(signals, ["strategy_id", "symbol", "signal", "quantity", "close"], "signals")
    when = instant(as_of) if as_of is not None else F.col("fired_at")
    terms = strategies.select(
        F.col("id").alias("strategy_id"), F.upper("order_type").alias("_kind"),
        F.col("time_frame").alias("_frame"))
    side = F.upper("signal")
    base = (
        signals.join(terms, "strategy_id")
        .withColumns({
            "instruction": side, "symbol": F.upper("symbol"),
            "price": F.when(F.col("_kind") == "LIMIT", round_price(F.col("close"))).otherwise(F.lit(0.0)),
            "expiry_minutes": F.when(side == "SELL", SELL_EXPIRY_MINUTES).otherwise(F.col("_frame")),
            "decided_at": when})
        .withColumn("order_type", F.when(F.col("price") == 0, "MARKET").otherwise("LIMIT"))
    )
    cancel = F.when(F.col("expiry_minutes") > 0, F.date_format(
        _plus_minutes(F.col("decided_at"), F.col("expiry_minutes")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    leg = F.struct(
        F.col("instruction").alias("instruction"), F.col("quantity").alias("quantity"),
        F.struct(F.col("symbol").alias("symbol"), F.lit("EQUITY").alias("assetType")).alias("instrument"))
    body = F.struct(
        F.lit("NORMAL").alias("session"), F.lit("DAY").alias("duration"),
        F.col("order_type").alias("orderType"), F.lit("SINGLE").alias("orderStrategyType"),
        F.array(leg).alias("orderLegCollection"),
        F.when(F.col("price") > 0, _price_text(F.col("price"))).alias("price"),
        cancel.alias("cancelTime"))
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.col("symbol"), F.lit("")) == "", F.lit("symbol missing")),
        F.when(~(F.coalesce(F.col("quantity"), F.lit(0.0)) > 0), F.lit("quantity not positive")),
        F.when(~F.col("instruction").isin("BUY", "SELL"), F.lit("instruction not allowed")),
        F.when(F.col("price").isNull(), F.lit("limit price missing"))))
    return base.select(
        "strategy_id", "symbol", "instruction", "quantity", "price", "order_type", "expiry_minutes",
        "decided_at", F.to_json(body).alias("body"), reasons.alias("reasons"))


def reconcile_sells(sell_signals: DataFrame, positions: DataFrame, order_status: DataFrame) -> DataFrame:
    """What to do with each open position of a strategy that signalled SELL.

    FILLED with shares: sell them. FILLED without: nothing. Any other status: cancel the order.
    No known status: skip.
    """
    require_columns(sell_signals, ["strategy_id", "symbol", "price"], "sell signals")
    # One reconciliation per strategy, at its first sell; later ones find no position.
    first = F.struct("decided_at", "symbol", "price") if "decided_at" in sell_signals.columns \
        else F.struct("symbol", "price")
    sells = (sell_signals.groupBy("strategy_id").agg(F.min(first).alias("_s"))
             .select("strategy_id", "_s.symbol", "_s.price"))
    status = order_status.select("order_id", "status", "filled_quantity")
    filled = F.col("status") == "FILLED"
    shares = F.coalesce("filled_quantity", F.lit(0.0))
    action = (F.when(F.col("status").isNull(), "SKIP").when(filled & (shares > 0), "SELL")
              .when(filled, "NONE").otherwise("CANCEL"))
    sold = F.col("action") == "SELL"
    return (
        positions.select("strategy_id", "order_id").join(sells, "strategy_id")
        .join(status, "order_id", "left").withColumn("action", action)
        .select("strategy_id", "order_id", "symbol", "action",
                F.when(sold, shares).alias("quantity"), F.when(sold, F.col("price")).alias("price"),
                F.when(sold, F.lit(SELL_EXPIRY_MINUTES)).alias("expiry_minutes"))
    )


def apply_fills(positions: DataFrame, buys: DataFrame, sells: DataFrame) -> DataFrame:
    """Next position snapshot: buys are added, a sell removes every position its strategy held.

    A buy decided after the strategy's last sell of the batch stays. Where ``buys`` has ``reasons``, rejected
    orders open nothing. The store assigns ``id``.
    """
    require_columns(buys, ["strategy_id", "order_id", "quantity", "price", "decided_at"], "buys")
    if "reasons" in buys.columns:
        buys = buys.filter(F.size("reasons") == 0)
    last_sell = sells.groupBy("strategy_id").agg(F.max("decided_at").alias("_sold"))
    kept = positions.join(last_sell, "strategy_id", "left_anti")
    opened = (
        buys.join(last_sell, "strategy_id", "left")
        .filter(F.col("_sold").isNull() | (F.col("decided_at") > F.col("_sold")))
        .select(F.lit(None).cast("bigint").alias("id"), "strategy_id", "order_id", "quantity",
                round_price(F.col("price")).alias("entry_price"), F.col("decided_at").alias("opened_at"))
    )
    return kept.unionByName(opened)


def order_ids(positions: DataFrame, strategy_ids: DataFrame) -> DataFrame:
    return positions.join(strategy_ids, "strategy_id", "left_semi").select("strategy_id", "order_id")


def _named(strategies: DataFrame) -> DataFrame:
    return strategies.select(F.col("id").alias("strategy_id"), F.col("name").alias("strategy_name"))


def positions_with_strategy(positions: DataFrame, strategies: DataFrame) -> DataFrame:
    return positions.join(_named(strategies), "strategy_id")


def recent_trade_history(history: DataFrame, strategies: DataFrame, n: int = 50,
                         then_by=("id",)) -> DataFrame:
    """The latest ``n`` executions with their strategy's name."""
    return history.join(_named(strategies), "strategy_id").orderBy(F.desc("date"), *then_by).limit(n)


def list_strategies(strategies: DataFrame) -> DataFrame:
    return strategies.select("id", "name", "symbol", "time_frame", "lookback_days", "active")


def _with_ids(strategies: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` with the ids that ``match_name`` means at each change's ``seq``.

    A change by name may rename or delete what a later one names. The earliest such change is right after one
    round, the next after two, so rounds go on until the ids no longer change.
    """
    by_id, by_name = changes.filter(F.col("id").isNotNull()), changes.filter(F.col("id").isNull()).drop("id")
    name = F.when(F.col("op") != "DELETE", F.col("name")) if "name" in changes.columns else F.lit(None).cast("string")
    renames = (F.col("op") == "DELETE") | name.isNotNull()
    begun = strategies.select("id", F.lit(None).cast("bigint").alias("_since"), F.col("name").alias("match_name"))

    def resolved(log):
        borne = begun.unionByName(log.filter(renames).select("id", F.col("seq").alias("_since"), name.alias("match_name")))
        until = F.lead("_since").over(Window.partitionBy("id").orderBy(F.col("_since").asc_nulls_first()))
        borne = borne.withColumn("_until", until).filter(F.col("match_name").isNotNull())
        inside = (F.col("_since").isNull() | (F.col("seq") > F.col("_since"))) & (
            F.col("_until").isNull() | (F.col("seq") <= F.col("_until")))
        return by_name.join(borne, "match_name").filter(inside).select(*changes.columns)

    found = resolved(by_id)
    if not by_name.filter(renames).isEmpty():
        mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "seq").cast("decimal(38,0)"))).first())
        found, before = materialize(found, "named"), None
        while (now := mark(found)) != before:
            found, before = materialize(resolved(by_id.unionByName(found)), "named"), now
    return by_id.unionByName(found)


class Registry(NamedTuple):
    strategies: DataFrame
    positions: DataFrame | None
    history: DataFrame | None


def apply_registry_changes(strategies: DataFrame, changes: DataFrame, as_of,
                           positions: DataFrame | None = None,
                           history: DataFrame | None = None) -> Registry:
    """Next registry snapshot after a log of INSERT / UPDATE / DELETE rows.

    A change row has ``seq``, ``op``, ``id`` or (for updates and deletes) ``match_name``, and any of
    the table's columns; null means not given. Changes act in the order of ``seq``, which no two share:
    per id the latest given value of each column wins, a delete ends all before it, an update needs a
    row to act on, and a name means the rows that bear it at that point. Inserts get the column
    defaults, updates set ``updated_at``, and deletes take the strategy's positions and history along.
    """
    require_columns(changes, ["seq", "op", "id"], "changes")
    if "match_name" not in changes.columns:
        changes = changes.withColumn("match_name", F.lit(None).cast("string"))
    changes = changes.withColumn("seq", F.col("seq").cast("bigint"))
    fields = [c for c in strategies.columns if c not in ("id", "updated_at")]
    given = [c for c in fields if c in changes.columns]
    op = lambda kind: F.col("op") == kind
    log = _with_ids(strategies, changes)
    ends = log.groupBy("id").agg(F.max(F.when(op("DELETE"), F.col("seq"))).alias("_deleted")).join(
        strategies.select("id", F.lit(True).alias("_old")), "id", "left")
    live = log.join(ends, "id").filter(F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted")))
    inserted = live.filter(op("INSERT")).groupBy("id").agg(F.min("seq").alias("_inserted"))
    stays = F.col("_old").isNotNull() & F.col("_deleted").isNull()
    latest = live.join(inserted, "id", "left").filter(stays | (F.col("seq") >= F.col("_inserted"))).groupBy("id").agg(
        F.bool_or(op("UPDATE")).alias("_changed"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_to_{c}") for c in given])
    gone = ends.filter(F.col("_deleted").isNotNull()).select("id")
    next_rows = strategies.join(gone, "id", "left_anti").join(latest, "id", "full").withColumns({
        **{c: F.coalesce(f"_to_{c}", c) for c in given},
        "updated_at": F.when(F.coalesce("_changed", F.lit(False)), instant(as_of)).otherwise(F.col("updated_at"))})
    table = fill_defaults(next_rows.select(*strategies.columns), "day_trading_strategies", as_of)
    gone = gone.select(F.col("id").alias("strategy_id"))

    def cascade(df):
        return None if df is None else df.join(gone, "strategy_id", "left_anti").select(*df.columns)

    return Registry(table, cascade(positions), cascade(history))


def trades_to_history(trades: DataFrame) -> DataFrame:
    """Two execution rows per paired trade: the buy at its average price, the sell at its exit."""
    require_columns(trades, ["strategy_id", "entry_time", "exit_time"], "trades")
    side = lambda name, price, date: F.struct(
        F.lit(name).alias("side"), F.col(price).alias("price"), F.col(date).alias("date"))
    legs = F.array(side("BUY", "avg_entry_price", "entry_time"), side("SELL", "exit_price", "exit_time"))
    return trades.withColumn("_leg", F.explode(legs)).select(
        F.lit(None).cast("bigint").alias("id"), "strategy_id",
        F.col("total_shares").cast("double").alias("quantity"), "_leg.price", "_leg.side", "_leg.date"
    ).filter(F.col("quantity") > 0)


def orders_to_history(orders: DataFrame) -> DataFrame:
    """Execution rows of acceptable orders."""
    return orders.filter(F.size("reasons") == 0).select(
        F.lit(None).cast("bigint").alias("id"), "strategy_id", "quantity", "price",
        F.col("instruction").alias("side"), F.col("decided_at").alias("date"))
