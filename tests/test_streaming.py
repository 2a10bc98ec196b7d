"""Streams against the batch operators on the same bars."""

import uuid
from datetime import datetime
from functools import partial

import pandas as pd
import pytest
from conftest import random_bars, to_spark
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.operators import resample as rs
from tickloom.operators import strategies as st
from tickloom.sources import days
from tickloom.streaming import live
from tickloom.streaming.sources import agg_event_bars, chart_bars

RULES = {"sma_cross": partial(st.sma_cross, length=4)}


def registry(spark):
    return spark.createDataFrame(
        [(1, "sma_cross", 5, "hot", "LIMIT", 10, 1, 1, None, None), (2, "sma_cross", 15, "hot", "MARKET", 2, 1, 1, None, None),
         (3, "missing", 5, "b", "MARKET", 10, 1, 1, None, None)], schema.STRATEGIES)


def parts(spark, n):
    pdf = random_bars({"HOT": 900, "B": 90}, seed=8, gap_minutes=1).sort_values("ts")
    step = -(-len(pdf) // n)
    return [to_spark(spark, pdf.iloc[i:i + step]) for i in range(0, len(pdf), step)], to_spark(spark, pdf)


def feed(spark, tmp_path, frames, run):
    path = str(tmp_path / f"in-{uuid.uuid4().hex}")
    for frame in frames:
        frame.write.mode("append").parquet(path)
        run(spark.readStream.schema(frames[0].schema).parquet(path))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


KEYS = ("strategy_id", "candle_ts", "instruction", "quantity", "price")


def loop_orders(pdf):
    """(strategy, candle, side, quantity) of each firing bar, from the bars up to it alone."""
    hot, out = pdf[pdf["symbol"] == "HOT"].sort_values("ts"), []
    for sid, frame, days in ((1, 5, 10), (2, 15, 2)):
        for at in hot["ts"][(hot["ts"].dt.minute + 1) % frame == 0]:
            seen = hot[(hot["ts"] <= at) & (hot["ts"] >= at - pd.Timedelta(days=days))]
            if len(seen) < frame:
                continue
            close = seen.groupby(seen["ts"].dt.floor(f"{frame}min"))["close"].last()
            mean = close.rolling(4).mean()
            if len(close) < 2:
                continue
            up = close.iloc[-2] < mean.iloc[-2] and close.iloc[-1] > mean.iloc[-1]
            down = close.iloc[-2] > mean.iloc[-2] and close.iloc[-1] < mean.iloc[-1]
            if up or down:
                out.append((sid, close.index[-1].to_pydatetime(), "BUY" if up else "SELL", round(150 / close.iloc[-1], 6)))
    return sorted(out)


def found(spark, out):
    return sorted((r.strategy_id, r.candle_ts, r.instruction, round(r.quantity, 6)) for r in spark.read.parquet(out).collect())


@pytest.mark.parametrize("n", [1, 3, 7])
def test_signal_loop_does_not_depend_on_batches(spark, tmp_path, n):
    frames, whole = parts(spark, n)
    reg = registry(spark)
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    for batch_id, frame in enumerate(frames):
        live.process_batch(frame, batch_id, reg, store, out, RULES)
    got = found(spark, out)
    assert len(got) > 20 and got == loop_orders(whole.toPandas())


def test_signal_loop_as_a_stream(spark, tmp_path):
    frames, whole = parts(spark, 2)
    reg = registry(spark)
    store, out, checkpoint = (str(tmp_path / n) for n in ("store", "out", "checkpoint"))
    feed(spark, tmp_path, frames, lambda s: live.stream_signals(
        s, reg, store, out, checkpoint, RULES, trigger={"availableNow": True}).awaitTermination())
    assert found(spark, out) == loop_orders(whole.toPandas())


def test_odd_frames_judge_the_open_candle(spark):
    """A frame of 45 fires at minute 44, inside a candle; bars after it do not count."""
    ts = pd.date_range("2025-01-02 14:30", periods=300, freq="min")
    close = [100.0 + (i % 90 < 45) * 5 + i * 0.001 for i in range(300)]
    whole = to_spark(spark, pd.DataFrame({"symbol": "HOT", "ts": ts, "open": close, "high": close, "low": close,
                                          "close": close, "volume": 1.0}))
    reg = spark.createDataFrame([(1, "sma_cross", 45, "hot", "MARKET", 10, 1, 1, None, None)], schema.STRATEGIES)
    got = live.fired_signals(whole, whole, reg, {"sma_cross": partial(st.sma_cross, length=2)}).collect()
    by_time = dict(zip(ts.to_pydatetime(), close))
    assert got and all(r.close == by_time[r.fired_at] and r.fired_at.minute == 44 for r in got)


def test_repeated_batch_replaces_its_output(spark, tmp_path):
    frames, _ = parts(spark, 2)
    reg = registry(spark)
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    for batch_id in (0, 1, 1):
        live.process_batch(frames[batch_id], batch_id, reg, store, out, RULES)
    again = rows(spark.read.parquet(out), *KEYS)
    assert len({k[:2] for k in again}) == len(again)
    assert spark.read.parquet(store).count() == sum(f.count() for f in frames)


def test_compacted_days_give_the_same_orders(spark, tmp_path):
    """Days closed between batches, with late bars for them afterwards, against a loop that never compacts."""
    frames, _ = parts(spark, 2)
    reg = registry(spark)
    plain, tidy = ([str(tmp_path / f"{n}-{k}") for n in ("store", "out")] for k in ("plain", "tidy"))
    late = frames[0].limit(40).withColumn("close", F.col("close") * 1.01)
    batches = [frames[0], late, frames[1]]
    for number, frame in enumerate(batches):
        live.process_batch(frame, number, reg, *plain, RULES)
        live.process_batch(frame, number, reg, *tidy, RULES)
        # All but the last batch; every stored day counts as closed.
        days.compact_days(spark, tidy[0], "2999-01-01", number - 1)
        days.compact_days(spark, tidy[1], "2999-01-01", number - 1, ("symbol", "candle_ts"))
    assert rows(live.fired_orders(spark, plain[1]), *KEYS) == rows(live.fired_orders(spark, tidy[1]), *KEYS)
    columns = ("symbol", "ts", "close", "batch")
    assert rows(days.read_days(spark, plain[0]), *columns) == rows(days.read_days(spark, tidy[0]), *columns)
    live.process_batch(batches[-1], 2, reg, *tidy, RULES)  # the last batch repeated
    assert rows(days.read_days(spark, plain[0]), *columns) == rows(days.read_days(spark, tidy[0]), *columns)


def test_compaction_bounds_the_folders_of_a_day(spark, tmp_path):
    pdf = random_bars({"HOT": 60}, seed=4, gap_minutes=1)
    path = str(tmp_path / "store")
    for number in range(12):
        days.write_days(to_spark(spark, pdf.iloc[number * 5:number * 5 + 5]), "ts", path, number)
        if number in (5, 8):
            assert days.compact_days(spark, path, "2025-03-06", number) == 1
            assert days.compact_days(spark, path, "2025-03-06", number) == 0  # nothing new; removes what is superseded
    found = days.layout(spark, path)
    assert (len(found.open), len(found.closed), found.past) == (3, 1, [])
    assert days.read_days(spark, path).count() == len(pdf)
    assert days.read_days(spark, path, "2025-03-06") is None
    assert days.compact_days(spark, path, "2025-03-05", 11) == 0  # the day is not closed


def test_a_broken_compaction_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    for number, frame in enumerate(parts(spark, 2)[0]):
        days.write_days(frame, "ts", path, number)
    before = rows(days.read_days(spark, path), "symbol", "ts", "close", "batch")
    days.compact_days(spark, path, "2999-01-01", 1)
    (tmp_path / "store" / "_closed" / "run=0" / "_SUCCESS").unlink()  # as if it had broken off before the end
    assert rows(days.read_days(spark, path), "symbol", "ts", "close", "batch") == before
    assert days.compact_days(spark, path, "2999-01-01", 1) > 0
    assert rows(days.read_days(spark, path), "symbol", "ts", "close", "batch") == before
    assert days.layout(spark, path).open == []


def test_the_stream_compacts_as_it_goes(spark, tmp_path):
    frames, whole = parts(spark, 2)
    store, out, checkpoint = (str(tmp_path / n) for n in ("store", "out", "checkpoint"))
    feed(spark, tmp_path, frames, lambda s: live.stream_signals(
        s, registry(spark), store, out, checkpoint, RULES, trigger={"availableNow": True}, compact_every=1).awaitTermination())
    assert live.stored_bars(spark, store).count() == whole.count()
    got = sorted((r.strategy_id, r.candle_ts, r.instruction, round(r.quantity, 6)) for r in live.fired_orders(spark, out).collect())
    assert got == loop_orders(whole.toPandas())


def test_late_bars_change_candles_but_not_fired_signals(spark, tmp_path):
    frames, _ = parts(spark, 2)
    reg = registry(spark)
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    live.process_batch(frames[0], 0, reg, store, out, RULES)
    before = rows(spark.read.parquet(out), *KEYS)
    late = frames[0].withColumn("close", F.col("close") * 1.5)
    live.process_batch(late, 1, reg, store, out, RULES)
    after = rows(spark.read.parquet(out), *KEYS)
    assert set(before) <= set(after)
    assert len({k[:2] for k in after}) == len(after)


def test_latch_over_batches(spark, tmp_path):
    frames, whole = parts(spark, 4)
    reg = registry(spark)
    state, out, checkpoint = (str(tmp_path / n) for n in ("state", "out", "checkpoint"))

    def run(stream):
        live.stream_alignment_latch(stream, reg, state, out, checkpoint, {"availableNow": True}).awaitTermination()

    feed(spark, tmp_path, frames, run)
    batch = live.alignment_latch(whole, reg, "2000-01-01 00:00:00")
    columns = ("strategy_id", "symbol", "ts", "close")
    assert rows(live.latched_bars(spark, out), *columns) == rows(batch, *columns)
    live.latch_batch(frames[3], 3, reg, state, out)  # a repeated batch replaces its own rows
    assert rows(live.latched_bars(spark, out), *columns) == rows(batch, *columns)


def test_latch_state_is_one_row_per_setting(spark, tmp_path):
    frames, _ = parts(spark, 4)
    reg = registry(spark)
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    for number, frame in enumerate(frames):
        live.latch_batch(frame.repartition(3), number, reg, state, out)
    assert spark.read.parquet(state).groupBy("symbol", "time_frame").count().filter("count > 1").count() == 0
    empty = frames[0].limit(0)
    live.latch_batch(empty, 9, reg, state, out)
    assert spark.read.parquet(f"{out}/batch=9").count() == 0


def test_latch_keeps_history_and_drops_unaligned_live_bars(spark):
    ts = pd.to_datetime(["2025-01-02 09:58", "2025-01-02 10:01", "2025-01-02 10:05", "2025-01-02 10:06"])
    bars = to_spark(spark, pd.DataFrame({"symbol": "HOT", "ts": ts, "open": 1.0, "high": 1.0, "low": 1.0,
                                         "close": 1.0, "volume": 1.0}))
    kept = rows(live.alignment_latch(bars, registry(spark), "2025-01-02 10:00:00"), "strategy_id", "ts")
    at = lambda h, m: datetime(2025, 1, 2, h, m)
    assert kept == [(1, at(9, 58)), (1, at(10, 5)), (1, at(10, 6)), (2, at(9, 58))]


def test_streaming_candles_equal_batch_up_to_the_watermark(spark, tmp_path):
    frames, whole = parts(spark, 3)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(stream):
        (live.stream_resample(stream, 15, "5 minutes").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())

    feed(spark, tmp_path, frames, run)
    mark = whole.agg(F.max("ts")).first()[0] - pd.Timedelta(minutes=5)
    want = rs.resample_ohlcv(whole, 15).filter(F.col("ts") + F.expr("interval 15 minutes") <= F.lit(str(mark)).cast("timestamp"))
    assert rows(spark.read.parquet(out), *schema.BAR_COLUMNS) == rows(want, *schema.BAR_COLUMNS)


def test_messages(spark):
    chart = '{"content":[{"key":"spy","CHART_TIME_MILLIS":1735812000000,"OPEN_PRICE":1.0,"VOLUME":3},{"key":""},{"OPEN_PRICE":2.0}]}'
    events = '[{"ev":"A","sym":"SPY","o":1,"h":2,"l":0.5,"c":1.5,"v":9,"s":1735812000000},{"ev":"AM","sym":"X"}]'
    value = lambda text: spark.createDataFrame([(text,)], "value string")
    bar, = chart_bars(value(chart)).collect()
    assert (bar["symbol"], bar["open"], bar["low"], bar["volume"]) == ("SPY", 1.0, None, 3.0)
    assert chart_bars(value(chart), missing_as_zero=True).first()["low"] == 0.0
    event, = agg_event_bars(value(events)).collect()
    assert (event["symbol"], event["ts"], event["close"]) == ("SPY", datetime(2025, 1, 2, 10), 1.5)
