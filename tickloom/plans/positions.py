"""Positions whose exit depends on the entry price, over blocked series.

While flat, the first row whose ``entry`` mask holds opens a position at its close. While open at price p, the
position ends at the first later row where ``forced`` holds, or low < p - below, or high >= p + above. Which entries
count depends on all exits before them, so the walk is sequential; three steps spread it over tasks:

1. per block of a split series: where a walk that starts flat ends (flat, or holding one entry), and the least price
   above which and the highest up to which some row may end a position. One row per block;
2. per series, on these rows: the walk from block to block. A held price passes blocks that cannot end it; the
   next block that may is asked for the exit and for where the walk then ends. All blocks ask at once for the positions their
   own flat walks leave open, so that most answers are there when the real walk needs them; the rounds end with it.
   An entry is asked for once, and only entries that some walk holds at a block's end are;
3. per block: replay from the state it starts in and emit signals.

No task reads more than a block and one row for each question to it, or one row per block and question of a series.
Series that fit one block skip the first two steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans.blocks import BLOCK, SPLIT, Blocks
from tickloom.schema import time_columns
from tickloom.sources.scratch import materialize

FLAT = None
LOOK = 64
SLACK = 1e-9
RULE = ["_entry", "_forced", "_low", "_below", "_high", "_above"]

_STATS = "_stop double, _target double, _any boolean, _flat_at int, _flat_price double"
_ASK = "_from int, _at int, _price double, _to int"
_ANSWER = f"{_ASK}, _exits boolean, _end_at int, _end_price double"
_STATE = "_start_held boolean, _start_price double"


class BlockRows:
    """Column arrays of one block in time order."""

    def __init__(self, rows: pd.DataFrame):
        number = lambda c: rows[c].to_numpy(dtype="float64", na_value=np.nan)
        self.close, self.low, self.below, self.high, self.above = (number(c) for c in ("close", "_low", "_below", "_high", "_above"))
        self.forced = rows["_forced"].to_numpy(dtype=bool)
        self.entries = np.flatnonzero(rows["_entry"].to_numpy(dtype=bool))
        self.size = len(rows)

    def next_entry(self, start: int):
        at = np.searchsorted(self.entries, start)
        return int(self.entries[at]) if at < len(self.entries) else None

    def exit_after(self, start: int, price: float):
        """First row from ``start`` on that ends a position held at ``price``."""
        width = LOOK
        while start < self.size:
            part = slice(start, start + width)
            ends = self.forced[part] | (self.low[part] < price - self.below[part]) | (self.high[part] >= price + self.above[part])
            if ends.any():
                return start + int(ends.argmax())
            start, width = start + width, width * 2
        return None

    def end_from_flat(self, start: int):
        """The entry held at the block's end after being flat at ``start``; None if flat."""
        entry = self.next_entry(start)
        while entry is not None:
            out = self.exit_after(entry + 1, self.close[entry])
            if out is None:
                return entry
            entry = self.next_entry(out + 1)
        return None

    def limits(self):
        """(stop, target): prices above ``stop`` or up to ``target`` may end here; a little too wide rather than too narrow."""
        with np.errstate(invalid="ignore"):
            stop = self.low + self.below - SLACK * (np.abs(self.low) + np.abs(self.below))
            target = self.high - self.above + SLACK * (np.abs(self.high) + np.abs(self.above))
        return np.fmin.reduce(stop, initial=np.inf), np.fmax.reduce(target, initial=-np.inf)


def describe(pdf: pd.DataFrame) -> dict:
    rows = BlockRows(pdf)
    stop, target = rows.limits()
    held = rows.end_from_flat(0)
    return dict(_stop=stop, _target=target, _any=bool(rows.forced.any()), _flat_at=-1 if held is None else held,
                _flat_price=np.nan if held is None else float(rows.close[held]))


def answer(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """``asked`` with whether the block ends each price, and the entry held at its end (-1: flat) if so."""
    rows, ends, out = BlockRows(pdf), {}, []
    for price in asked["_price"]:
        at = rows.exit_after(0, price)
        if at is None:
            out.append((False, -1, np.nan))
            continue
        if at not in ends:
            ends[at] = rows.end_from_flat(at + 1)
        held = ends[at]
        out.append((True, -1, np.nan) if held is None else (True, held, float(rows.close[held])))
    return asked.assign(**{c: [o[n] for o in out] for n, c in enumerate(("_exits", "_end_at", "_end_price"))})


class Search:
    """First block from a place on whose limits may end a price: minima and maxima over 2^k blocks."""

    def __init__(self, stats: pd.DataFrame):
        stop, target = stats["_stop"].to_numpy(float), stats["_target"].to_numpy(float)
        stop = np.where(stats["_any"].to_numpy(bool), -np.inf, stop)
        self.levels, self.size = [(stop, target)], len(stats)
        while (1 << len(self.levels)) <= self.size:
            half = 1 << (len(self.levels) - 1)
            later = lambda v, fill: np.concatenate([v[half:], np.full(half, fill)])  # noqa: B023, E731
            self.levels.append((np.minimum(stop, later(stop, np.inf)), np.maximum(target, later(target, -np.inf))))
            stop, target = self.levels[-1]

    def first(self, at: np.ndarray, price: np.ndarray) -> np.ndarray:
        """Places of the blocks; ``size`` where there is none."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                inside = np.minimum(at, self.size - 1)
                stop, target = self.levels[k]
                none = (at < self.size) & ~((price > stop[inside]) | (price <= target[inside]))
                at = np.minimum(np.where(none, at + (1 << k), at), self.size)
        return at


def conduct(stats: pd.DataFrame, answers: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(starts, asked) of one series: the state each block starts in as far as the walk is known, and what to ask next.

    ``stats`` has one row per block in order; ``answers`` what blocks have said so far. Nothing is asked once the walk is whole.
    """
    blocks = stats[BLOCK].tolist()
    place = {b: n for n, b in enumerate(blocks)}
    flat_at, flat_price = stats["_flat_at"].tolist(), stats["_flat_price"].tolist()
    prices = {(n, at): p for n, (at, p) in enumerate(zip(flat_at, flat_price)) if at >= 0}
    said, passed = {}, {}
    for a in answers.itertuples(index=False):
        node, to = (place[a._0], a._1), place[a._3]
        if a._4:
            said[node] = (to, a._5)
            if a._5 >= 0:
                prices[to, a._5] = a._6
        else:
            passed[node] = max(passed.get(node, 0), to + 1)
    open_ = [n for n in prices if n not in said]
    reach = Search(stats).first(np.array([max(n[0] + 1, passed.get(n, 0)) for n in open_], np.int64), np.array([prices[n] for n in open_], float))
    to = dict(zip(open_, reach.tolist()))

    starts, at, node = [], 0, None
    while at < len(blocks):  # the walk from block to block
        if node is None:
            starts.append((blocks[at], False, np.nan))
            node = (at, flat_at[at]) if flat_at[at] >= 0 else None
            at += 1
            continue
        ends, end = said.get(node, (to.get(node), None))
        stop = min(ends + 1, len(blocks)) if ends < len(blocks) else len(blocks)
        starts += [(blocks[k], True, prices[node]) for k in range(at, stop)]
        if ends >= len(blocks):
            at = len(blocks)
        elif node in said:
            at, node = ends + 1, (ends, end) if end >= 0 else None
        else:
            break
    done = len(starts) == len(blocks) and at >= len(blocks)
    asked = [] if done else [(blocks[n[0]], n[1], prices[n], blocks[k]) for n, k in to.items() if k < len(blocks)]
    return (pd.DataFrame(starts, columns=[BLOCK, "_start_held", "_start_price"]), pd.DataFrame(asked, columns=["_from", "_at", "_price", "_to"]))


def replay(pdf: pd.DataFrame, state):
    """(signal, held price) per row; the exit row still shows the price it closes."""
    rows = BlockRows(pdf)
    signal = np.full(rows.size, None, dtype=object)
    price = np.full(rows.size, np.nan)
    at = 0
    while True:
        if state is FLAT:
            entry = rows.next_entry(at)
            if entry is None:
                return signal, price
            signal[entry], state = "BUY", rows.close[entry]
            price[entry], at = state, entry + 1
        out = rows.exit_after(at, state)
        if out is None:
            price[at:] = state
            return signal, price
        signal[out], state, price[at:out + 1], at = "SELL", FLAT, state, out + 1


def position_signals(blocks: Blocks, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``signal`` and ``entry_price``.

    ``rule`` adds the columns of ``RULE`` to a blocked frame; null numbers never end a position.
    """
    part, time = blocks.part, time_columns(blocks.frame)
    rows = blocks.own(rule(blocks.frame))
    kept = [c for c in rows.columns if c not in RULE]
    schema = T.StructType([*(rows.schema[c] for c in kept),
                           T.StructField("signal", T.StringType()),
                           T.StructField("entry_price", T.DoubleType())])
    if blocks.split:
        rows = rows.join(_block_starts(blocks, rule), part, "left")

    def replay_block(pdf):
        pdf = pdf.sort_values(time, na_position="first", ignore_index=True)
        held = "_start_held" in pdf and pdf["_start_held"].iat[0] is not None and bool(pdf["_start_held"].iat[0])
        signal, price = replay(pdf, float(pdf["_start_price"].iat[0]) if held else FLAT)
        out = pdf[kept].copy()
        out["signal"], out["entry_price"] = signal, price
        return out

    out = rows.groupBy(*part).applyInPandas(replay_block, schema)
    return out.withColumn("entry_price", F.expr("CASE WHEN NOT isnan(entry_price) THEN entry_price END"))


def _block_starts(blocks: Blocks, rule) -> DataFrame:
    """Position held at the start of each block of a split series."""
    part, series, time = blocks.part, [*blocks.keys, SPLIT], time_columns(blocks.frame)
    types = lambda columns: ", ".join(f"`{c}` {blocks.frame.schema[c].dataType.simpleString()}" for c in columns)
    spark = blocks.frame.sparkSession
    walk = materialize(blocks.own(rule(blocks.frame.filter(SPLIT))).select(*part, *time, "close", *RULE), "walk")

    def describe_block(key, pdf):
        return pd.DataFrame([{**dict(zip(part, key)), **describe(pdf.sort_values(time, na_position="first"))}])

    def conduct_series(key, stats, answers):
        starts, asked = conduct(stats.sort_values(BLOCK, ignore_index=True), answers[["_from", "_at", "_price", "_to", "_exits", "_end_at", "_end_price"]])
        out = pd.concat([frame for frame in (starts, asked) if len(frame)], ignore_index=True) if len(starts) or len(asked) else starts
        out = out.reindex(columns=[BLOCK, "_start_held", "_start_price", "_from", "_at", "_price", "_to"])
        for c, v in zip(series, key):
            out[c] = v
        return out.astype({BLOCK: "Int64", "_from": "Int64", "_at": "Int64", "_to": "Int64", "_start_held": "boolean"})

    def answer_block(pdf, asked):
        if not len(asked):
            return asked.assign(_exits=False, _end_at=-1, _end_price=np.nan)[[*series, *answer_columns]]
        return answer(pdf.sort_values(time, na_position="first", ignore_index=True), asked)[[*series, *answer_columns]]

    answer_columns = [f.split()[0] for f in _ANSWER.split(", ")]
    stats = materialize(walk.groupBy(*part).applyInPandas(describe_block, f"{types(part)}, {_STATS}"), "stats")
    answers = spark.createDataFrame([], f"{types(series)}, {_ANSWER}")
    while True:
        told = materialize(stats.groupBy(*series).cogroup(answers.groupBy(*series)).applyInPandas(
            conduct_series, f"{types([BLOCK])}, {_STATE}, {_ASK}, {types(series)}"), "told")
        asked = told.filter("_to is not null").select(*series, F.col("_to").alias(BLOCK), "_from", "_at", "_price", "_to")
        if asked.isEmpty():
            return told.filter("_start_held is not null").select(*part, "_start_held", "_start_price")
        answers = answers.unionByName(materialize(walk.join(asked.select(*part).distinct(), part, "left_semi").groupBy(*part)
                                                  .cogroup(asked.groupBy(*part)).applyInPandas(answer_block, f"{types(series)}, {_ANSWER}"), "answers"))
