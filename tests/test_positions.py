"""Walks from block to block equal one walk over all rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from tickloom.plans.blocks import BLOCK, BlockSize, split_blocks
from tickloom.plans.positions import FLAT, Search, answer, conduct, describe, position_signals, replay

ANSWERS = ["_from", "_at", "_price", "_to", "_exits", "_end_at", "_end_price"]


def frame(rng, n):
    close = rng.integers(1, 12, n).astype(float)
    out = pd.DataFrame({"ts": np.arange(n), "close": close, "_entry": rng.random(n) < 0.3, "_forced": rng.random(n) < 0.02,
                        "_low": close, "_below": rng.integers(-4, 6, n).astype(float), "_high": close, "_above": rng.integers(-4, 6, n).astype(float)})
    for c in ("_below", "_above"):
        out.loc[rng.random(n) < 0.2, c] = np.nan
    return out


def loop(pdf):
    held, out = None, []
    for r in pdf.to_dict("records"):
        action = None
        if held is None:
            if r["_entry"]:
                held, action = r["close"], "BUY"
        elif r["_forced"] or r["_low"] < held - r["_below"] or r["_high"] >= held + r["_above"]:
            held, action = None, "SELL"
        out.append(action)
    return out


@settings(max_examples=150, deadline=None)
@given(hs.integers(0, 10**6), hs.integers(1, 120), hs.integers(1, 40))
def test_chained_blocks_equal_one_walk(seed, n, width):
    pdf = frame(np.random.default_rng(seed), n)
    cut = [pdf.iloc[a:a + width].reset_index(drop=True) for a in range(0, n, width)]
    stats = pd.DataFrame([{BLOCK: 3 * k, **describe(b)} for k, b in enumerate(cut)])  # block numbers may have holes
    answers, rounds = pd.DataFrame(columns=ANSWERS), 0
    while True:
        starts, asked = conduct(stats, answers)
        if not len(asked):
            break
        assert not asked.duplicated(["_from", "_at"]).any()
        found = [answer(cut[to // 3], g) for to, g in asked.groupby("_to")]
        answers, rounds = pd.concat([answers, *found] if len(answers) else found, ignore_index=True)[ANSWERS], rounds + 1
        assert rounds <= 2 * len(cut)
    assert starts[BLOCK].tolist() == stats[BLOCK].tolist()
    got = []
    for block, held, price in zip(cut, starts["_start_held"], starts["_start_price"]):
        got += list(replay(block, price if held else FLAT)[0])
    assert got == loop(pdf) == list(replay(pdf, FLAT)[0])


def test_search_finds_the_first_block():
    rng = np.random.default_rng(0)
    for size in (1, 2, 3, 7, 8, 9, 33):
        stats = pd.DataFrame({"_stop": rng.integers(3, 20, size).astype(float), "_target": rng.integers(-20, 3, size).astype(float), "_any": rng.random(size) < 0.05})
        at, price = rng.integers(0, size + 1, 200), rng.integers(-25, 25, 200).astype(float)
        hit = lambda k, p: stats["_any"][k] or p > stats["_stop"][k] or p <= stats["_target"][k]  # noqa: B023, E731
        want = [next((k for k in range(a, size) if hit(k, p)), size) for a, p in zip(at, price)]
        assert Search(stats).first(at, price).tolist() == want


def test_a_long_rise_in_small_blocks(spark):
    """200,000 rising rows: every row is a new extreme, so prices held before a block meet a different row each."""
    n = 200_000
    close = 100 + np.arange(n) * 0.01
    pdf = pd.DataFrame({"symbol": "UP", "ts": pd.date_range("2025-01-01", periods=n, freq="min"), "close": close, "_entry": np.arange(n) % 3 == 0,
                        "_forced": np.zeros(n, bool), "_low": close, "_below": 1.0, "_high": close, "_above": 7.005 + 0.5 * np.sin(np.arange(n) / 900)})
    df = spark.createDataFrame(pdf)
    blocks = split_blocks(df, 1, BlockSize(rows=5000, unit_seconds=86_400))
    assert blocks.most > 30
    out = position_signals(blocks, lambda b: b).filter("signal is not null").select("ts", "signal").toPandas().sort_values("ts")
    want = pd.Series(loop(pdf), index=pdf["ts"]).dropna()
    assert out["signal"].tolist() == want.tolist() and out["ts"].tolist() == want.index.tolist() and len(want) > 300


@pytest.mark.parametrize("size", [BlockSize(), BlockSize(rows=500, unit_seconds=86_400)], ids=["whole", "split"])
def test_exits_on_the_rounded_level_follow_the_rule_itself(spark, size):
    """Lows that equal price - 0.9 * ATR to the last bit do not stop, highs that equal price + 5 * ATR do."""
    rng = np.random.default_rng(7)
    n = 4000
    price, atr = np.round(rng.uniform(5, 50, n), 2), np.round(rng.uniform(0.01, 2, n), 2)
    below, above = atr * 0.9, atr * 5.0
    at_stop = rng.random(n) < 0.5
    held = np.roll(price, 1)  # the entry one row before
    low = np.where(at_stop, held - below, held)
    high = np.where(at_stop, held, held + above)
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2025-01-01", periods=n, freq="min"), "close": price, "_entry": np.arange(n) % 2 == 0,
                        "_forced": np.arange(n) % 10 == 9, "_low": low, "_below": below, "_high": high, "_above": above})
    got = position_signals(split_blocks(spark.createDataFrame(pdf), 1, size), lambda b: b).toPandas().sort_values("ts")
    assert [s if isinstance(s, str) else None for s in got["signal"]] == loop(pdf)
