import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.plans.blocks import BlockSize  # noqa: E402
from tickloom.schema import session  # noqa: E402

# Small blocks, so that a few hundred rows already cross several block borders.
SMALL = BlockSize(rows=60, unit_seconds=6 * 3600)


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", **{
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def random_bars(rows: dict[str, int], seed: int = 1, nulls: float = 0.0, gap_minutes: int = 9,
                drift: float = 0.3) -> pd.DataFrame:
    """Irregular 1-minute bars per symbol on a random walk."""
    rng = np.random.default_rng(seed)
    frames = []
    for symbol, n in rows.items():
        steps = rng.integers(1, gap_minutes + 1, n).cumsum()
        close = 100 + (rng.normal(0, drift, n)).cumsum()
        high, low = close + rng.uniform(0, 0.6, n), close - rng.uniform(0, 0.6, n)
        frames.append(pd.DataFrame({
            "symbol": symbol, "ts": pd.Timestamp("2025-03-05 12:00") + pd.to_timedelta(steps, unit="min"),
            "open": np.r_[close[0], close[:-1]], "high": high, "low": low, "close": close,
            "volume": rng.integers(1, 9000, n).astype(float)}))
    out = pd.concat(frames, ignore_index=True)
    if nulls:
        for c in ("high", "low", "close"):
            out.loc[rng.random(len(out)) < nulls, c] = np.nan
    return out


def to_spark(spark, pdf: pd.DataFrame):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(pdf).repartition(4)
    return df.withColumns({
        c: F.when(~F.isnan(c), F.col(c)) for c in pdf.columns if pdf[c].dtype == "float64"})


def by_series(df, keys=("symbol",)) -> dict:
    """Collected result per series, in time order."""
    pdf = df.toPandas().sort_values([*keys, "ts"], ignore_index=True)
    return {k if len(keys) > 1 else k[0]: g.reset_index(drop=True) for k, g in pdf.groupby(list(keys))}
