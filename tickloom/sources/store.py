"""Bar store, registry tables and CSV output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.clock import local_date
from tickloom.schema import REGISTRY, time_columns


def write_bars(df: DataFrame, path: str, by_symbol: bool = False, mode: str = "append") -> None:
    """Parquet by market-local date (and symbol when there are few).

    Rebalancing lets AQE split a heavy date over several files and merge light ones.
    """
    parts = ["day", "symbol"] if by_symbol else ["day"]
    (df.withColumn("day", local_date("ts"))
       .hint("rebalance", *parts)
       .sortWithinPartitions("day", "symbol", *time_columns(df))
       .write.mode(mode).partitionBy(*parts).parquet(path))


def read_bars(spark: SparkSession, path: str, start_day: str | None = None,
              end_day: str | None = None, keep_day: bool = False) -> DataFrame:
    """Bars of the store; the day bounds prune partitions.

    ``keep_day`` keeps the column ``day``, by which ``lookback`` and ``lookback_sessions`` prune as well.
    """
    df = spark.read.parquet(path)
    if start_day is not None:
        df = df.filter(F.col("day") >= F.lit(start_day).cast("date"))
    if end_day is not None:
        df = df.filter(F.col("day") <= F.lit(end_day).cast("date"))
    return df if keep_day else df.drop("day")


def read_registry(spark: SparkSession, path: str, format: str = "parquet") -> dict[str, DataFrame]:
    """The three registry tables under ``path``, each with its declared schema."""
    options = {"header": "true"} if format == "csv" else {}
    return {
        table: spark.read.format(format).options(**options).schema(schema).load(f"{path.rstrip('/')}/{table}")
        for table, schema in REGISTRY.items()
    }


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows to a CSV folder whose files each carry the header; refuses an empty frame."""
    if df.isEmpty():
        raise ValueError("nothing to append: the frame is empty")
    df.write.mode("append").option("header", True).csv(path)
