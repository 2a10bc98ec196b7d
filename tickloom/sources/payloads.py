"""Landed vendor payloads (JSON, one document per line) to bars and news.

The parsing functions take any DataFrame with the payload's columns, so the same code serves batch
files, file streams and ``from_json`` of a Kafka value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.quality import coerce_numeric, session_filter
from tickloom.schema import BAR_COLUMNS, MARKET_ZONE

HISTORY = ("symbol string, candles array<struct<datetime:bigint, open:string, high:string, "
           "low:string, close:string, volume:string>>")
SERIES = ("status string, message string, meta struct<symbol:string>, values array<struct<"
          "datetime:string, open:string, high:string, low:string, close:string, volume:string>>")
AGGS = ("status string, error string, ticker string, results array<struct<"
        "t:bigint, o:double, h:double, l:double, c:double, v:double>>")
NEWS = "results array<struct<published_utc:string, tickers:array<string>, title:string>>"

SERIES_TIME = "yyyy-MM-dd HH:mm:ss"


def _load(spark: SparkSession, path, schema: str, multi_line: bool) -> DataFrame:
    df = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return df.withColumn("_file_symbol", F.regexp_extract("_metadata.file_name", r"^([^.]+)\.", 1))


def _items(df: DataFrame, array: str, rejected: Column, message: Column, on_error: str) -> DataFrame:
    """Explode the payload array; a rejected payload fails the job or, with 'skip', is left out."""
    if on_error not in ("raise", "skip"):
        raise ValueError(f"on_error must be 'raise' or 'skip', got {on_error!r}")
    if on_error == "skip":
        df, items = df.filter(~rejected), F.col(array)
    else:
        items = F.when(rejected, F.raise_error(message).cast(df.schema[array].dataType)).otherwise(F.col(array))
    return df.withColumn("_item", F.explode(items))


def _symbol(df: DataFrame, given: Column) -> Column:
    return F.upper(F.coalesce(given, F.col("_file_symbol"))) if "_file_symbol" in df.columns else F.upper(given)


def history_bars(df: DataFrame, on_error: str = "raise") -> DataFrame:
    missing = F.col("candles").isNull()
    rows = _items(df, "candles", missing, F.lit("history payload has no candles"), on_error)
    return coerce_numeric(rows.select(
        _symbol(df, F.col("symbol")).alias("symbol"),
        F.timestamp_millis("_item.datetime").alias("ts"),
        *[F.col(f"_item.{c}").alias(c) for c in BAR_COLUMNS[2:]]))


def read_history_candles(spark: SparkSession, path, on_error: str = "raise",
                         multi_line: bool = False) -> DataFrame:
    """{symbol?, candles:[{datetime (epoch ms), open, high, low, close, volume}]} to bars.

    Without a symbol in the payload the file name up to its first dot is the symbol.
    """
    return history_bars(_load(spark, path, HISTORY, multi_line), on_error)


def series_bars(df: DataFrame, extended_hours: bool = False, on_error: str = "raise") -> DataFrame:
    failed = F.coalesce(F.col("status") == "error", F.lit(False)) | F.col("values").isNull()
    why = F.concat(F.lit("series payload rejected: "), F.coalesce("message", F.lit("no values")))
    rows = _items(df, "values", failed, why, on_error)
    wall = F.try_to_timestamp("_item.datetime", F.lit(SERIES_TIME))
    bars = coerce_numeric(rows.select(
        _symbol(df, F.col("meta.symbol")).alias("symbol"),
        F.to_utc_timestamp(wall, MARKET_ZONE).alias("ts"),
        *[F.col(f"_item.{c}").alias(c) for c in BAR_COLUMNS[2:]]))
    return bars if extended_hours else session_filter(bars)


def read_series_values(spark: SparkSession, path, extended_hours: bool = False,
                       on_error: str = "raise", multi_line: bool = False) -> DataFrame:
    """{status?, meta.symbol?, values:[{datetime (local text), ...text}]} to bars of the session."""
    return series_bars(_load(spark, path, SERIES, multi_line), extended_hours, on_error)


def agg_bars(df: DataFrame, on_error: str = "raise") -> DataFrame:
    failed = F.coalesce(F.col("status").isin("ERROR", "NOT_FOUND"), F.lit(False)) | F.col("results").isNull()
    why = F.concat(F.lit("aggregate payload rejected: "), F.coalesce("error", "status", F.lit("no results")))
    rows = _items(df, "results", failed, why, on_error)
    return coerce_numeric(
        rows.select(
            _symbol(df, F.col("ticker")).alias("symbol"), "_item.*")
        .dropna(subset=["t", "o", "h", "l", "c", "v"])
        .select("symbol", F.timestamp_millis("t").alias("ts"), F.col("o").alias("open"),
                F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"),
                F.col("v").alias("volume")))


def read_agg_results(spark: SparkSession, path, on_error: str = "raise",
                     multi_line: bool = False) -> DataFrame:
    """{status, results:[{t, o, h, l, c, v}]} to bars; items lacking any field are skipped."""
    return agg_bars(_load(spark, path, AGGS, multi_line), on_error)


def news_items(df: DataFrame) -> DataFrame:
    return df.select(F.explode("results").alias("_item")).select(
        F.to_timestamp("_item.published_utc").alias("published_utc"),
        F.coalesce("_item.tickers", F.array().cast("array<string>")).alias("tickers"),
        F.coalesce("_item.title", F.lit("")).alias("title"))


def read_news(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    return news_items(_load(spark, path, NEWS, multi_line))
