"""Bar streams from message files or Kafka values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schema import BAR_COLUMNS

CHART = ("struct<content:array<struct<key:string, CHART_TIME_MILLIS:bigint, OPEN_PRICE:double, "
         "HIGH_PRICE:double, LOW_PRICE:double, CLOSE_PRICE:double, VOLUME:bigint>>>")
EVENTS = "array<struct<ev:string, sym:string, o:double, h:double, l:double, c:double, v:double, s:bigint>>"


def message_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """File stream of messages, one JSON document per line, in ``value`` as Kafka has it."""
    reader = spark.readStream.schema("value string").format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def kafka_values(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).load().select(F.col("value").cast("string").alias("value")))


def chart_bars(messages: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """Chart messages to bars; items without a key are left out.

    Absent prices and volumes are null, as in history, or 0 with ``missing_as_zero``.
    """
    item = messages.select(F.explode(F.from_json("value", CHART).content).alias("i"))
    number = lambda name: F.coalesce(F.col(f"i.{name}").cast("double"),
                                     F.lit(0.0 if missing_as_zero else None).cast("double"))
    return (
        item.filter(F.length(F.trim(F.col("i.key"))) > 0)
        .select(F.upper("i.key").alias("symbol"),
                F.timestamp_millis("i.CHART_TIME_MILLIS").alias("ts"),
                number("OPEN_PRICE").alias("open"), number("HIGH_PRICE").alias("high"),
                number("LOW_PRICE").alias("low"), number("CLOSE_PRICE").alias("close"),
                number("VOLUME").alias("volume"))
    )


def agg_event_bars(messages: DataFrame) -> DataFrame:
    """Event arrays to bars: events of kind 'A' only, stamped with their start time."""
    item = messages.select(F.explode(F.from_json("value", EVENTS)).alias("i")).filter("i.ev = 'A'")
    return item.select(
        F.col("i.sym").alias("symbol"), F.timestamp_millis("i.s").alias("ts"),
        F.col("i.o").alias("open"), F.col("i.h").alias("high"), F.col("i.l").alias("low"),
        F.col("i.c").alias("close"), F.col("i.v").alias("volume")).select(*BAR_COLUMNS)


def stream_chart_bars(spark: SparkSession, path: str, missing_as_zero: bool = False,
                      max_files: int | None = None) -> DataFrame:
    return chart_bars(message_lines(spark, path, max_files), missing_as_zero)


def stream_agg_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    return agg_event_bars(message_lines(spark, path, max_files))
