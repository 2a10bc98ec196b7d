"""What the corpus operators share: session settings, scratch tables, global order, text blocks.

Every operator reads only the columns it is told to read, under names of its own, and returns the
id column plus its results. Further columns of the input, whatever their names, are not carried.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.ship import ship
from tickloom.sources.scratch import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_recorded: list[list[str]] = []


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and keep Arrow batches small, since one text may be long."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    for paths in _recorded[-1:]:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Add the paths of the tables stored inside the block to ``paths``."""
    _recorded.append(paths)
    try:
        yield
    finally:
        _recorded.pop()


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Delete the tables at ``paths`` and empty the list; call it when nothing reads them any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(hadoop).delete(path, True)


def keyed(docs: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``columns`` with ``_row``, which tells repeated rows apart and is the same at each read.

    Rows of Parquet files are known by file and place in it; other rows are stored under numbers.
    """
    try:
        return docs.select(*columns, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("_row"))
    except AnalysisException:
        return store(docs.select(*columns, F.struct(F.monotonically_increasing_id().alias("at")).alias("_row")), name)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(column) -> F.Column:
    return F.translate(column, UPPER, LOWER)


def positions(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``_pos``, its 0-based place in ``order``, without one task that sees all rows.

    Rows are dealt by range, numbered per partition, and shifted by the counts of the partitions
    before (one row per partition). Equal rows get places in any order among them.
    """
    n = partitions(df.sparkSession)
    ranged = store(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), name)
    shift = ranged.groupBy("_pid").count().select(
        "_pid", (F.sum("count").over(Window.orderBy("_pid")) - F.col("count")).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return ranged.withColumn("_pos", place.cast("long")).join(shift, "_pid").withColumn(
        "_pos", F.col("_pos") + F.col("_shift")).drop("_pid", "_shift")


def block_numbers(rows: int) -> F.Column:
    """Numbers of blocks of at most ``rows`` rows that lie together; store them to have the same at each read."""
    place = F.monotonically_increasing_id()
    return F.shiftleft(F.shiftright(place, 33), 33) + F.expr("(monotonically_increasing_id() & 8589934591L) div %d" % rows)


def batched(iterable, size: int):
    iterator = iter(iterable)
    while part := list(itertools.islice(iterator, size)):
        yield part
