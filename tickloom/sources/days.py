"""Tables of a stream by market day and batch, with compaction of closed days.

A batch writes ``day=D/batch=N`` and replaces what it wrote when it is repeated. ``compact_days`` rewrites the batches
of closed days into ``_closed/run=K/upto=N/day=D``, sorted, with the batch as a column. A run counts once its
``_SUCCESS`` file stands, which Spark writes last; from then on it stands for all batches of its days up to N, and readers pass over
their folders. Those are removed by the next compaction, so that a query planned before the run still finds its files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.clock import local_date

CLOSED = "_closed"


def write_days(df: DataFrame, ts: str, path: str, batch_id: int) -> None:
    (df.withColumns({"day": local_date(ts), "batch": F.lit(batch_id)})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path))


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match, beginning as ``pattern`` does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    root = pattern[:pattern.index("*")].rsplit("/", 1)[0]
    depth = pattern[len(root):].count("/")
    return sorted(f"{root}/{'/'.join(f.getPath().toString().split('/')[-depth:])}" for f in found)


def _value(path: str, name: str) -> str:
    return next(p for p in path.split("/")[::-1] if p.startswith(name + "=")).removeprefix(name + "=")


@dataclass(frozen=True)
class Layout:
    """Folders of a table: ``open`` and ``closed`` hold its rows, ``past`` is superseded."""
    open: list[str]
    closed: list[str]
    past: list[str]
    runs: int


def layout(spark: SparkSession, path: str, first: str = "") -> Layout:
    """What the days from ``first`` on consist of; folders of earlier days are not listed."""
    done = [p.rsplit("/", 1)[0] for p in _glob(spark, f"{path}/{CLOSED}/run=*/_SUCCESS")]
    newest: dict[str, str] = {}
    sets = [s for run in done for s in _glob(spark, f"{run}/upto=*/day=*")]
    for s in sorted(sets, key=lambda s: int(_value(s, "run"))):
        newest[_value(s, "day")] = s
    upto = {day: int(_value(s, "upto")) for day, s in newest.items()}
    days = [d for d in _glob(spark, f"{path}/day=*") if _value(d, "day") >= first]
    batches = [b for d in days for b in _glob(spark, f"{d}/batch=*")]
    fresh = [b for b in batches if int(_value(b, "batch")) > upto.get(_value(b, "day"), -1)]
    current = set(newest.values())
    return Layout(fresh, [s for day, s in newest.items() if day >= first],
                  sorted({*batches, *sets} - {*fresh, *current}),
                  max((int(_value(p, "run")) for p in _glob(spark, f"{path}/{CLOSED}/run=*")), default=-1) + 1)


def _rows(spark: SparkSession, path: str, opened: list[str], closed: list[str]) -> DataFrame | None:
    frames = []
    if opened:
        frames.append(spark.read.option("basePath", path).parquet(*opened))
    if closed:
        frames.append(spark.read.option("basePath", f"{path}/{CLOSED}").parquet(*closed).drop("run", "upto"))
    if len(frames) < 2:
        return frames[0] if frames else None
    return frames[0].unionByName(frames[1])


def read_days(spark: SparkSession, path: str, first: str = "") -> DataFrame | None:
    """Rows of the market days from ``first`` (yyyy-mm-dd) on, with ``day`` and ``batch``; None where there are none."""
    found = layout(spark, path, first)
    return _rows(spark, path, found.open, found.closed)


def newest_day(spark: SparkSession, path: str) -> str | None:
    """The last day that has a folder, from the names alone."""
    found = layout(spark, path)
    return max((_value(p, "day") for p in [*found.open, *found.closed]), default=None)


def compact_days(spark: SparkSession, path: str, before: str, upto: int, order: tuple[str, ...] = ("symbol", "ts")) -> int:
    """Rewrite the batches up to ``upto`` of the days before ``before`` (yyyy-mm-dd) as one sorted set a day.

    Give an ``upto`` that is never repeated: the last batch the stream has committed, or an earlier one. Batches after
    it, late rows of a closed day too, stay as they are and are read beside the set; a later call takes them
    in. One writer at a time. A run that breaks off leaves a folder without ``_SUCCESS`` that nobody reads.
    Returns the number of days rewritten; days without new batches are left alone.
    """
    found = layout(spark, path)
    _remove(spark, found.past)
    taken = [b for b in found.open if _value(b, "day") < before and int(_value(b, "batch")) <= upto]
    days = {_value(b, "day") for b in taken}
    if not days:
        return 0
    rows = _rows(spark, path, taken, [s for s in found.closed if _value(s, "day") in days])
    (rows.withColumn("upto", F.lit(upto)).hint("rebalance", "day").sortWithinPartitions("day", *order)
     .write.partitionBy("upto", "day").parquet(f"{path}/{CLOSED}/run={found.runs}"))
    return len(days)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
