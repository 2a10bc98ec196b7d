"""Ordered work on long series, cut into blocks of bounded size.

A window over a whole symbol puts every row of that symbol into one task. That is fine for the
usual series and fatal for one that holds a third of all rows. So a small count (columns: keys and
``ts``, with map-side combine) first looks for series above ``BlockSize.rows``:

* none: windows partition by the series keys, nothing is added to the plan;
* some: those series are cut at calendar-unit borders into blocks of about ``rows`` rows, and each
  block receives copies of the ``halo`` rows before it, so every look-back of at most ``halo`` rows
  is exact inside one block. What depends on the whole past goes from block to block as one row
  each. The cut table (one row per series and unit) is written to the shared
  scratch folder; Spark then knows its size and broadcasts it only if it is small.

Per-series windows over the cut table are bounded by the calendar: about 52 rows a year, more where
a dense series needs a shorter unit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schema import series_keys, time_columns
from tickloom.sources.scratch import materialize

SPLIT, BLOCK, OWN = "_split", "_block", "_own"


@dataclass(frozen=True)
class BlockSize:
    rows: int = 1_000_000
    unit_seconds: int = 7 * 86_400


DEFAULT = BlockSize()


class Part(list):
    """Columns by which windows partition, with the columns that order the rows in time."""

    def __init__(self, columns: Sequence[str], time: Sequence[str] = ("ts",)):
        super().__init__(columns)
        self.time = list(time)

    def plus(self, *columns: str) -> "Part":
        return Part([*self, *columns], self.time)


@dataclass(frozen=True)
class Blocks:
    """A frame whose windows partition by ``part``.

    ``split``: some series was cut; ``most``: into how many blocks at most.
    """
    frame: DataFrame
    keys: list[str]
    split: bool
    most: int = 1

    @property
    def part(self) -> Part:
        # ``_split`` is among the keys so that a filter on it moves below the windows.
        return Part([*self.keys, SPLIT, BLOCK] if self.split else self.keys, time_columns(self.frame))

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop the halo copies and the block columns."""
        return df.filter(OWN).drop(SPLIT, BLOCK, OWN) if self.split else df

    def own(self, df: DataFrame) -> DataFrame:
        return df.filter(OWN) if self.split else df


TIME = "{time}"


def over(part: Sequence[str], order: str = TIME, frame: str = "") -> str:
    """OVER clause text; ``TIME`` in ``order`` stands for the time columns of ``part``."""
    order = order.format(time=", ".join(getattr(part, "time", ["ts"])))
    return f"OVER (PARTITION BY {', '.join(f'`{p}`' for p in part)} ORDER BY {order} {frame})"


SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _unit(size: BlockSize):
    return F.floor(F.unix_seconds("ts") / size.unit_seconds)


def _fine_enough(df: DataFrame, keys: list[str], limit: int, size: BlockSize) -> BlockSize:
    """A unit so short that the densest one holds about a quarter of a block."""
    densest = (df.groupBy(*keys, _unit(size).alias("_unit")).agg(F.count(F.lit(1)).alias("_n"))
               .agg(F.max("_n")).first()[0])
    parts = -(-4 * densest // limit)
    return replace(size, unit_seconds=max(1, size.unit_seconds // parts))


def _cuts(df: DataFrame, keys: list[str], halo: int, limit: int, size: BlockSize) -> DataFrame:
    """(series, unit) -> the block that owns the unit's rows and those that need them as halo."""
    by_unit = Window.partitionBy(*keys).orderBy("_unit")
    so_far = by_unit.rowsBetween(Window.unboundedPreceding, 0)
    units = (
        df.groupBy(*keys, _unit(size).alias("_unit")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_end": F.sum("_n").over(so_far), "_total": F.sum("_n").over(Window.partitionBy(*keys))})
        .filter(F.col("_total") > limit)
        .withColumn(BLOCK, F.floor((F.col("_end") - F.col("_n")) / limit).cast("int"))
    )
    # A block holds fewer than 2 * limit rows, so all blocks its rows can be halo for start within
    # that many rows and a halo.
    reach = Window.partitionBy(*keys).orderBy("_start").rangeBetween(0, halo + 2 * limit)
    blocks = (
        units.groupBy(*keys, BLOCK)
        .agg(F.min(F.col("_end") - F.col("_n")).alias("_start"), F.collect_list(F.struct("_unit", "_end")).alias("_units"))
        .withColumn("_next", F.collect_list(F.struct(F.col(BLOCK).alias("block"), F.col("_start").alias("start"))).over(reach))
    )
    return (
        blocks.select(*keys, BLOCK, "_next", F.explode("_units").alias("_u"))
        .select(*keys, BLOCK, F.col("_u._unit").alias("_unit"), F.expr(f"""
            concat(array(struct({BLOCK} AS block, true AS own)),
                   transform(filter(_next, n -> n.block > {BLOCK} AND n.start - _u._end < {halo}),
                             n -> struct(n.block AS block, false AS own)))""").alias("_to"))
    )


def _without_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN in ``columns`` as null; running sums would carry it on."""
    floating = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    held = {c: F.when(~F.isnan(c), F.col(c)) for c in columns if c in floating}
    return df.withColumns(held) if held else df


def split_blocks(df: DataFrame, halo: int, size: BlockSize = DEFAULT,
                 keys: Sequence[str] | None = None, check: Sequence[str] = ()) -> Blocks:
    """Cut series above ``size.rows`` into blocks; runs one counting job. NaN in the ``check`` columns becomes null."""
    keys = list(keys or series_keys(df))
    df = _without_nan(df, check)
    limit = max(size.rows, halo)
    longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if longest is None or longest <= limit:
        return Blocks(df, keys, False)
    size = _fine_enough(df, keys, limit, size)
    cuts = materialize(_cuts(df.select(*keys, "ts"), keys, halo, limit, size), "cuts")
    most = cuts.agg(F.max(BLOCK)).first()[0] + 1
    whole = F.expr("array(struct(0 AS block, true AS own))")
    placed = (
        df.withColumn("_unit", _unit(size)).join(cuts.drop(BLOCK), [*keys, "_unit"], "left")
        .withColumns({SPLIT: F.col("_to").isNotNull(), "_to": F.explode(F.coalesce("_to", whole))})
        .withColumns({BLOCK: F.col("_to.block"), OWN: F.col("_to.own")})
        .drop("_to", "_unit")
    )
    return Blocks(placed, keys, True, most)


def in_blocks(df: DataFrame, halo: int, add: Callable[[DataFrame, Blocks], DataFrame],
              size: BlockSize = DEFAULT, check: Sequence[str] = ()) -> DataFrame:
    """Run ``add(frame, blocks)`` with ``halo`` rows of look-back."""
    blocks = split_blocks(df, halo, size, check=check)
    return blocks.finish(add(blocks.frame, blocks))


def running_sum(df: DataFrame, column: str, out: str, keys: Sequence[str], order: Sequence[str],
                unit_seconds: int = 300) -> DataFrame:
    """Inclusive prefix sum along each series: inside calendar units, plus the units before."""
    marked = df.withColumn("_unit", _unit(BlockSize(unit_seconds=unit_seconds)))
    prior = Window.partitionBy(*keys).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_unit").agg(F.sum(column).alias("_sum"))
        .select(*keys, "_unit", F.coalesce(F.sum("_sum").over(prior), F.lit(0)).alias("_before"))
    )
    inside = F.expr(f"sum({column}) {over([*keys, '_unit'], ', '.join(order), SO_FAR)}")
    return (
        marked.withColumn(out, inside).join(offsets, [*keys, "_unit"])
        .withColumn(out, F.col(out) + F.col("_before")).drop("_before", "_unit")
    )
