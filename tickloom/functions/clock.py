"""Exchange-local wall clock and candle grid, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.schema import MARKET_ZONE


def instant(value) -> Column:
    """A column as it is; text or a datetime as a literal read in the session's zone (UTC)."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def local(ts) -> Column:
    """Wall clock in the market's zone."""
    return F.from_utc_timestamp(ts, MARKET_ZONE)


def local_date(ts) -> Column:
    return F.to_date(local(ts))


def local_minute(ts) -> Column:
    return F.minute(local(ts))


def second_of_day(ts) -> Column:
    wall = local(ts)
    return F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)


def clock_seconds(text: str) -> int:
    """'09:30' or '09:30:15' as seconds after midnight."""
    parts = [int(p) for p in text.split(":")]
    return sum(p * unit for p, unit in zip(parts, (3600, 60, 1)))


def local_midnight(ts) -> Column:
    """The instant at which the market-local day of ``ts`` began."""
    return F.to_utc_timestamp(F.date_trunc("day", local(ts)), MARKET_ZONE)


def grid_bucket(ts, minutes, first_ts) -> Column:
    """Left edge of the candle holding ``ts``.

    The grid starts at local midnight of the series' first day and then steps in absolute time, so
    it drifts against the wall clock after a DST change.
    """
    origin = F.unix_micros(local_midnight(first_ts))
    width = F.lit(minutes).cast("bigint") * F.lit(60_000_000).cast("bigint")
    offset = F.unix_micros(ts) - origin
    return F.timestamp_micros(origin + (offset - F.pmod(offset, width)))


def even_bucket(ts, minutes) -> Column:
    """``grid_bucket`` for widths that divide the hour; needs no first timestamp."""
    width = F.lit(minutes).cast("bigint") * F.lit(60_000_000).cast("bigint")
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, width))
