"""Decimal rounding of binary doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(value, decimals) -> Column:
    """Round by the double's exact binary value, ties to even, as Python's ``round`` does.

    Spark's ``round`` looks at the shortest decimal text, so 2.675 (stored slightly below) would go
    up to 2.68. Splitting the value into two short halves makes each product with the scale exact;
    the sign of what is left over the midpoint then decides.
    """
    x = F.abs(value)
    scale = F.pow(F.lit(10.0), decimals if isinstance(decimals, Column) else F.lit(decimals))
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    rest = x - high
    whole = F.floor(x * scale).cast("double")
    over = (high * scale - (whole + 0.5)) + rest * scale
    odd = F.pmod(whole, F.lit(2.0)) == 1.0
    steps = F.when((over > 0) | ((over == 0) & odd), whole + 1).otherwise(whole)
    # From 2^52 steps on a double has no fraction of a step left to round.
    return F.when(x < F.lit(float(1 << 52)) / scale, F.signum(value) * steps / scale).otherwise(value)


def round_price(price) -> Column:
    """Order price: four decimals below 1, two from 1 upward."""
    return F.when(price < 1, round_exact(price, 4)).otherwise(round_exact(price, 2))


def round_array_style(value, decimals: int = 2) -> Column:
    """Scale, round half to even, scale back: the rule array libraries use."""
    scale = float(10 ** decimals)
    return F.rint(value * scale) / scale
