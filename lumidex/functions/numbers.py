"""Small numeric and array helpers as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """Evaluates ``value`` once and hands it on as a variable."""
    return F.transform(F.array(value), use)[0]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up, spelled out, so that every engine agrees."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def log_ramp(x: Column, low: float, high: float) -> Column:
    """0 at ``low`` and 1 at ``high`` on a logarithmic scale; 0 for what is not positive."""
    ramp = (F.log10(F.when(x > 0, x)) - math.log10(low)) / (math.log10(high) - math.log10(low))
    return F.coalesce(clamp(ramp), F.lit(0.0))


def plateau(x: Column, low: float, high: float, falloff: float) -> Column:
    """1 inside the band, falling linearly to 0 over ``falloff`` outside it."""
    apart = F.greatest(low - x, x - high, F.lit(0.0))
    return clamp(1.0 - apart / falloff)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return let(values, lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)).otherwise(0.0))


def variance(values: Column) -> Column:
    """Population variance; 0 for no values."""
    return let(values, lambda v: let(mean(v), lambda m: mean(F.transform(v, lambda x: (x - m) * (x - m)))))


def median(values: Column) -> Column:
    """Mean of the middle two where their number is even; 0 for no values."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2).otherwise(0.0)

    return let(F.sort_array(values), middle)
