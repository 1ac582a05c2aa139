"""Small numeric guards used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, NULL when the whole is 0 or NULL."""
    return F.when(whole != 0, part.cast("double") / whole)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def at_least_one(value: Column) -> Column:
    """NULL and 0 become 1, the guard in front of a division."""
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit(1)).otherwise(value)


def sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def cap_one(value: Column) -> Column:
    return F.least(value, F.lit(1.0))


def decimal_round(value: Column, places: int) -> Column:
    """Round half away from zero as exact decimals would.

    The first, finer rounding removes binary noise, so that a sum that is a decimal half in
    exact arithmetic is still seen as one.
    """
    return F.round(F.round(value, places + 6), places)


def even_round(value: Column, places: int) -> Column:
    """Round halves to the even neighbour, after removing binary noise."""
    return F.bround(F.round(value, places + 6), places)
