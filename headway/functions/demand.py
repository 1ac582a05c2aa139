"""Model input columns per stop and hour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.numbers import decimal_round

NO_SERVICE = 1440
# fixed values: training constants of the normalisations
LOG_MEAN, LOG_STD = 0.153, 0.456
INTERVAL_LOG_MEAN, INTERVAL_LOG_STD = 4.9986, 0.7142
DEMAND_SHIFT, DEMAND_RANGE = 0.3355, 10.691
# fixed values: reference probabilities (interval, demand, min minutes, max minutes, min riders, max riders, probability)
PROBABILITY_BANDS = [
    ("very_long", "zero", 300, 999, 0, 0, 0.90),
    ("long", "zero", 120, 299, 0, 0, 0.70),
    ("medium", "zero", 60, 119, 0, 0, 0.50),
    ("short", "zero", 0, 59, 0, 0, 0.30),
    ("very_long", "low", 300, 999, 1, 2, 0.72),
    ("long", "low", 120, 299, 1, 2, 0.56),
    ("medium", "low", 60, 119, 1, 2, 0.40),
    ("short", "low", 0, 59, 1, 2, 0.24),
]


def _log_z_boarding(boardings: Column) -> Column:
    return (F.log1p(F.coalesce(boardings, F.lit(0)).cast("double")) - LOG_MEAN) / LOG_STD


def _log_z_interval(interval: Column) -> Column:
    minutes = F.greatest(F.coalesce(interval, F.lit(NO_SERVICE)).cast("double"), F.lit(1.0))
    return (F.log(minutes) - INTERVAL_LOG_MEAN) / INTERVAL_LOG_STD


def log_z_boarding(boardings: Column) -> Column:
    return decimal_round(_log_z_boarding(boardings), 4)


def log_z_interval(interval: Column) -> Column:
    return decimal_round(_log_z_interval(interval), 4)


def correct_interval(interval: Column) -> Column:
    return F.when(interval.isNull() | (interval == 0), NO_SERVICE).otherwise(F.abs(interval))


def applicable_interval(weekday: Column, saturday: Column, sunday: Column, dow: Column) -> Column:
    """Interval of the day kind; ``dow`` counts from Sunday = 0."""
    return correct_interval(F.when(dow == 0, sunday).when(dow == 6, saturday).otherwise(weekday))


def service_availability(operational: Column, in_hours: Column) -> Column:
    """0 not running, 1 running day but outside service hours, 2 in service."""
    return F.when(~operational, 0).when(~in_hours, 1).otherwise(2)


def is_rest_day(weekend: Column, holiday: Column) -> Column:
    return weekend | holiday


def drt_probability(boardings: Column, interval: Column, hour: Column, weekend: Column, holiday: Column, availability: Column) -> Column:
    """Need for on-demand service: long intervals raise it, boardings lower it."""
    demand = F.greatest(F.lit(0.05), 1.0 - (_log_z_boarding(boardings) + DEMAND_SHIFT) / DEMAND_RANGE)
    wait = 0.05 + 0.90 / (1 + F.exp(-_log_z_interval(interval)))
    wait = wait * F.when(availability == 0, 1.5).when(availability == 1, 1.2).otherwise(1.0)
    clock = (
        F.when(hour.between(7, 9) | hour.between(17, 19), 1.0)
        .when(hour.between(10, 16), 0.8)
        .when(hour.between(20, 22), 0.6)
        .otherwise(0.4)
    )
    rest = F.when(weekend | holiday, 1.2).otherwise(1.0)
    p = (wait * 0.5 + demand * 0.3 + clock * 0.2) * rest
    return decimal_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), 4)


def probability_bucket(minutes: Column, riders: Column) -> Column:
    """Reference probability of the interval and demand band, NULL outside all bands."""
    chain = reduce(
        lambda c, b: c.when(minutes.between(b[2], b[3]) & riders.between(b[4], b[5]), b[6]), PROBABILITY_BANDS, F
    )
    return chain.otherwise(F.lit(None))


def cyclical_time(df: DataFrame, hour: str = "hour_of_day", dow: str = "day_of_week") -> DataFrame:
    turn = 6.283185307179586
    h, d = F.col(hour) * turn / 24.0, F.col(dow) * turn / 7.0
    return df.withColumns({"hour_sin": F.sin(h), "hour_cos": F.cos(h), "day_sin": F.sin(d), "day_cos": F.cos(d)})
