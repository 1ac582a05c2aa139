"""Unusual-demand patterns over the station-hour table.

Every list is one lazy plan: stops are summed once, the mean stop is a scalar subquery over the
same sums, and the top rows come from TakeOrdered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.calendar import (
    EVENING_RUSH,
    LUNCH_HOURS,
    MORNING_RUSH,
    NIGHT_HOURS,
    day_type,
    month_filter,
)
from headway.functions.numbers import at_least_one, even_round, ratio
from headway.operators.joins import best_per_group, in_district, top_n
from headway.operators.ranking import continuous_percentile

STATION = ["station_id", "station_name", "latitude", "longitude", "district_name", "administrative_dong"]
RUSH_TOP_HOURS = [7, 8, 17, 18, 19]


def of_month(shp: DataFrame, month: str, district: str | None = None) -> DataFrame:
    return in_district(shp.filter(F.col("month_date") == F.lit(month).cast("date")), district)


def demand_top(
    shp: DataFrame,
    month: str,
    hours: list[int] | None,
    measure: str,
    name: str,
    day: str | None = None,
    district: str | None = None,
    n: int = 5,
) -> DataFrame:
    """Stops with the most ``measure`` in the given hours, and their ratio to the mean stop."""
    rows = of_month(shp, month, district)
    if day:
        rows = rows.filter(F.col("day_type") == day)
    if hours:
        rows = rows.filter(F.col("hour").isin(hours))
    per_hour = [F.sum(F.when(F.col("hour") == h, F.col(measure)).otherwise(0)).alias(f"hour_{h}") for h in hours or []]
    stops = rows.groupBy(*STATION).agg(F.sum(measure).alias(name), *per_hour)
    mean = stops.agg((at_least_one(F.sum(name)) / at_least_one(F.count(F.lit(1)))).alias("m")).scalar()
    listed = stops.filter(F.col(name) > 0) if hours else stops
    return ranked(
        top_n(listed.withColumn("vs_average", even_round(F.col(name) / mean, 1)), n, F.desc(name), F.asc("station_id")),
        name,
    )


def ranked(top: DataFrame, value: str, ascending: bool = False) -> DataFrame:
    """Row position inside an already limited list."""
    from pyspark.sql import Window

    first = F.asc(value) if ascending else F.desc(value)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(first, F.asc("station_id"))))


def weekend_peak_hours(shp: DataFrame, month: str, stations: DataFrame, n: int = 3) -> DataFrame:
    """Busiest weekend hours of the given stops as two aligned arrays."""
    hours = (
        of_month(shp, month)
        .filter("day_type = 'weekend'")
        .join(stations.select("station_id"), "station_id", "left_semi")
        .groupBy("station_id", "hour")
        .agg(F.sum("total_traffic").alias("hour_total"))
    )
    best = best_per_group(hours, ["station_id"], n, F.desc("hour_total"), F.asc("hour"), rank="place")
    ordered = best.groupBy("station_id").agg(F.sort_array(F.collect_list(F.struct("place", "hour", "hour_total"))).alias("top"))
    return ordered.select(
        "station_id", F.col("top.hour").alias("peak_hours"), F.col("top.hour_total").alias("peak_traffic")
    )


def weekend_dominant(shp: DataFrame, month: str, district: str | None = None, n: int = 5) -> DataFrame:
    top = demand_top(shp, month, None, "total_traffic", "weekend_total", "weekend", district, n)
    return top.join(weekend_peak_hours(shp, month, top), "station_id")


def night_demand(shp: DataFrame, month: str, district: str | None = None, n: int = 5) -> DataFrame:
    return demand_top(shp, month, NIGHT_HOURS, "total_ride", "total_night_ride", None, district, n)


def night_peak_hour(night: DataFrame) -> DataFrame:
    """First of 23, 0, 1, 2, 3 that reaches the largest of the five counts."""
    top = F.greatest(*[F.col(f"hour_{h}") for h in NIGHT_HOURS])
    return night.withColumn(
        "peak_hour", F.coalesce(*[F.when(F.col(f"hour_{h}") == top, h) for h in NIGHT_HOURS])
    )


def rush_hour(shp: DataFrame, month: str, side: str, district: str | None = None, n: int = 5) -> DataFrame:
    hours = {"morning": MORNING_RUSH, "evening": EVENING_RUSH}[side]
    return demand_top(shp, month, hours, "total_ride", f"total_{side}_rush", "weekday", district, n)


def rush_hour_top(shp: DataFrame, month: str, district: str | None = None, n: int = 5) -> DataFrame:
    return demand_top(shp, month, RUSH_TOP_HOURS, "total_ride", "total_rush_ride", "weekday", district, n)


def lunch_time(shp: DataFrame, month: str, district: str | None = None, n: int = 5) -> DataFrame:
    return demand_top(shp, month, LUNCH_HOURS, "total_alight", "total_lunch_alight", "weekday", district, n)


# fixed values: total traffic from which a score is trusted, as (lower bound, weight)
CONFIDENCE = [(10_000, 1.0), (5_000, 0.8), (2_000, 0.7)]


def area_type(
    shp: DataFrame,
    month: str,
    kind: str,
    district: str | None = None,
    n: int = 5,
    minimum: int = 2000,
    confidence: list[tuple[int, float]] = CONFIDENCE,
) -> DataFrame:
    """Residential stops board in the morning and alight in the evening; business stops mirror it."""
    hour = F.col("hour")

    def part(hours: list[int], c: str) -> Column:
        return F.sum(F.when(hour.isin(hours), F.col(c)).otherwise(0))

    sums = (
        of_month(shp, month, district)
        .filter((F.col("day_type") == "weekday") & hour.isin(MORNING_RUSH + EVENING_RUSH))
        .groupBy(*STATION)
        .agg(
            part(MORNING_RUSH, "total_ride").alias("morning_ride"),
            part(MORNING_RUSH, "total_alight").alias("morning_alight"),
            part(EVENING_RUSH, "total_ride").alias("evening_ride"),
            part(EVENING_RUSH, "total_alight").alias("evening_alight"),
            F.sum("total_traffic").alias("total_traffic"),
        )
    )
    lead = ("morning_ride", "morning_alight", "evening_alight", "evening_ride")
    if kind == "business":
        lead = ("morning_alight", "morning_ride", "evening_ride", "evening_alight")
    am, am_other, pm, pm_other = (F.col(c) for c in lead)
    am_share, pm_share = ratio(am, am + am_other), ratio(pm, pm + pm_other)
    trust = reduce(lambda w, c: w.when(F.col("total_traffic") >= c[0], c[1]), confidence, F).otherwise(0.5)
    scored = sums.filter(
        (F.col("total_traffic") >= minimum) & (am > am_other) & (pm > pm_other) & (am_share > 0.5) & (pm_share > 0.5)
    ).withColumn("imbalance_ratio", F.round((am_share + pm_share) / 2 * trust * 100, 1))
    return ranked(top_n(scored, n, F.desc("imbalance_ratio"), F.asc("station_id")), "imbalance_ratio")


def underutilized(shp: DataFrame, month: str, district: str | None = None, n: int = 5) -> DataFrame:
    """Stops in the lowest quarter of monthly traffic, least used first."""
    stops = (
        of_month(shp, month, district)
        .groupBy(*STATION)
        .agg(
            F.round(F.avg("total_traffic"), 0).alias("avg_daily_passengers"),
            F.max("total_traffic").alias("max_daily_passengers"),
            F.max("route_count").alias("connecting_routes"),
            F.sum("total_traffic").alias("total_monthly_traffic"),
        )
    )
    bar = continuous_percentile(stops, "total_monthly_traffic", 0.25)
    mean = stops.agg(F.avg("avg_daily_passengers").alias("m")).scalar()
    used = F.col("avg_daily_passengers")
    low = stops.filter((F.col("total_monthly_traffic") <= bar) & (used > 0)).withColumns(
        {
            "utilization_rate": F.round(used / mean * 100, 1),
            "efficiency_score": F.round(used / F.greatest(F.coalesce("connecting_routes", F.lit(1)), F.lit(1)), 1),
        }
    )
    return top_n(low, n, F.asc("avg_daily_passengers"), F.asc("efficiency_score"), F.asc("station_id"))


def anomaly_integration(shp: DataFrame, month: str, district: str | None = None, n: int = 5) -> DataFrame:
    """All patterns as one long table: pattern, station, district, value."""
    parts = {
        "weekend_dominant": (demand_top(shp, month, None, "total_traffic", "v", "weekend", district, n), "v"),
        "night_demand": (night_demand(shp, month, district, n), "total_night_ride"),
        "rush_morning": (rush_hour(shp, month, "morning", district, n), "total_morning_rush"),
        "rush_evening": (rush_hour(shp, month, "evening", district, n), "total_evening_rush"),
        "lunch_time": (lunch_time(shp, month, district, n), "total_lunch_alight"),
        "residential": (area_type(shp, month, "residential", district, n), "imbalance_ratio"),
        "business": (area_type(shp, month, "business", district, n), "imbalance_ratio"),
        "underutilized": (underutilized(shp, month, district, n), "avg_daily_passengers"),
    }
    rows = [
        df.select(F.lit(name).alias("pattern"), "station_id", "district_name", F.col(v).cast("double").alias("value"))
        for name, (df, v) in parts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def rush_summary(morning: DataFrame, evening: DataFrame) -> DataFrame:
    m = morning.agg(F.sum("total_morning_rush").alias("morning_total"), F.max("total_morning_rush").alias("morning_max"))
    e = evening.agg(F.struct(F.sum("total_evening_rush").alias("t"), F.max("total_evening_rush").alias("x"))).scalar()
    return m.withColumns(
        {
            "evening_total": e.getField("t"),
            "evening_max": e.getField("x"),
            "morning_evening_ratio": F.round(ratio(F.col("morning_total"), e.getField("t")), 2),
        }
    )


def area_summary(residential: DataFrame, business: DataFrame) -> DataFrame:
    kind = residential.withColumn("kind", F.lit("r")).unionByName(business.withColumn("kind", F.lit("b")))
    of = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0))
    top = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(1)), F.lit(1))
    return kind.agg(
        of("r", "morning_ride").alias("residential_morning_ride"),
        of("b", "morning_alight").alias("business_morning_alight"),
        of("r", "evening_alight").alias("residential_evening_alight"),
        of("b", "evening_ride").alias("business_evening_ride"),
        F.round(F.max("imbalance_ratio"), 1).alias("max_imbalance"),
        F.round(F.avg("imbalance_ratio"), 1).alias("mean_imbalance"),
        *[top(c).alias(f"max_{c}") for c in ("morning_ride", "morning_alight", "evening_ride", "evening_alight")],
    )


def district_averages(sph: DataFrame, sm: DataFrame, month: str) -> DataFrame:
    """Mean indicators of every district.

    A stop weighs as many times as it has (day type, hour) rows; stops without both day types
    are left out. Two nested aggregations give that weighting without joining rows to rows.
    """
    traffic = F.col("ride_passenger") + F.col("alight_passenger")
    base = (
        sph.filter(month_filter(F.col("record_date"), month))
        .filter(traffic > 0)
        .groupBy("node_id", day_type(F.col("record_date")).alias("day_type"), "hour")
        .agg(
            F.avg("alight_passenger").alias("avg_alight"),
            F.avg(traffic).alias("avg_total"),
            F.stddev_samp(traffic).alias("std_total"),
        )
    )
    hour, total = F.col("hour"), F.col("avg_total")
    side = lambda d: F.avg(F.when(F.col("day_type") == d, total))
    per_stop = (
        base.groupBy("node_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            side("weekend").alias("we"),
            side("weekday").alias("wd"),
            (F.sum(F.when(hour.isin(NIGHT_HOURS), total).otherwise(0)) / F.sum(total) * 100).alias("night"),
            F.sum(F.when(hour.isin(MORNING_RUSH + EVENING_RUSH), total).otherwise(0)).alias("rush"),
            F.sum(F.when(hour.isin(LUNCH_HOURS), F.col("avg_alight")).otherwise(0)).alias("lunch"),
            F.sum("avg_alight").alias("alight"),
            F.sum(F.col("std_total") / total).alias("cv"),
            F.count("std_total").alias("cv_n"),
        )
        .filter("we IS NOT NULL AND wd IS NOT NULL")
    )
    weighted = lambda c: F.sum(c * F.col("n")) / F.sum("n")
    return (
        per_stop.join(sm.select("node_id", "sgg_name"), "node_id")
        .groupBy(F.col("sgg_name").alias("district_name"))
        .agg(
            weighted((F.col("we") - F.col("wd")) / F.col("wd") * 100).alias("avg_weekend_increase_pct"),
            weighted(F.col("night")).alias("avg_night_traffic_ratio"),
            (F.sum("rush") / F.sum("n")).alias("avg_rush_hour_traffic"),
            (ratio(F.sum("lunch"), F.sum("alight")) * 100).alias("avg_lunch_spike_pct"),
            ratio(F.sum("cv"), F.sum("cv_n")).alias("avg_cv_coefficient"),
            F.count(F.lit(1)).alias("total_stations"),
        )
    )
