"""Daily origin–destination rows and the monthly pair summary."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions import geo
from headway.functions.calendar import date_parts, month_filter
from headway.functions.numbers import decimal_round, ratio, ratio_or_zero

HOURS = [f"h{h:02d}" for h in range(24)]
BANDS = {
    "morning": [7, 8, 9],
    "evening": [17, 18, 19],
    "night": [22, 23, 0, 1, 2, 3, 4, 5],
    "daytime": list(range(10, 17)),
}
BAND_SUMS = {
    "morning": "morning_peak_passengers",
    "evening": "evening_peak_passengers",
    "night": "night_passengers",
    "daytime": "daytime_passengers",
}
# fixed values: labels of the monthly table
FREQUENCY = [(13, "거의매일 (13-16일)"), (9, "고빈도 (9-12일)"), (5, "중빈도 (5-8일)")]
EVERY_DAY, SELDOM = "매일", "저빈도 (<5일)"
ADVICE = ("DRT 최우선고려구간", "DRT 우선고려구간", "DRT 고려구간", "DRT 검토 가능", "기존 서비스")
METADATA = ("station_name", "coordinates_x", "coordinates_y", "district_code", "district_name", "admin_dong")
DEFAULT_EVERY_DAY = 17


def hour_total(hours: list[int]) -> Column:
    return reduce(add, [F.coalesce(F.col(HOURS[h]), F.lit(0)) for h in hours])


def collect_routes_per_stop(route_stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes calling at each stop; one entry per (route, position), as a stop may recur."""
    r = routes.select(
        "route_id",
        "route_name",
        "route_type",
        F.coalesce(F.expr("try_cast(route_type AS int)"), F.lit(0)).alias("route_type_code"),
        "total_distance_km",
        "dispatch_interval",
    )
    entry = F.struct(
        "route_id",
        F.col("node_sequence").alias("stop_sequence"),
        "route_name",
        "route_type",
        "route_type_code",
        "total_distance_km",
        "dispatch_interval",
    )
    return (
        route_stops.filter("is_active")
        .join(r, "route_id")
        .groupBy(F.col("stop_id").alias("station_id"))
        .agg(F.sort_array(F.collect_set(entry)).alias("routes"))
    )


def route_ids(routes: Column) -> Column:
    return F.array_distinct(F.transform(routes, lambda r: r["route_id"]))


def route_overlap(df: DataFrame) -> DataFrame:
    """Common and one-sided routes; repeated entries of a route are kept.

    The distinct route ids of both ends come with the stops (``od_enrich``), so a row tests its
    entries against a ready list.
    """
    def keep(side: str, other: str, shared: bool) -> Column:
        ids = F.col(f"{other}_route_ids")
        return F.filter(f"{side}_routes", lambda x: F.array_contains(ids, x["route_id"]) == F.lit(shared))

    return df.withColumns(
        {
            "common_routes": keep("from", "to", True),
            "from_only_routes": keep("from", "to", False),
            "to_only_routes": keep("to", "from", False),
        }
    ).drop("from_route_ids", "to_route_ids")


def od_enrich(od: DataFrame, stops: DataFrame, stop_routes: DataFrame) -> DataFrame:
    """Metadata of both ends. Rows with an unknown or inactive end are dropped."""
    kind = stop_routes.schema["routes"].dataType
    known = (
        stops.filter("is_active")
        .join(stop_routes, "station_id", "left")
        .withColumn("routes", F.coalesce("routes", F.array().cast(kind)))
        .withColumn("route_ids", route_ids(F.col("routes")))
    )

    def end(side: str) -> DataFrame:
        return known.select(
            F.col("station_id").alias(f"{side}_station_id"),
            F.col("station_name").alias(f"{side}_station_name"),
            F.col("longitude").alias(f"{side}_coordinates_x"),
            F.col("latitude").alias(f"{side}_coordinates_y"),
            F.col("district").alias(f"{side}_district_code"),
            F.col("district").alias(f"{side}_district_name"),
            F.col("admin_dong").alias(f"{side}_admin_dong"),
            F.col("routes").alias(f"{side}_routes"),
            F.col("route_ids").alias(f"{side}_route_ids"),
        )

    return od.join(end("from"), "from_station_id").join(end("to"), "to_station_id")


def daily_od_build(od: DataFrame, stops: DataFrame, stop_routes: DataFrame) -> DataFrame:
    """Wide OD counts to the daily table: metadata, distance, hours, connectivity."""
    used = od.filter(hour_total(list(range(24))) > 0).withColumnRenamed("record_date", "analysis_date")
    km = geo.haversine_km(
        F.col("from_coordinates_y"), F.col("from_coordinates_x"), F.col("to_coordinates_y"), F.col("to_coordinates_x")
    )
    return (
        route_overlap(od_enrich(used, stops, stop_routes))
        .withColumn("estimated_distance_km", km)
        .withColumn("direct_connection_count", F.size("common_routes"))
        .withColumn("transfer_required", F.size("common_routes") == 0)
    )


def daily_od_generated(daily: DataFrame) -> DataFrame:
    """Columns derived from the hour counts and the date."""
    total = F.col("total_passengers")
    return (
        date_parts(daily, "analysis_date")
        .withColumn("total_passengers", hour_total(list(range(24))))
        .withColumns({BAND_SUMS[b]: hour_total(h) for b, h in BANDS.items()})
        .withColumns(
            {f"{b}_concentration": decimal_round(ratio_or_zero(F.col(BAND_SUMS[b]), total), 4) for b in BANDS}
        )
    )


def monthly_od_aggregation(daily: DataFrame, month: str | None = None) -> DataFrame:
    """One row per month and pair. All measures are mergeable, so each day's rows shrink before
    the shuffle; the route arrays of the earliest day stand for the month. With ``month``, only
    that month's days are read."""
    if month is not None:
        daily = daily.filter(month_filter(F.col("analysis_date"), month))
    total, weekend = F.col("total_passengers"), F.col("is_weekend")
    side = lambda w, c=total: F.when(weekend if w else ~weekend, c)
    meta = [F.mode(F.col(f"{e}_{c}"), True).alias(f"{e}_{c}") for e in ("from", "to") for c in METADATA]
    return (
        daily.groupBy(F.trunc("analysis_date", "month").alias("analysis_month"), "from_station_id", "to_station_id")
        .agg(
            *meta,
            F.count(F.lit(1)).alias("appearance_days"),
            F.count(side(False)).alias("weekday_appearances"),
            F.count(side(True)).alias("weekend_appearances"),
            F.sum(total).alias("monthly_total_passengers"),
            F.avg(total).alias("daily_avg_passengers"),
            F.max(total).alias("daily_max_passengers"),
            F.min(F.when(total > 0, total)).alias("daily_min_passengers"),
            F.stddev_samp(total).alias("daily_stddev_passengers"),
            *[F.sum(h).alias(f"monthly_{h}") for h in HOURS],
            F.sum(BAND_SUMS["morning"]).alias("monthly_morning_peak"),
            F.sum(BAND_SUMS["evening"]).alias("monthly_evening_peak"),
            F.sum(BAND_SUMS["night"]).alias("monthly_night"),
            F.sum(BAND_SUMS["daytime"]).alias("monthly_daytime"),
            F.sum(side(False)).alias("weekday_total_passengers"),
            F.sum(side(True)).alias("weekend_total_passengers"),
            F.avg(side(False)).alias("weekday_avg_passengers"),
            F.avg(side(True)).alias("weekend_avg_passengers"),
            *[F.avg(f"{b}_concentration").alias(f"avg_{b}_concentration") for b in BANDS],
            F.max("estimated_distance_km").alias("avg_distance_km"),
            F.max("direct_connection_count").alias("min_direct_connections"),
            F.bool_or("transfer_required").alias("ever_transfer_required"),
            F.min_by(F.struct("common_routes", "from_routes", "to_routes"), "analysis_date").alias("_routes"),
        )
        .withColumns({c: F.col(f"_routes.{c}") for c in ("common_routes", "from_routes", "to_routes")})
        .drop("_routes")
    )


def frequency_class(days: Column, every_day: int = DEFAULT_EVERY_DAY) -> Column:
    out = F.when(days == every_day, EVERY_DAY)
    for least, label in FREQUENCY:
        out = out.when(days >= least, label)
    return out.otherwise(SELDOM)


def od_cv(deviation: Column, mean: Column) -> Column:
    return F.when(deviation.isNotNull() & (mean > 0), deviation / mean)


def od_weekend_ratio(weekend: Column, weekday: Column) -> Column:
    return F.when(weekday > 0, ratio(weekend, weekday))


def dispatch_stats(routes: Column) -> dict[str, Column]:
    """Mean, largest and smallest known interval in a route array; NULL when none is known."""
    known = F.filter(F.transform(routes, lambda r: r["dispatch_interval"]), lambda i: i.isNotNull())
    total = F.aggregate(known, F.lit(0), lambda a, i: a + i)
    return {
        "avg_dispatch_interval": ratio(total, F.size(known)),
        "max_dispatch_interval": F.array_max(known),
        "min_dispatch_interval": F.array_min(known),
    }


def priority_scores(df: DataFrame) -> DataFrame:
    """Four priorities. Means above 99 and below 100 score in neither p1 nor p2."""
    mean, km = F.col("daily_avg_passengers"), F.col("avg_distance_km")
    transfer, direct = F.col("ever_transfer_required"), F.col("min_direct_connections")
    points = lambda test, n: F.when(test, n).otherwise(0)
    wait = F.col("avg_dispatch_interval")
    names = ["p1_score", "p2_score", "p3_score", "p4_score"]
    return (
        df.withColumns(
            {
                "p1_score": points(transfer & (mean >= 100), 10),
                "p2_score": points(transfer & mean.between(20, 99), 5),
                "p3_score": points((direct <= 2) & ~transfer & (mean >= 100), 3),
                "p4_score": points((mean < 50) & (km >= 5), 1),
            }
        )
        .withColumn("drt_priority_score", reduce(add, [F.col(n) for n in names]))
        .withColumn(
            "adjusted_drt_priority_score",
            F.col("drt_priority_score") + F.when(wait > 30, 2).when(wait > 20, 1).otherwise(0),
        )
    )


def recommendation(df: DataFrame) -> Column:
    mean, km = F.col("daily_avg_passengers"), F.col("avg_distance_km")
    transfer, direct = F.col("ever_transfer_required"), F.col("min_direct_connections")
    return (
        F.when(transfer & (mean >= 100), ADVICE[0])
        .when(transfer & (mean >= 20), ADVICE[1])
        .when((direct <= 2) & (mean >= 100), ADVICE[2])
        .when((mean < 50) & (km >= 5), ADVICE[3])
        .otherwise(ADVICE[4])
    )


def node_numbers(monthly: DataFrame, stops: DataFrame) -> DataFrame:
    """Public stop numbers of both ends (left lookups)."""
    out = monthly
    for side in ("from", "to"):
        num = stops.select(F.col("node_id").alias(f"{side}_station_id"), F.col("node_num").alias(f"{side}_station_num"))
        out = out.join(num, f"{side}_station_id", "left")
    return out


def monthly_od_summary(daily: DataFrame, stops: DataFrame, every_day: int = DEFAULT_EVERY_DAY, month: str | None = None) -> DataFrame:
    base = node_numbers(monthly_od_aggregation(daily, month), stops).withColumns(
        {
            "frequency_category": frequency_class(F.col("appearance_days"), every_day),
            "cv_coefficient": od_cv(F.col("daily_stddev_passengers"), F.col("daily_avg_passengers")),
            "weekend_weekday_ratio": od_weekend_ratio(F.col("weekend_total_passengers"), F.col("weekday_total_passengers")),
            **dispatch_stats(F.col("common_routes")),
        }
    )
    scored = priority_scores(base)
    return scored.withColumn("drt_recommendation", recommendation(scored))
