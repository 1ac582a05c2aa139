"""Base aggregate tables over station-hour facts.

District tables are built in two steps: facts shrink to one row per stop (and hour) first, so
the join and the district shuffle carry stops instead of fact rows, and the number of stops in a
group is a plain count. Days are counted by bit masks; both choices avoid distinct expansion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.calendar import day_type, days_present, hours_present, month_bucket, month_filter
from headway.operators.joins import in_city, never_broadcast

NO_DONG = "정보없음"


def dated(sph: DataFrame, month: str | None = None) -> DataFrame:
    """Facts with their month, day type and traffic; with ``month``, only that month's.

    The month is a range on the bare date, so the scan reads only its files and row groups.
    """
    facts = sph if month is None else sph.filter(month_filter(F.col("record_date"), month))
    return facts.withColumns(
        {
            "month_date": month_bucket(F.col("record_date")),
            "day_type": day_type(F.col("record_date")),
            "traffic": F.col("ride_passenger") + F.col("alight_passenger"),
        }
    )


def _day_mask() -> Column:
    return F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth("record_date") - 1))


def _sums() -> list[Column]:
    return [
        F.sum("ride_passenger").alias("ride"),
        F.sum("alight_passenger").alias("alight"),
        F.sum("traffic").alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.max("ride_passenger").alias("max_ride"),
        F.max("alight_passenger").alias("max_alight"),
        F.min("ride_passenger").alias("min_ride"),
        F.min("alight_passenger").alias("min_alight"),
        F.max("traffic").alias("max_total"),
        F.min("traffic").alias("min_total"),
        _day_mask().alias("days"),
    ]


def hourly_traffic_patterns(sph: DataFrame, sm: DataFrame) -> DataFrame:
    per_stop = dated(sph).groupBy("month_date", "day_type", "node_id", "hour").agg(*_sums())
    mean = lambda c: F.round(F.sum(c) / F.sum("n"), 2)
    return (
        per_stop.join(in_city(sm), "node_id")
        .groupBy("month_date", "day_type", "sgg_code", "sgg_name", "hour")
        .agg(
            mean("ride").alias("avg_ride_passengers"),
            mean("alight").alias("avg_alight_passengers"),
            mean("total").alias("avg_total_passengers"),
            F.max("max_ride").alias("max_ride_passengers"),
            F.max("max_alight").alias("max_alight_passengers"),
            F.min("min_ride").alias("min_ride_passengers"),
            F.min("min_alight").alias("min_alight_passengers"),
            F.sum("n").alias("sample_count"),
            F.count(F.lit(1)).alias("station_count"),
            F.bit_count(F.bit_or("days")).alias("day_count"),
        )
    )


def district_monthly_traffic(sph: DataFrame, sm: DataFrame, month: str | None = None) -> DataFrame:
    """Sums and exact quartiles. The quartiles work on (stop, value) counts, so their state is
    the number of different hourly totals, not the number of rows."""
    histogram = (
        dated(sph, month)
        .groupBy("month_date", "node_id", "traffic")
        .agg(
            F.sum("ride_passenger").alias("ride"),
            F.sum("alight_passenger").alias("alight"),
            F.count(F.lit(1)).alias("n"),
            _day_mask().alias("days"),
        )
        .join(in_city(sm), "node_id")
    )
    q = F.percentile(F.col("traffic"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    return (
        histogram.groupBy("month_date", "sgg_code", "sgg_name")
        .agg(
            F.sum("ride").alias("total_ride"),
            F.sum("alight").alias("total_alight"),
            F.sum(F.col("traffic") * F.col("n")).alias("total_traffic"),
            F.round(F.sum(F.col("traffic") * F.col("n")) / F.sum("n"), 2).alias("avg_daily_traffic"),
            F.countDistinct("node_id").alias("station_count"),
            F.bit_count(F.bit_or("days")).alias("operating_days"),
            q.alias("q"),
            F.max("traffic").alias("max_hourly_traffic"),
            F.min("traffic").alias("min_hourly_traffic"),
        )
        .withColumns({f"q{i}_traffic": F.col("q")[i - 1] for i in (1, 2, 3)})
        .drop("q")
        .withColumnsRenamed({"sgg_code": "district_code", "sgg_name": "district_name"})
    )


def station_monthly_traffic(sph: DataFrame, sm: DataFrame, stops: DataFrame, month: str | None = None) -> DataFrame:
    per_stop = (
        dated(sph, month)
        .groupBy("month_date", "node_id")
        .agg(
            F.sum("ride_passenger").alias("total_ride"),
            F.sum("alight_passenger").alias("total_alight"),
            F.sum("traffic").alias("total_traffic"),
            F.round(F.sum("traffic") / F.count(F.lit(1)), 2).alias("daily_average"),
            days_present(F.col("record_date")).alias("operating_days"),
            F.countDistinct("route_id").alias("route_count"),
            hours_present(F.col("hour")).alias("operating_hours"),
        )
    )
    return (
        per_stop.join(in_city(sm), "node_id")
        .join(never_broadcast(stops), "node_id")
        .select(
            "month_date",
            "sgg_code",
            F.col("sgg_name").alias("district_name"),
            F.col("node_id").alias("station_id"),
            F.col("node_name").alias("station_name"),
            "latitude",
            "longitude",
            "total_ride",
            "total_alight",
            "total_traffic",
            "daily_average",
            "operating_days",
            "route_count",
            "operating_hours",
        )
    )


def city_hourly_patterns(district_hours: DataFrame) -> DataFrame:
    weighted = lambda c: F.sum(F.col(c) * F.col("sample_count")) / F.sum("sample_count")
    means = ("avg_ride_passengers", "avg_alight_passengers", "avg_total_passengers")
    return district_hours.groupBy("month_date", "day_type", "hour").agg(
        *[weighted(c).alias(c) for c in means],
        F.max("max_ride_passengers").alias("max_ride_passengers"),
        F.max("max_alight_passengers").alias("max_alight_passengers"),
        F.sum("sample_count").alias("total_samples"),
        F.sum("station_count").alias("total_stations"),
    )


def station_hourly_patterns(sph: DataFrame, sm: DataFrame, stops: DataFrame, month: str | None = None) -> DataFrame:
    """Month × day type × stop × hour, the base of the score, anomaly and heat-map builders.

    A question about one month passes it as ``month``.
    """
    per_stop = (
        dated(sph, month)
        .groupBy("month_date", "day_type", "node_id", "hour")
        .agg(
            F.sum("ride_passenger").alias("total_ride"),
            F.sum("alight_passenger").alias("total_alight"),
            F.sum("traffic").alias("total_traffic"),
            days_present(F.col("record_date")).alias("operating_days"),
            F.countDistinct("route_id").alias("route_count"),
            F.count(F.lit(1)).alias("record_count"),
        )
    )
    return (
        per_stop.join(in_city(sm), "node_id")
        .join(never_broadcast(stops), "node_id")
        .select(
            "month_date",
            "day_type",
            "sgg_code",
            F.col("sgg_name").alias("district_name"),
            F.col("node_id").alias("station_id"),
            F.col("node_name").alias("station_name"),
            "longitude",
            "latitude",
            F.coalesce("adm_name", F.lit(NO_DONG)).alias("administrative_dong"),
            "hour",
            "total_ride",
            "total_alight",
            "total_traffic",
            "operating_days",
            "route_count",
            "record_count",
        )
    )


def monthly_district_summary(sph: DataFrame, sm: DataFrame) -> DataFrame:
    per_stop = dated(sph).groupBy("month_date", "node_id").agg(*_sums())
    return (
        per_stop.join(in_city(sm), "node_id")
        .groupBy(F.col("month_date").alias("analysis_month"), "sgg_code", "sgg_name")
        .agg(
            F.count(F.lit(1)).alias("station_count"),
            F.sum("total").alias("total_traffic"),
            F.sum("ride").alias("total_ride"),
            F.sum("alight").alias("total_alight"),
            (F.sum("total") / F.sum("n")).alias("avg_daily_traffic"),
            F.max("max_total").alias("max_daily_traffic"),
        )
    )


def _daily(facts: DataFrame, *keys: str) -> DataFrame:
    """Totals with distinct stations and routes. Rows are merged by station and, apart from that, by route, so that
    no row is doubled for the two distinct counts; what is joined has one row per ``keys``."""
    ride, alight = F.col("ride_passenger"), F.col("alight_passenger")
    stations = facts.groupBy(*keys, "node_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(ride).alias("rides"), F.count(alight).alias("alights"),
        F.sum(ride).alias("ride"), F.sum(alight).alias("alight"), F.sum(ride + alight).alias("total"),
        F.max(ride).alias("max_ride"), F.max(alight).alias("max_alight"),
    )
    totals = stations.groupBy(*keys).agg(
        F.sum("n").alias("total_records"),
        F.sum("ride").alias("total_boarding"),
        F.sum("alight").alias("total_alighting"),
        F.sum("total").alias("total_traffic"),
        F.try_divide(F.sum("ride"), F.sum("rides")).alias("avg_boarding"),
        F.try_divide(F.sum("alight"), F.sum("alights")).alias("avg_alighting"),
        F.max("max_ride").alias("max_boarding"),
        F.max("max_alight").alias("max_alighting"),
        F.count("node_id").alias("active_stations"),
    )
    routes = facts.select(*keys, "route_id").distinct().groupBy(*keys).agg(F.count("route_id").alias("active_routes"))
    return totals.join(routes, [*keys])


def daily_traffic_summary(sph: DataFrame) -> DataFrame:
    return _daily(sph, "record_date")


def daily_hourly_traffic(sph: DataFrame) -> DataFrame:
    return _daily(sph, "record_date", "hour").drop("total_records", "max_boarding", "max_alighting")


def daily_district_traffic(sph: DataFrame, sm: DataFrame) -> DataFrame:
    per_stop_route = sph.groupBy("record_date", "node_id", "route_id").agg(
        F.sum("ride_passenger").alias("ride"), F.sum("alight_passenger").alias("alight"), F.count(F.lit(1)).alias("n")
    )
    return (
        per_stop_route.join(in_city(sm), "node_id")
        .groupBy("record_date", F.col("sgg_name").alias("district_name"))
        .agg(
            F.sum("ride").alias("total_boarding"),
            F.sum("alight").alias("total_alighting"),
            F.sum(F.col("ride") + F.col("alight")).alias("total_traffic"),
            (F.sum("ride") / F.sum("n")).alias("avg_boarding"),
            (F.sum("alight") / F.sum("n")).alias("avg_alighting"),
            F.countDistinct("node_id").alias("active_stations"),
            F.countDistinct("route_id").alias("active_routes"),
        )
    )


def daily_station_traffic(sph: DataFrame, sm: DataFrame, over: int = 100) -> DataFrame:
    """Days of a stop with more than ``over`` passengers; unmapped stops stay, without district."""
    per_stop = (
        sph.groupBy("record_date", "node_id")
        .agg(
            F.sum("ride_passenger").alias("total_boarding"),
            F.sum("alight_passenger").alias("total_alighting"),
            F.sum(F.col("ride_passenger") + F.col("alight_passenger")).alias("total_traffic"),
            F.countDistinct("route_id").alias("route_count"),
        )
        .filter(F.col("total_traffic") > over)
    )
    return per_stop.join(sm.select("node_id", F.col("sgg_name").alias("district_name")), "node_id", "left")


def period_summary(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.min("record_date").alias("period_start"),
        F.max("record_date").alias("period_end"),
        F.countDistinct("record_date").alias("total_days"),
        F.sum("total_boarding").alias("total_boarding"),
        F.sum("total_alighting").alias("total_alighting"),
        F.sum("total_traffic").alias("total_traffic"),
        F.avg("total_traffic").alias("avg_daily_traffic"),
        F.max("total_traffic").alias("max_daily_traffic"),
        F.min("total_traffic").alias("min_daily_traffic"),
        (F.sum("active_stations") / F.count(F.lit(1))).alias("avg_active_stations"),
        (F.sum("active_routes") / F.count(F.lit(1))).alias("avg_active_routes"),
    )


def hourly_pattern(daily_hours: DataFrame) -> DataFrame:
    return daily_hours.groupBy("hour").agg(
        F.sum("total_boarding").alias("total_boarding"),
        F.sum("total_alighting").alias("total_alighting"),
        F.sum("total_traffic").alias("total_traffic"),
        F.avg("total_traffic").alias("avg_traffic"),
        F.count(F.lit(1)).alias("data_points"),
    )


def district_ranking(daily_districts: DataFrame) -> DataFrame:
    """RANK by total traffic. The window sees one row per district, after the aggregation."""
    totals = daily_districts.groupBy("district_name").agg(
        F.sum("total_boarding").alias("total_boarding"),
        F.sum("total_alighting").alias("total_alighting"),
        F.sum("total_traffic").alias("total_traffic"),
        F.avg("total_traffic").alias("avg_daily_traffic"),
        F.count(F.lit(1)).alias("data_points"),
    )
    return rank_districts(totals, "total_traffic", "traffic_rank")


def rank_districts(per_district: DataFrame, value: str, name: str, unique: bool = False) -> DataFrame:
    """City-wide rank over an already aggregated frame of one row per district."""
    if unique:
        w = Window.orderBy(F.desc(value), F.asc("district_name"))
        return per_district.withColumn(name, F.row_number().over(w))
    return per_district.withColumn(name, F.rank().over(Window.orderBy(F.desc(value))))


def stop_weekly_avg(usage: DataFrame, stops: DataFrame, today: str) -> DataFrame:
    recent = usage.filter(
        F.col("recorded_at") >= F.date_sub(F.lit(today).cast("date"), 7).cast("timestamp_ntz")
    ).filter("is_operational")
    means = recent.groupBy("stop_id").agg(
        F.avg("boarding_count").alias("avg_boarding"),
        F.avg("alighting_count").alias("avg_alighting"),
        F.countDistinct(F.col("recorded_at").cast("date")).alias("days_with_data"),
    )
    return means.join(stops.select(F.col("node_id").alias("stop_id"), F.col("node_name").alias("stop_name")), "stop_id")


def stop_route_stats(route_stops: DataFrame, routes: DataFrame, missing: int = 1440) -> DataFrame:
    mean = lambda c: F.coalesce(F.round(F.avg(c), 0), F.lit(float(missing)))
    return (
        route_stops.join(routes, "route_id", "left")
        .groupBy("stop_id")
        .agg(
            mean("dispatch_interval").alias("avg_weekday_interval"),
            mean("saturday_interval").alias("avg_saturday_interval"),
            mean("sunday_interval").alias("avg_sunday_interval"),
            F.countDistinct(F.when(F.col("route_name").isNotNull(), F.col("route_id"))).alias("route_count"),
        )
    )


def heatmap_query_totals(sph: DataFrame, sm: DataFrame, start: str, end: str) -> DataFrame:
    """District totals over a date range, largest first."""
    per_stop = (
        sph.filter(F.col("record_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy("node_id")
        .agg(
            F.sum("ride_passenger").alias("ride"),
            F.sum("alight_passenger").alias("alight"),
        )
    )
    return (
        per_stop.join(in_city(sm), "node_id")
        .groupBy(F.col("sgg_name").alias("district_name"))
        .agg(
            F.sum("ride").alias("total_ride"),
            F.sum("alight").alias("total_alight"),
            F.sum(F.col("ride") + F.col("alight")).alias("total_traffic"),
        )
        .orderBy(F.desc("total_traffic"), "district_name")
    )
