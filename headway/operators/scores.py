"""Demand-responsive-transit scores per month, stop and hour: commuter, tourism, vulnerable.

Facts are filtered by a date range (so partitions prune) and shrink to stop × hour before any
join. Station maxima and sums are windows over the at most 24 hours of a stop. The stop × hour
grid is generated by ``explode``, minima and maxima come in as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.calendar import is_tourism_hour, is_weekend, month_filter, vulnerable_band
from headway.functions.numbers import cap_one, decimal_round
from headway.operators.joins import hours_grid, never_broadcast, one_row, section_ends

OTHER_DISTRICT = "기타"
CORE_HOURS = [9, 14, 18]
# fixed values: weights of the three score models and their hour factors
BAND_FACTOR = {"medical": 1.5, "welfare": 1.3, "evening": 1.2}
WEIGHTS = {
    "commuter": {"tc_score": 0.4, "pdr_score": 0.4, "ru_score": 0.2},
    "tourism": {"tc_t_score": 0.35, "tdr_t_score": 0.35, "ru_t_score": 0.3},
    "vulnerable": {"var_t_score": 0.3, "sed_t_score": 0.3, "mdi_t_score": 0.4},
}


def _by_station():
    return Window.partitionBy("station_id")


def in_month(df: DataFrame, month: str, day: str | None = None) -> DataFrame:
    out = df.filter(month_filter(F.col("record_date"), month))
    if day == "weekend":
        return out.filter(is_weekend(F.col("record_date")))
    if day == "weekday":
        return out.filter(~is_weekend(F.col("record_date")))
    return out


def pattern_month(shp: DataFrame, month: str, day: str | None = None) -> DataFrame:
    out = shp.filter(F.col("month_date") == F.lit(month).cast("date"))
    return out if day is None else out.filter(F.col("day_type") == day)


def dispatch_hours(sph: DataFrame, month: str, day: str | None) -> DataFrame:
    return (
        in_month(sph, month, day)
        .groupBy(F.col("node_id").alias("station_id"), F.col("hour").alias("hour_of_day"))
        .agg(F.avg("dispatch_count").alias("avg_dispatch_count"))
    )


def station_hours(sph: DataFrame, month: str, day: str | None) -> DataFrame:
    """Mean dispatches and mean passengers of each stop and hour, in one pass over the facts."""
    return (
        in_month(sph, month, day)
        .groupBy(F.col("node_id").alias("station_id"), F.col("hour").alias("hour_of_day"))
        .agg(F.avg("dispatch_count").alias("avg_dispatch_count"), F.avg(F.col("ride_passenger") + F.col("alight_passenger")).alias("rides"))
    )


def traffic_per_day(shp: DataFrame, month: str, day: str) -> DataFrame:
    """Whole passengers per operating day (integer division)."""
    return pattern_month(shp, month, day).select(
        "station_id",
        F.col("hour").alias("hour_of_day"),
        "district_name",
        F.expr("(total_ride + total_alight) div greatest(operating_days, 1)").alias("avg_traffic_count"),
    )


def _share(value: str, whole: Column) -> Column:
    return F.when(whole > 0, F.col(value).cast("double") / whole).otherwise(0.0)


def commuter_tc(sph: DataFrame, month: str) -> DataFrame:
    return dispatch_hours(sph, month, "weekday").withColumn(
        "max_daily_dispatch", F.max("avg_dispatch_count").over(_by_station())
    ).withColumn("tc_score", _share("avg_dispatch_count", F.col("max_daily_dispatch")))


def commuter_pdr(shp: DataFrame, month: str) -> DataFrame:
    return traffic_per_day(shp, month, "weekday").withColumn(
        "max_daily_traffic", F.max("avg_traffic_count").over(_by_station())
    ).withColumn("pdr_score", _share("avg_traffic_count", F.col("max_daily_traffic")))


def commuter_ru(sections: DataFrame, shp: DataFrame, sm: DataFrame, month: str) -> DataFrame:
    """Min–max of section passengers; stops without sections fall back to their weekday rides."""
    through = (
        section_ends(in_month(sections, month), "passenger_count")
        .groupBy(F.col("node_id").alias("station_id"))
        .agg(F.sum("passenger_count").alias("through"))
        .join(never_broadcast(sm.select(F.col("node_id").alias("station_id"))), "station_id", "left_semi")
    )
    rides = (
        pattern_month(shp, month, "weekday")
        .groupBy("station_id")
        .agg(F.sum(F.col("total_ride") + F.col("total_alight")).alias("rides"))
    )

    def span(df: DataFrame, c: str) -> tuple[Column, Column]:
        row = one_row(df.filter(F.col(c) > 0).agg(F.min(c).alias("lo"), F.max(c).alias("hi")), "lo", "hi")
        return row.getField("lo"), row.getField("hi")

    s_lo, s_hi = span(through, "through")
    r_lo, r_hi = span(rides, "rides")
    t, r = F.col("through"), F.col("rides")
    return (
        sm.select(F.col("node_id").alias("station_id"))
        .join(never_broadcast(through), "station_id", "left")
        .join(never_broadcast(rides), "station_id", "left")
        .select(
            "station_id",
            F.coalesce(t, F.lit(0)).alias("section_passenger_sum"),
            F.when(t.isNotNull() & (s_hi > s_lo), (t - s_lo).cast("double") / (s_hi - s_lo))
            .when(t.isNull() & r.isNotNull() & (r_hi > r_lo), (r - r_lo).cast("double") / (r_hi - r_lo))
            .otherwise(0.0)
            .alias("ru_score"),
        )
    )


def commuter_scores(sph: DataFrame, sections: DataFrame, shp: DataFrame, sm: DataFrame, month: str) -> DataFrame:
    grid = _grid(pattern_month(shp, month, "weekday"))
    parts = (
        grid.join(never_broadcast(commuter_tc(sph, month)), ["station_id", "hour_of_day"], "left")
        .join(never_broadcast(commuter_pdr(shp, month)), ["station_id", "hour_of_day"], "left")
        .join(never_broadcast(commuter_ru(sections, shp, sm, month)), "station_id", "left")
    )
    zero = ["avg_dispatch_count", "max_daily_dispatch", "avg_traffic_count", "max_daily_traffic", "section_passenger_sum"]
    return _finish(parts, month, "commuter", zero)


def tourism_tc(sph: DataFrame, month: str) -> DataFrame:
    return _tourism_tc(dispatch_hours(sph, month, "weekend"))


def _tourism_tc(hours: DataFrame) -> DataFrame:
    share = _share("avg_dispatch_count", F.col("max_daily_dispatch"))
    return hours.withColumn(
        "max_daily_dispatch", F.max("avg_dispatch_count").over(_by_station())
    ).withColumn("tc_t_score", _tourism_boost(share, 1.2))


def tourism_tdr(shp: DataFrame, month: str) -> DataFrame:
    share = _share("avg_traffic_count", F.col("max_daily_traffic"))
    return traffic_per_day(shp, month, "weekend").withColumn(
        "max_daily_traffic", F.max("avg_traffic_count").over(_by_station())
    ).withColumn("tdr_t_score", _tourism_boost(share, 1.1))


def _tourism_boost(share: Column, factor: float) -> Column:
    return F.when(is_tourism_hour(F.col("hour_of_day")), cap_one(share * factor)).otherwise(share)


def hourly_load(sections: DataFrame, sph: DataFrame, sm: DataFrame, month: str, day: str | None) -> DataFrame:
    """Section passengers per stop and hour, or mean rides where no section touches the stop.

    With ``day`` set, only dates of that kind that also occur in the station facts count.
    """
    rides = station_hours(sph, month, day).drop("avg_dispatch_count")
    keys = ["station_id", "hour_of_day"]
    grid = hours_grid(sm.select(F.col("node_id").alias("station_id"))).withColumnRenamed("hour", "hour_of_day")
    return (
        grid.join(never_broadcast(_through(sections, sph, month, day)), keys, "left")
        .join(never_broadcast(rides), keys, "left")
        .select(*keys, _raw_passengers().alias("raw_passengers"))
    )


def _through(sections: DataFrame, sph: DataFrame, month: str, day: str | None) -> DataFrame:
    links = in_month(sections, month, day)
    if day is not None:
        links = links.join(in_month(sph, month, day).select("record_date").distinct(), "record_date", "left_semi")
    return (
        section_ends(links, "hour", "passenger_count")
        .groupBy(F.col("node_id").alias("station_id"), F.col("hour").alias("hour_of_day"))
        .agg(F.sum("passenger_count").alias("through"))
    )


def _raw_passengers() -> Column:
    return F.coalesce(F.col("through").cast("double"), F.col("rides"), F.lit(0.0))


def tourism_ru(sections: DataFrame, sph: DataFrame, sm: DataFrame, month: str) -> DataFrame:
    return hourly_load(sections, sph, sm, month, "weekend").withColumn("ru_t_score", _tourism_ru())


def _tourism_ru() -> Column:
    factor = F.when(is_tourism_hour(F.col("hour_of_day")), 0.6).otherwise(0.4)
    return F.when(F.col("raw_passengers") > 0, cap_one(F.col("raw_passengers") / 1000.0 * factor)).otherwise(0.0)


def tourism_scores(sph: DataFrame, sections: DataFrame, shp: DataFrame, sm: DataFrame, month: str) -> DataFrame:
    keys = ["station_id", "hour_of_day"]
    parts = (
        _mapped_grid(pattern_month(shp, month, "weekend"), sm)
        .join(never_broadcast(_tourism_tc(station_hours(sph, month, "weekend"))), keys, "left")
        .join(never_broadcast(_through(sections, sph, month, "weekend")), keys, "left")
        .withColumn("raw_passengers", F.when(F.col("mapped"), _raw_passengers()))
        .withColumn("ru_t_score", _tourism_ru())
        .join(never_broadcast(tourism_tdr(shp, month)), keys, "left")
        .withColumns(
            {
                "section_passenger_density": F.coalesce(F.col("raw_passengers") / 1000.0, F.lit(0.0)),
                "is_tourism_time": is_tourism_hour(F.col("hour_of_day")),
            }
        )
    )
    zero = ["avg_dispatch_count", "max_daily_dispatch", "avg_traffic_count", "max_daily_traffic"]
    return _finish(parts, month, "tourism", zero, ["section_passenger_density", "is_tourism_time"])


def _band(hour: Column) -> Column:
    return vulnerable_band(hour)


def _is_vulnerable(hour: Column) -> Column:
    return _band(hour) != "normal"


def vulnerable_var(sph: DataFrame, month: str) -> DataFrame:
    return _vulnerable_var(dispatch_hours(sph, month, None))


def _vulnerable_var(hours: DataFrame) -> DataFrame:
    hour = F.col("hour_of_day")
    total = F.sum(F.when(_is_vulnerable(hour), F.col("avg_dispatch_count"))).over(_by_station())
    share = _share("avg_dispatch_count", F.col("vulnerable_total_dispatch"))
    boosted = F
    for band, factor in BAND_FACTOR.items():
        boosted = boosted.when(_band(hour) == band, cap_one(share * factor))
    return hours.withColumn("vulnerable_total_dispatch", total).withColumn(
        "var_t_score", boosted.otherwise(share)
    )


def vulnerable_sed(shp: DataFrame, month: str) -> DataFrame:
    """Traffic per day over both day types; here the division keeps its fraction."""
    hour = F.col("hour_of_day")
    per_day = (
        pattern_month(shp, month)
        .groupBy("station_id", F.col("hour").alias("hour_of_day"))
        .agg(
            (F.sum(F.col("total_ride") + F.col("total_alight")) / F.sum("operating_days")).alias("avg_traffic_count"),
            F.max("district_name").alias("district_name"),
        )
    )
    total = F.sum(F.when(_is_vulnerable(hour), F.col("avg_traffic_count"))).over(_by_station())
    share = _share("avg_traffic_count", F.col("vulnerable_total_traffic"))
    quiet, core = F.col("avg_traffic_count") < 100, hour.isin(CORE_HOURS)
    score = (
        F.when(quiet & core, cap_one(share * 1.4 * 1.2))
        .when(quiet, cap_one(share * 1.4))
        .when(core, cap_one(share * 1.2))
        .otherwise(share)
    )
    return per_day.withColumn("vulnerable_total_traffic", total).withColumn("sed_t_score", score)


def vulnerable_mdi(sections: DataFrame, sph: DataFrame, shp: DataFrame, sm: DataFrame, month: str) -> DataFrame:
    seen = pattern_month(shp, month).select(F.col("station_id").alias("node_id")).distinct()
    known = sm.join(never_broadcast(seen), "node_id", "left_semi")
    return hourly_load(sections, sph, known, month, None).withColumn("mdi_t_score", _vulnerable_mdi())


def _vulnerable_mdi() -> Column:
    weight = F.when(_is_vulnerable(F.col("hour_of_day")), 0.3).otherwise(0.7)
    return (1000 - F.least("raw_passengers", F.lit(1000.0))) / 1000.0 * weight


def vulnerable_scores(sph: DataFrame, sections: DataFrame, shp: DataFrame, sm: DataFrame, month: str) -> DataFrame:
    keys = ["station_id", "hour_of_day"]
    parts = (
        _mapped_grid(pattern_month(shp, month), sm)
        .join(never_broadcast(_vulnerable_var(station_hours(sph, month, None))), keys, "left")
        .join(never_broadcast(_through(sections, sph, month, None)), keys, "left")
        .withColumn("raw_passengers", F.when(F.col("mapped"), _raw_passengers()))
        .withColumn("mdi_t_score", F.when(F.col("mapped"), _vulnerable_mdi()))
        .join(never_broadcast(vulnerable_sed(shp, month)), keys, "left")
        .withColumns(
            {
                "section_passenger_count": F.coalesce("raw_passengers", F.lit(0.0)),
                "is_vulnerable_time": _is_vulnerable(F.col("hour_of_day")),
                "vulnerable_category": _band(F.col("hour_of_day")),
            }
        )
    )
    zero = ["avg_dispatch_count", "vulnerable_total_dispatch", "avg_traffic_count", "vulnerable_total_traffic"]
    return _finish(parts, month, "vulnerable", zero, ["section_passenger_count", "is_vulnerable_time", "vulnerable_category"])


def _grid(patterns: DataFrame) -> DataFrame:
    return hours_grid(patterns.select("station_id").distinct()).withColumnRenamed("hour", "hour_of_day")


def _mapped_grid(patterns: DataFrame, sm: DataFrame) -> DataFrame:
    """The grid, with ``mapped`` where the stop has a district; only stops with patterns come in."""
    mapped = sm.select(F.col("node_id").alias("station_id"), F.lit(True).alias("mapped"))
    stops = patterns.select("station_id").distinct().join(never_broadcast(mapped), "station_id", "left")
    return hours_grid(stops).withColumnRenamed("hour", "hour_of_day")


def _finish(parts: DataFrame, month: str, model: str, zero: list[str], extra: list[str] = ()) -> DataFrame:
    """Missing parts are 0; the total uses the unrounded parts."""
    weights = WEIGHTS[model]
    total = sum(F.coalesce(c, F.lit(0.0)) * w for c, w in weights.items()) * 100
    area = "avs_score" if model == "vulnerable" else "pcw_score"
    return parts.select(
        "station_id",
        F.coalesce("district_name", F.lit(OTHER_DISTRICT)).alias("district_name"),
        F.lit(month).cast("date").alias("analysis_month"),
        "hour_of_day",
        *[decimal_round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in weights],
        F.lit(1.0).alias(area),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in zero],
        *extra,
        decimal_round(total, 4).alias("total_drt_score"),
    )
