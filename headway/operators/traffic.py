"""Hourly profiles, heat-map tables and dashboard indicators.

Inputs are the monthly aggregate tables (one row per district or stop), never the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions import classes
from headway.functions.numbers import ratio_or_zero
from headway.operators.joins import in_district, one_row, top_n
from headway.operators.ranking import dense_index, exclusive_quartiles
from headway.operators.views import rank_districts

CITY = "서울시 전체"
MEANS = ("avg_ride_passengers", "avg_alight_passengers", "avg_total_passengers")
DEFAULT_LAT, DEFAULT_LON = 37.5665, 126.9780  # fixed values: fallback coordinate of the city hall


def regions(city_hours: DataFrame, district_hours: DataFrame) -> DataFrame:
    """City and districts in one frame, so every profile is built in one job."""
    cols = ["month_date", "region_name", "day_type", "hour", *MEANS]
    city = city_hours.withColumn("region_name", F.lit(CITY)).select(cols)
    return city.unionByName(district_hours.withColumnRenamed("sgg_name", "region_name").select(cols))


def hourly_traffic(profile: DataFrame) -> DataFrame:
    """24 weekday and 24 weekend rows per region and month; missing hours are 0."""
    grid = (
        profile.select("month_date", "region_name")
        .distinct()
        .withColumn("day_type", F.explode(F.array(F.lit("weekday"), F.lit("weekend"))))
        .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    )
    keys = ["month_date", "region_name", "day_type", "hour"]
    return grid.join(profile, keys, "left").select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in MEANS])


def peak_hours(hours: DataFrame) -> DataFrame:
    total, hour = F.col("avg_total_passengers"), F.col("hour")
    windows = {
        "morning": (F.col("day_type") == "weekday") & hour.between(6, 10),
        "evening": (F.col("day_type") == "weekday") & hour.between(17, 20),
        "weekend": F.col("day_type") == "weekend",
    }
    out = []
    for name, test in windows.items():
        out.append(F.max_by(F.when(test, hour), F.when(test, F.struct(total, -hour))).alias(f"{name}_peak_hour"))
        out.append(F.round(F.max(F.when(test, total)), 1).alias(f"{name}_peak"))
    return hours.groupBy("month_date", "region_name").agg(*out)


def weekday_weekend_ratio(hours: DataFrame) -> DataFrame:
    side = lambda d: F.sum(F.when(F.col("day_type") == d, F.col("avg_total_passengers")).otherwise(0.0))
    return (
        hours.groupBy("month_date", "region_name")
        .agg(side("weekday").alias("wd"), side("weekend").alias("we"))
        .select(
            "month_date",
            "region_name",
            F.floor(F.round("wd", 6)).alias("total_weekday_passengers"),
            F.floor(F.round("we", 6)).alias("total_weekend_passengers"),
            F.round(ratio_or_zero(F.col("wd"), F.col("we")), 2).alias("weekday_weekend_ratio"),
        )
    )


def profile_totals(hours: DataFrame) -> DataFrame:
    def total(day: str, c: str) -> Column:
        return F.sum(F.when(F.col("day_type") == day, F.col(c)).otherwise(0.0))

    return hours.groupBy("month_date", "region_name").agg(
        total("weekday", MEANS[0]).alias("weekday_boarding"),
        total("weekday", MEANS[1]).alias("weekday_alighting"),
        total("weekend", MEANS[0]).alias("weekend_boarding"),
        total("weekend", MEANS[1]).alias("weekend_alighting"),
        total("weekday", MEANS[2]).alias("weekday_total"),
    ).orderBy(F.desc("weekday_total"), "region_name")


def heatmap_districts(monthly: DataFrame, month: str, threshold: int | None = None) -> DataFrame:
    shown = monthly.filter(F.col("month_date") == F.lit(month).cast("date")).filter(
        F.col("total_traffic") > (threshold or 0)
    )
    ranked = rank_districts(shown, "total_traffic", "traffic_rank", unique=True)
    return ranked.withColumn(
        "traffic_density", F.round(ratio_or_zero(F.col("total_traffic"), F.col("station_count")), 2)
    )


def heatmap_stations(stations: DataFrame, month: str, threshold: int | None = None, districts: list[str] | None = None) -> DataFrame:
    shown = stations.filter(F.col("month_date") == F.lit(month).cast("date")).filter(
        F.col("total_traffic") > (threshold or 0)
    )
    if districts is not None:
        shown = shown.filter(F.col("district_name").isin(districts))
    return shown.withColumns(
        {
            "latitude": F.coalesce("latitude", F.lit(DEFAULT_LAT)),
            "longitude": F.coalesce("longitude", F.lit(DEFAULT_LON)),
            "daily_average": F.round("daily_average", 1),
        }
    )


def heatmap_nested(districts: DataFrame, stations: DataFrame, page: int = 1000) -> DataFrame:
    """Districts with their stations as arrays, busiest first, ``page`` stations per row.

    Positions come from one distributed sort, so no district is gathered in one place; a
    district with more stations than a page continues on the next ``page_no``.
    """
    placed = dense_index(
        stations.select("district_name", "station_id", "station_name", "latitude", "longitude", "total_traffic"),
        F.asc("district_name"), F.desc("total_traffic"), F.asc("station_id"), name="_pos",
    )
    first = placed.groupBy("district_name").agg(F.min("_pos").alias("_first"))
    entry = F.struct("_pos", "station_id", "station_name", "latitude", "longitude", "total_traffic")
    pages = (
        placed.join(first, "district_name")
        .groupBy("district_name", F.floor((F.col("_pos") - F.col("_first")) / page).alias("page_no"))
        .agg(F.sort_array(F.collect_list(entry)).alias("stations"))
    )
    return districts.join(pages, "district_name", "left").withColumns(
        {"stations": F.coalesce(F.transform("stations", lambda s: s.dropFields("_pos")), F.array()), "page_no": F.coalesce("page_no", F.lit(0))}
    )


def heatmap_statistics(districts: DataFrame, stations: DataFrame | None) -> DataFrame:
    """One row; station figures are 0 when no station detail is asked for."""
    base = districts.agg(
        F.max("total_traffic").alias("max_district_traffic"),
        F.min("total_traffic").alias("min_district_traffic"),
        F.sum("total_traffic").alias("total_city_traffic"),
    )
    dq = one_row(exclusive_quartiles(districts, "total_traffic", "d"), "d1", "d2", "d3")
    names = ["max_station_traffic", "min_station_traffic", "total_stations"]
    if stations is None:
        extra = {n: F.lit(0) for n in names} | {f"station_q{i}": F.lit(0) for i in (1, 2, 3)}
    else:
        st = one_row(
            stations.agg(F.max("total_traffic").alias(names[0]), F.min("total_traffic").alias(names[1]), F.count(F.lit(1)).alias(names[2])),
            *names,
        )
        sq = one_row(exclusive_quartiles(stations, "total_traffic", "s"), "s1", "s2", "s3")
        extra = {n: st.getField(n) for n in names} | {f"station_q{i}": sq.getField(f"s{i}") for i in (1, 2, 3)}
    return base.withColumns({f"district_q{i}": dq.getField(f"d{i}") for i in (1, 2, 3)} | extra)


def district_detail(ranked: DataFrame, district: str) -> DataFrame:
    """A district with its city-wide rank; unknown names are rejected by the caller's check."""
    return ranked.filter(F.col("district_name") == district)


def kpi_overview(districts: DataFrame) -> DataFrame:
    t = F.col("total_traffic")
    tie = F.col("district_name")
    return districts.agg(
        F.sum(t).alias("total_traffic"),
        F.sum("station_count").alias("total_stations"),
        F.floor(F.avg(t)).alias("mean_per_district"),
        F.max(t).alias("max_traffic"),
        F.min_by(tie, F.struct(-t, tie)).alias("max_district"),
        F.min(t).alias("min_traffic"),
        F.min_by(tie, F.struct(t, tie)).alias("min_district"),
        F.round(ratio_or_zero(F.sum("total_ride"), F.sum("total_alight")), 2).alias("ride_alight_ratio"),
    )


def kpi_concentration(frame: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Share (percent) of the n largest rows. The top rows come from TakeOrdered."""
    head = top_n(frame, n, F.desc("total_traffic"), F.asc(key)).agg(F.sum("total_traffic").alias("top")).scalar()
    return frame.agg(F.sum("total_traffic").alias("total")).select(
        F.round(ratio_or_zero(head * 100, F.col("total")), 1).alias("top_share_pct")
    )


def kpi_inequality(frame: DataFrame) -> DataFrame:
    r = F.round(ratio_or_zero(F.max("total_traffic"), F.min("total_traffic")), 1)
    return frame.agg(r.alias("max_min_ratio")).withColumn("need_class", classes.inequality_class(F.col("max_min_ratio")))


def overview_metrics(districts: DataFrame, ratios: DataFrame, peaks: DataFrame) -> DataFrame:
    """City headline row with its five busiest districts."""
    top5 = top_n(districts, 5, F.desc("total_traffic"), F.asc("district_name")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(-F.col("total_traffic"), "district_name"))), lambda s: s["district_name"]),
            ",",
        ).alias("names")
    ).scalar()
    total = districts.agg(F.sum("total_traffic").alias("t")).scalar()
    r = F.col("weekday_weekend_ratio")
    balance = F.floor((F.lit(10.0) / F.abs(r - 1) + 50) * 1.2 + 0.5)
    return (
        ratios.filter(F.col("region_name") == CITY)
        .join(peaks, ["month_date", "region_name"])
        .select(
            "month_date",
            total.alias("total_traffic"),
            (F.col("total_weekday_passengers") + F.col("total_weekend_passengers")).alias("total_passengers"),
            F.floor((F.col("morning_peak_hour") + F.col("evening_peak_hour")) / 2 + 0.5).alias("peak_hour"),
            top5.alias("top_districts"),
            r.alias("traffic_trend"),
            F.when(r == 1, 100).otherwise(F.least(balance, F.lit(100))).alias("balance_score"),
        )
    )


def top_stations(stations: DataFrame, n: int = 5, district: str | None = None) -> DataFrame:
    return top_n(in_district(stations, district), n, F.desc("total_traffic"), F.asc("station_id"))


def station_display_name(stations: DataFrame) -> DataFrame:
    """Repeated names get the last six characters of the id.

    Names are counted by an aggregate that merges map-side and joined back, so a name shared by
    very many stops never sits in one window partition.
    """
    repeated = stations.groupBy("station_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("station_name", F.lit(True).alias("repeated"))
    short = F.substring("station_id", -6, 6)
    return stations.join(repeated, "station_name", "left").withColumn(
        "display_name",
        F.when(F.col("repeated"), F.concat("station_name", F.lit(" ("), short, F.lit(")"))).otherwise(F.col("station_name")),
    ).drop("repeated")
