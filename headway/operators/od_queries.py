"""Questions asked of the monthly pair summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions import classes
from headway.functions.numbers import count_if, decimal_round, even_round, ratio_or_zero
from headway.operators.joins import best_per_group, top_n
from headway.operators.od import HOURS

PERIODS = {
    "morning_peak": "monthly_morning_peak",
    "evening_peak": "monthly_evening_peak",
    "night": "monthly_night",
    "daytime": "monthly_daytime",
}
PAIR = ["from_station_id", "to_station_id"]
MEAN = "daily_avg_passengers"
# fixed values: route weights by type name; other types weigh 1
ROUTE_WEIGHT = {"간선": 3, "지선": 2, "마을": 1, "공항": 4}


def of_month(summary: DataFrame, month: str) -> DataFrame:
    return summary.filter(F.col("analysis_month") == F.lit(month).cast("date"))


def _districts_known() -> Column:
    return F.col("from_district_name").isNotNull() & F.col("to_district_name").isNotNull()


def p1_transfers(summary: DataFrame, month: str, n: int = 50) -> DataFrame:
    score = F.col("p1_score") + F.col("p2_score")
    label = F.when(F.col("p1_score") > 0, "P1_고수요_환승구간").when(F.col("p2_score") > 0, "P1_저수요_환승구간")
    rows = of_month(summary, month).filter(score > 0).withColumns({"priority_score": score, "priority_category": label})
    return top_n(rows, n, F.desc("priority_score"), F.desc("daily_avg_passengers"), *map(F.asc, PAIR))


def p2_high_demand(summary: DataFrame, month: str, n: int = 50) -> DataFrame:
    rows = of_month(summary, month).filter((F.col("p3_score") > 0) & _districts_known())
    return top_n(rows.withColumn("priority_category", F.lit("P2_직행노선부족")), n, F.desc("p3_score"), *map(F.asc, PAIR))


def p3_low_efficiency(summary: DataFrame, month: str, n: int = 50) -> DataFrame:
    per_km = F.when(F.col("avg_distance_km") > 0, F.col(MEAN) / F.col("avg_distance_km")).otherwise(0.0)
    rows = of_month(summary, month).filter((F.col("p4_score") > 0) & _districts_known()).withColumn("demand_per_km", per_km)
    advice = F.when(F.col("demand_per_km") < 10, "DRT 전환 권장").otherwise("현행 유지")
    return top_n(rows.withColumn("service_recommendation", advice), n, F.desc("p4_score"), *map(F.asc, PAIR))


def _moving(summary: DataFrame, month: str, period: str) -> DataFrame:
    if period not in PERIODS:
        raise ValueError(f"unknown time period {period!r}")
    return of_month(summary, month).filter((F.col("from_station_id") != F.col("to_station_id")) & (F.col(PERIODS[period]) > 0))


def time_origins(summary: DataFrame, month: str, period: str, n: int = 20) -> DataFrame:
    """Origins with the most demand in a period, with potential and advice."""
    rows = _moving(summary, month, period).filter(
        F.col("from_coordinates_x").isNotNull() & F.col("from_coordinates_y").isNotNull() & F.col("from_district_name").isNotNull()
    )
    origins = rows.groupBy(
        "from_station_id", "from_station_name", "from_station_num", "from_district_name", "from_coordinates_x", "from_coordinates_y"
    ).agg(
        F.sum(PERIODS[period]).alias("time_period_demand"),
        F.sum("monthly_total_passengers").alias("total_monthly_demand"),
        F.countDistinct("to_station_id").alias("destination_count"),
        decimal_round(F.avg("avg_distance_km"), 2).alias("avg_distance_km"),
    )
    share = ratio_or_zero(F.col("time_period_demand"), F.col("total_monthly_demand"))
    return top_n(origins, n, F.desc("time_period_demand"), F.asc("from_station_id")).withColumns(
        {
            "drt_potential": F.when(F.col("destination_count") >= 20, "높음").when(F.col("destination_count") >= 10, "보통").otherwise("낮음"),
            "service_recommendation": F.when(share > 0.4, "시간대 집중 운영").when(share > 0.2, "기존 노선 보완").otherwise("수요 모니터링 필요"),
        }
    )


def time_destinations(summary: DataFrame, month: str, period: str, origins: DataFrame, n: int = 20) -> DataFrame:
    """Best destinations of every given origin in one ranking."""
    rows = (
        _moving(summary, month, period)
        .filter(F.col("to_coordinates_x").isNotNull() & F.col("to_coordinates_y").isNotNull() & F.col("to_district_name").isNotNull())
        .join(origins.select("from_station_id"), "from_station_id", "left_semi")
        .withColumn("demand", F.col(PERIODS[period]))
    )
    return best_per_group(rows, ["from_station_id"], n, F.desc("demand"), F.asc("to_station_id"))


def destination_spread(destinations: DataFrame) -> DataFrame:
    k = F.col("districts")
    return (
        destinations.groupBy("from_station_id")
        .agg(F.countDistinct("to_district_name").alias("districts"))
        .withColumn("destination_spread", F.when(k <= 3, "집중형").when(k <= 7, "분산형").otherwise("광역형"))
    )


def time_summary(origins: DataFrame) -> DataFrame:
    return origins.agg(
        F.count(F.lit(1)).alias("total_origins"),
        F.coalesce(F.sum("time_period_demand"), F.lit(0)).alias("total_demand"),
        F.coalesce(even_round(F.avg("destination_count"), 1), F.lit(0.0)).alias("avg_destinations"),
    )


def harmonic_mean(intervals: Column) -> Column:
    floor_one = F.transform(intervals, lambda i: F.greatest(i, F.lit(1)).cast("double"))
    return F.size(intervals) / F.aggregate(floor_one, F.lit(0.0), lambda a, i: a + 1 / i)


def service_quality(df: DataFrame) -> DataFrame:
    """Interval, diversity and transfer figures per pair and their weighted score.

    An unknown interval in the arrays in use makes the pair fall back to fixed defaults.
    """
    def intervals(c: str) -> Column:
        return F.transform(F.col(c), lambda r: r["dispatch_interval"])

    def unknown(c: str) -> Column:
        return F.exists(F.col(c), lambda r: r["dispatch_interval"].isNull())

    def mean(c: str) -> Column:
        total = F.aggregate(intervals(c), F.lit(0.0), lambda a, i: a + i)
        return F.when(F.size(c) > 0, total / F.size(c)).otherwise(30.0)

    weight = F.create_map(*[x for k, v in ROUTE_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    diversity = F.aggregate(
        F.col("common_routes"), F.lit(0), lambda a, r: a + F.coalesce(F.try_element_at(weight, r["route_type"]), F.lit(1))
    )
    direct = F.col("min_direct_connections") > 0
    broken = F.when(direct, unknown("common_routes")).otherwise(unknown("from_routes") | unknown("to_routes"))
    wait = F.when(direct, harmonic_mean(intervals("common_routes"))).otherwise(mean("from_routes") + mean("to_routes") + 10)
    out = df.withColumns(
        {
            "_broken": broken,
            "avg_dispatch_interval_min": F.when(broken, 30.0).otherwise(wait),
            "route_diversity_index": F.when(broken, 1).when(direct, diversity).otherwise(0).cast("double"),
            "transfer_penalty": F.when(broken | direct, 0.0).otherwise(1.0),
        }
    )
    score = (
        F.greatest(F.lit(0.0), 100 - F.col("avg_dispatch_interval_min") * 1.5) * 0.6
        + F.least(F.lit(100.0), F.col("route_diversity_index") * 15) * 0.2
        + F.when(F.col("transfer_penalty") == 0, 100).otherwise(30) * 0.2
    )
    return out.withColumn("service_quality_score", F.when(F.col("_broken"), 50.0).otherwise(score)).drop("_broken")


def mismatch(summary: DataFrame, month: str, minimum: float = 10, n: int = 20, pool: int | None = None) -> DataFrame:
    """The n pairs whose demand most outruns their service, out of all, or of the ``pool`` largest by demand."""
    rows = of_month(summary, month).filter(
        (F.col(MEAN) >= minimum)
        & F.col("from_coordinates_x").isNotNull()
        & F.col("from_coordinates_y").isNotNull()
        & F.col("to_coordinates_x").isNotNull()
        & F.col("to_coordinates_y").isNotNull()
    )
    candidates = rows if pool is None else top_n(rows, pool, F.desc("daily_avg_passengers"), *map(F.asc, PAIR))
    scored = service_quality(candidates).withColumn("_r", F.col(MEAN) / F.greatest(F.col("service_quality_score"), F.lit(1.0)))
    kept = scored.filter(F.col("_r") >= 1.0).withColumn("demand_service_ratio", decimal_round(F.col("_r"), 2))
    return top_n(kept, n, F.desc("demand_service_ratio"), F.desc("daily_avg_passengers"), *map(F.asc, PAIR)).drop("_r")


def summary_stats(summary: DataFrame, month: str) -> DataFrame:
    return of_month(summary, month).agg(
        F.count(F.lit(1)).alias("total_od_pairs"),
        count_if(F.col("drt_priority_score") > 0).alias("drt_applicable_pairs"),
        F.coalesce(F.sum(F.when(F.col("ever_transfer_required"), F.col("monthly_total_passengers"))), F.lit(0)).alias("monthly_transfer_demand"),
    )


def priority_distribution(summary: DataFrame, month: str) -> DataFrame:
    return of_month(summary, month).agg(*[count_if(F.col(f"p{i}_score") > 0).alias(f"p{i}_count") for i in (1, 2, 3, 4)])


def pair_hourly(summary: DataFrame, month: str, origin: str | None = None, destination: str | None = None) -> DataFrame:
    """24 daily means per pair with peak hour, band shares and a pattern label."""
    rows = of_month(summary, month)
    if origin is not None:
        rows = rows.filter(F.col("from_station_id") == origin)
    if destination is not None:
        rows = rows.filter(F.col("to_station_id") == destination)
    days = F.greatest(F.col("appearance_days"), F.lit(1))
    means = F.array(*[F.col(f"monthly_{h}") / days for h in HOURS])
    total = F.aggregate(F.col("_means"), F.lit(0.0), lambda a, x: a + x)
    share = lambda c: F.col(c) / F.col("_days") / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total")) * 100
    out = (
        rows.withColumns({"_days": days, "_means": means})
        .withColumns({"_total": total, "_peak": F.array_max("_means")})
        .withColumns({f"_{k}": share(c) for k, c in PERIODS.items()})
    )
    am, pm, noon = F.col("_morning_peak"), F.col("_evening_peak"), F.col("_daytime")
    label = (
        F.when((am > pm) & (am > 20), "출근시간 집중형")
        .when((pm > am) & (pm > 20), "퇴근시간 집중형")
        .when(noon > 50, "주간 분산형")
        .otherwise("균등 분산형")
    )
    return out.select(
        *PAIR,
        F.posexplode(F.transform("_means", lambda x: even_round(x, 1))).alias("hour", "passengers"),
        (F.array_position("_means", F.col("_peak")) - 1).alias("peak_hour"),
        even_round(F.col("_peak"), 1).alias("peak_passengers"),
        *[even_round(F.col(f"_{k}"), 1).alias(f"{k}_pct") for k in PERIODS],
        label.alias("pattern_type"),
    )


def hour_series(wide: DataFrame, *keys: str) -> DataFrame:
    """Wide h00..h23 columns to (hour, passengers) rows."""
    return wide.select(*keys, F.posexplode(F.array(*HOURS)).alias("hour", "passengers"))


def flow_edges(destinations: DataFrame, mismatched: DataFrame, minimum: float = 0, min_ratio: float = 0, high_risk: bool = False, selected: str | None = None) -> DataFrame:
    """Arcs to draw: period destinations above a demand, mismatches above a ratio."""
    time_based = destinations.filter(F.col("demand") >= minimum)
    gap = mismatched.filter(F.col("demand_service_ratio") >= min_ratio)
    if high_risk:
        gap = gap.filter(F.col("demand_service_ratio") > 10)
    if selected is not None:
        time_based = time_based.filter(F.col("from_station_id") == selected)
        gap = gap.filter((F.col("from_station_id") == selected) | (F.col("to_station_id") == selected))
    arcs = time_based.select(F.lit("time_based").alias("analysis_type"), *PAIR, F.col("demand").cast("double").alias("demand")).unionByName(
        gap.select(F.lit("mismatch").alias("analysis_type"), *PAIR, F.col("daily_avg_passengers").alias("demand"))
    )
    return arcs.withColumn("demand_class", classes.od_demand_class(F.col("demand")))


def dong_totals(dong_od: DataFrame) -> DataFrame:
    return dong_od.groupBy("start_district", "end_district").agg(F.sum("total_passenger_count").alias("total_passenger_count"))
