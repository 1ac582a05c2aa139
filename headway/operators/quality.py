"""Data-quality reports."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.numbers import count_if
from headway.operators.joins import top_n


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def infra_quality(tables: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """Per table: rows and two completeness figures (aggregate columns)."""
    return _stack(
        [
            df.agg(F.count(F.lit(1)).alias("total_records"), a.alias("complete_records"), b.alias("active_records")).withColumn("table_name", F.lit(name))
            for name, (df, a, b) in tables.items()
        ]
    )


def fact_quality(facts: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """Per fact table: rows, first and last date, distinct routes and stations (key columns).

    Rows first become one per route and station, map-side; only these are doubled by the distinct counts.
    """
    return _stack(
        [
            df.groupBy(*dict.fromkeys([*routes, *stations]))
            .agg(F.count(F.lit(1)).alias("n"), F.min("record_date").alias("first"), F.max("record_date").alias("last"))
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
                F.min("first").alias("earliest_date"),
                F.max("last").alias("latest_date"),
                F.countDistinct(*routes).alias("unique_routes"),
                F.countDistinct(*stations).alias("unique_stations"),
            ).withColumn("table_name", F.lit(name))
            for name, (df, routes, stations) in facts.items()
        ]
    )


def feed_delay_monitor(roads: DataFrame, today: str | dt.date) -> DataFrame:
    """Freshness and quality of the road feed on a given day."""
    good = F.col("data_quality_flag") == 1
    late = F.datediff(F.lit(dt.date.fromisoformat(str(today))), F.col("latest_data_date"))
    return (
        roads.agg(
            F.max("record_date").alias("latest_data_date"),
            F.count(F.lit(1)).alias("total_records"),
            (F.avg(F.when(good, 1.0).otherwise(0.0)) * 100).alias("quality_percentage"),
            F.avg("days_delayed").alias("avg_delay_days"),
            F.countDistinct("road_name").alias("unique_roads"),
            F.countDistinct(F.when(good, F.col("road_name"))).alias("reliable_roads"),
        )
        .withColumn("current_delay_days", late)
        .withColumn("data_status", F.when(late <= 5, "NORMAL").when(late <= 10, "WARNING").otherwise("DEGRADED"))
    )


def station_hourly_stats(shp: DataFrame) -> DataFrame:
    return shp.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.max("month_date").alias("latest_month"),
        F.countDistinct("district_name").alias("districts_count"),
        F.countDistinct("station_id").alias("stations_count"),
    ).withColumn("avg_records_per_station", F.round(F.col("record_count") / F.col("stations_count"), 2))


def load_verification(tables: dict[str, DataFrame], boundaries: DataFrame, routes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(check, item, value): table sizes, districts, longest routes, route types, mapping repeats."""
    row = lambda df, check, item, value: df.select(
        F.lit(check).alias("check"), item.cast("string").alias("item"), value.cast("double").alias("value")
    )
    n = F.count(F.lit(1)).alias("n")
    parts = [row(df.agg(n), "rows", F.lit(name), F.col("n")) for name, df in tables.items()]
    districts = top_n(boundaries.groupBy("sggnm").agg(n), 10, F.desc("n"), F.asc("sggnm"))
    longest = top_n(routes.filter("total_distance_km IS NOT NULL"), 5, F.desc("total_distance_km"), F.asc("route_id"))
    parts += [
        row(districts, "boundaries", F.col("sggnm"), F.col("n")),
        row(longest, "longest_routes", F.col("route_name"), F.col("total_distance_km")),
        row(routes.groupBy("route_type").agg(n), "route_types", F.col("route_type"), F.col("n")),
        row(mapping.agg(n, F.countDistinct("node_id").alias("u")), "mapping_repeats", F.lit("spatial_mapping"), F.col("n") - F.col("u")),
    ]
    return _stack(parts)


def repeated_keys(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return bad.agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit(rule))


def missing_parents(df: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias(key))
    return df.join(keys, key, "left_anti").agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit(rule))


def failed_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over the table for all its value rules; NULL does not fail a rule."""
    counts = df.agg(*[count_if(~test).alias(name) for name, test in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, violations)")


def constraint_check(parts: list[DataFrame]) -> DataFrame:
    return _stack([p.select("rule", "violations") for p in parts])
