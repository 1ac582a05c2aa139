"""Master-data cleansing and route/stop filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.operators.joins import first_per_key

CITY = "서울특별시"
TIME_COLUMNS = [f"{d}_{e}_time" for d in ("weekday", "saturday", "holiday") for e in ("first", "last")]
INTERVAL_COLUMNS = ["weekday_interval", "saturday_interval", "holiday_interval", "min_interval", "max_interval"]
SCHEDULE = ["route_id", *TIME_COLUMNS, *INTERVAL_COLUMNS]
OTHER_ROUTE_TYPE = 8  # fixed value: route type left out of the analysis


def number(c: str, kind: str = "double") -> Column:
    return F.expr(f"try_cast({c} AS {kind})")


def day_fraction_to_time(fraction: Column) -> Column:
    """0.25 to ``06:00:00``; hours wrap at 24, missing or 0 gives NULL."""
    minutes = F.floor(fraction * 1440).cast("int")
    clock = F.format_string("%02d:%02d:00", F.floor(minutes / 60).cast("int") % 24, minutes % 60)
    return F.when(fraction.isNotNull() & (fraction != 0), clock)


def dong_from_full_name(name: Column) -> Column:
    """Third word of a name of at least three words, else the name itself."""
    parts = F.split(name, " ")
    return F.when(F.coalesce(name, F.lit("")) == "", "").when(F.size(parts) >= 3, F.get(parts, 2)).otherwise(name)


def clean_stops(raw: DataFrame, seq: str) -> DataFrame:
    x, y = number("coordinates_x"), number("coordinates_y")
    once = first_per_key(raw, ["node_id"], seq)
    return once.filter(x.isNotNull() & y.isNotNull()).select(
        "node_id",
        "node_name",
        F.coalesce("node_description", F.lit("")).alias("node_description"),
        F.coalesce("node_num", F.lit("")).alias("node_num"),
        F.coalesce(number("node_type", "int"), F.lit(0)).alias("node_type"),
        x.alias("coordinates_x"),
        y.alias("coordinates_y"),
        F.coalesce(number("mapping_x"), x).alias("mapping_x"),
        F.coalesce(number("mapping_y"), y).alias("mapping_y"),
        F.col("is_active").cast("boolean").alias("is_active"),
    )


def clean_routes(raw: DataFrame, seq: str) -> dict[str, DataFrame]:
    """One cleaned route row split into routes, schedules and details."""
    once = first_per_key(raw, ["route_id"], seq).withColumns(
        {
            "route_name": F.coalesce("route_name", F.lit("")),
            "route_type": F.coalesce(number("route_type", "int"), F.lit(0)),
            "total_distance": number("total_distance"),
            "is_operating": F.col("is_operating").cast("boolean"),
            "curvature": F.coalesce(number("curvature"), F.lit(0.0)),
            "max_speed": F.coalesce(number("max_speed"), F.lit(0.0)),
            **{c: F.coalesce(number(c, "int"), F.lit(0)) for c in INTERVAL_COLUMNS},
            **{c: day_fraction_to_time(number(c)) for c in TIME_COLUMNS},
        }
    )
    return {
        "routes": once.select("route_id", "route_name", "route_type", "total_distance", "is_operating"),
        "schedules": once.select(*SCHEDULE),
        "details": once.select("route_id", "curvature", "max_speed"),
    }


def clean_route_stops(raw: DataFrame, stops: DataFrame, routes: DataFrame, seq: str) -> DataFrame:
    """First row per (route, position) whose active stop and route exist."""
    rows = raw.withColumn("node_sequence", number("node_sequence", "int")).filter(
        "route_id IS NOT NULL AND stop_id IS NOT NULL AND node_sequence IS NOT NULL"
    )
    once = first_per_key(rows, ["route_id", "node_sequence"], seq)
    active = stops.filter("is_active").select(F.col("node_id").alias("stop_id"))
    return once.join(active, "stop_id", "left_semi").join(routes.select("route_id"), "route_id", "left_semi")


def filter_known_routes(feed: DataFrame, routes: DataFrame, by_name: bool = True) -> DataFrame:
    """Rows of known routes, matched by id or (station feed only) by name."""
    ids = routes.select(F.col("route_id").alias("routeId")).distinct().withColumn("_by_id", F.lit(True))
    marked = feed.join(ids, "routeId", "left")
    known = F.col("_by_id").isNotNull()
    drop = ["_by_id"]
    if by_name:
        names = routes.filter("route_name <> ''").select(F.col("route_name").alias("routeNm")).distinct()
        marked = marked.join(names.withColumn("_by_name", F.lit(True)), "routeNm", "left")
        known = known | F.col("_by_name").isNotNull()
        drop.append("_by_name")
    return marked.filter(known).drop(*drop).select(*feed.columns)


def filter_counts(fetched: DataFrame, kept: DataFrame) -> DataFrame:
    after = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    return fetched.agg(F.count(F.lit(1)).alias("fetched")).withColumn("kept", after)


def authorized_route_names(raw: DataFrame) -> DataFrame:
    return raw.select(F.trim("route_name").alias("route_name")).distinct()


def filter_route_type(raw: DataFrame, seq: str, excluded: int = OTHER_ROUTE_TYPE) -> DataFrame:
    """Drops one route type, then keeps the first row of a route name in file order."""
    return first_per_key(raw.filter(F.col("route_type") != excluded), ["route_name"], seq)


def route_type_counts(raw: DataFrame, excluded: int = OTHER_ROUTE_TYPE) -> DataFrame:
    return raw.filter(F.col("route_type") != excluded).groupBy("route_type").agg(F.count(F.lit(1)).alias("routes"))


def filter_route_nodes(nodes: DataFrame, kept_routes: DataFrame) -> DataFrame:
    ids = kept_routes.select(F.col("route_id").cast("string").alias("_id"))
    return nodes.join(ids, F.col("route_id").cast("string") == F.col("_id"), "left_semi")


def filter_node_info(stops: DataFrame, kept_nodes: DataFrame) -> DataFrame:
    ids = kept_nodes.select(F.col("node_id").cast("string").alias("_id"))
    return stops.join(ids, F.col("node_id").cast("string") == F.col("_id"), "left_semi")


def filter_summary(kept_routes: DataFrame, kept_nodes: DataFrame, kept_stops: DataFrame) -> DataFrame:
    parts = [
        kept_routes.agg(F.countDistinct("route_id").alias("kept")).withColumn("item", F.lit("routes")),
        kept_nodes.agg(F.countDistinct("node_id").alias("kept")).withColumn("item", F.lit("nodes")),
        kept_stops.agg(F.countDistinct("node_id").alias("kept")).withColumn("item", F.lit("stops")),
    ]
    return reduce(DataFrame.unionByName, parts)
