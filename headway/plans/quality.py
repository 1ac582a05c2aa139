"""Data quality, SQL surface and paging (survey sections 2.10, 2.13 and 2.15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import sql_rules
from headway.functions.numbers import count_if
from headway.operators import anomaly, quality, sequences as seq
from headway.operators.joins import one_row
from headway.operators.ranking import dense_index
from headway.plans.graph import features
from headway.plans.registry import register
from headway.plans.views import shp
from headway.sources.mapping import MONTH, TODAY


def infra(t):
    count = lambda c: count_if(F.col(c))
    return quality.infra_quality(
        {
            "bus_stops": (t.stops, F.count("longitude"), count("is_active")),
            "bus_routes": (t.routes, count_if(F.col("total_distance_km") > 0), F.count("dispatch_interval")),
            "route_stops": (t.route_stops, F.countDistinct("route_id"), count("is_active")),
            "admin_boundaries": (t.boundaries, F.countDistinct("sggnm"), F.count("polygons")),
            "spatial_mapping": (t.sm, F.countDistinct("sgg_name"), count("is_seoul")),
        }
    )


INFRA_SQL = """SELECT 'bus_stops' AS table_name, count(*) AS total_records, count(longitude) AS complete_records, count(*) FILTER (is_active) AS active_records FROM stops
       UNION ALL SELECT 'bus_routes', count(*), count(*) FILTER (total_distance_km > 0), count(dispatch_interval) FROM routes
       UNION ALL SELECT 'route_stops', count(*), count(DISTINCT route_id), count(*) FILTER (is_active) FROM route_stops
       UNION ALL SELECT 'admin_boundaries', count(*), count(DISTINCT sggnm), count(*) FROM boundaries
       UNION ALL SELECT 'spatial_mapping', count(*), count(DISTINCT sgg_name), count(*) FILTER (is_seoul) FROM sm"""
register("infra_quality", "table_name:s total_records:i complete_records:i active_records:i", infra, INFRA_SQL)


def facts(t):
    return quality.fact_quality(
        {
            "station_passenger_history": (t.sph, ["route_id"], ["node_id"]),
            "section_passenger_history": (t.sections, ["route_id"], ["from_node_id", "to_node_id"]),
            "od_traffic_history": (t.dong_od, ["start_district"], ["end_district"]),
            "section_speed_history": (t.speeds, ["route_id"], ["from_node_id", "to_node_id"]),
        }
    )


FACT_COLUMNS = "table_name:s total_records:i earliest_date:s latest_date:s unique_routes:i unique_stations:i"
FACT_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, count(*) AS total_records, min(record_date) AS earliest_date, max(record_date) AS latest_date,
    count(DISTINCT {route}) AS unique_routes, count(DISTINCT {station}) AS unique_stations FROM {table}"""
    for name, table, route, station in (
        ("station_passenger_history", "sph", "route_id", "node_id"),
        ("section_passenger_history", "sections", "route_id", "from_node_id || '-' || to_node_id"),
        ("od_traffic_history", "dong_od", "start_district", "end_district"),
        ("section_speed_history", "speeds", "route_id", "from_node_id || '-' || to_node_id"),
    )
)
register("fact_quality", FACT_COLUMNS, facts, FACT_SQL)
register(
    "union_all",
    "table_name:s total_records:i",
    lambda t: facts(t).select("table_name", "total_records").unionByName(infra(t).select("table_name", "total_records")),
    f"SELECT table_name, total_records FROM ({FACT_SQL}) UNION ALL SELECT table_name, total_records FROM ({INFRA_SQL})",
)


def roads(t):
    return t.ev.select(
        "record_date",
        (F.col("event_id") % 5 != 0).cast("int").alias("data_quality_flag"),
        (F.col("event_id") % 7).alias("days_delayed"),
        F.concat(F.lit("road "), F.col("user_id").cast("string")).alias("road_name"),
    )


register(
    "feed_delay_monitor",
    "latest_data_date:s total_records:i quality_percentage:f4 avg_delay_days:f4 unique_roads:i reliable_roads:i current_delay_days:i data_status:s",
    lambda t: quality.feed_delay_monitor(roads(t), TODAY),
    f"""SELECT *, CASE WHEN current_delay_days <= 5 THEN 'NORMAL' WHEN current_delay_days <= 10 THEN 'WARNING' ELSE 'DEGRADED' END AS data_status FROM (
       SELECT max(record_date) AS latest_data_date, count(*) AS total_records, 100 * avg(CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END) AS quality_percentage,
       avg(event_id % 7) AS avg_delay_days, count(DISTINCT user_id) AS unique_roads, count(DISTINCT user_id) FILTER (event_id % 5 <> 0) AS reliable_roads,
       DATE '{TODAY}' - max(record_date) AS current_delay_days FROM ev)""",
)
register(
    "station_hourly_stats",
    "record_count:i latest_month:s districts_count:i stations_count:i avg_records_per_station:f2",
    lambda t: quality.station_hourly_stats(shp(t)),
    """SELECT count(*) AS record_count, max(month_date) AS latest_month, count(DISTINCT district_name) AS districts_count,
       count(DISTINCT station_id) AS stations_count, count(*) / count(DISTINCT station_id) AS avg_records_per_station FROM shp""",
)
register(
    "load_verification",
    "check:s item:s value:f2",
    lambda t: quality.load_verification(
        {"routes": t.routes, "stops": t.stops, "route_stops": t.route_stops, "boundaries": t.boundaries, "spatial_mapping": t.sm}, t.boundaries, t.routes, t.sm
    ),
    """SELECT 'rows' AS "check", 'routes' AS item, count(*) AS value FROM routes UNION ALL SELECT 'rows', 'stops', count(*) FROM stops
       UNION ALL SELECT 'rows', 'route_stops', count(*) FROM route_stops UNION ALL SELECT 'rows', 'boundaries', count(*) FROM boundaries
       UNION ALL SELECT 'rows', 'spatial_mapping', count(*) FROM sm
       UNION ALL SELECT * FROM (SELECT 'boundaries', sggnm, count(*) FROM boundaries GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
       UNION ALL SELECT * FROM (SELECT 'longest_routes', route_name, total_distance_km FROM routes ORDER BY 3 DESC, route_id LIMIT 5)
       UNION ALL SELECT 'route_types', route_type, count(*) FROM routes GROUP BY 2
       UNION ALL SELECT 'mapping_repeats', 'spatial_mapping', count(*) - count(DISTINCT node_id) FROM sm""",
)


def constraints(t):
    v = F.col("v")
    return quality.constraint_check(
        [
            quality.repeated_keys(t.sph, ["record_date", "route_id", "node_id", "hour"], "station key"),
            quality.repeated_keys(t.ev, ["user_id", "hour"], "event key"),
            quality.missing_parents(t.sph, "node_id", t.stops.filter("is_active"), "node_id", "active stop exists"),
            quality.failed_checks(t.ev, {"hour range": F.col("hour").between(0, 23), "value positive": v > 0, "value at most 100": v <= 100}),
        ]
    )


register(
    "constraint_check",
    "rule:s violations:i",
    constraints,
    """SELECT 'station key' AS rule, 0 AS violations
       UNION ALL SELECT 'event key', count(*) FROM (SELECT user_id, hour FROM ev GROUP BY ALL HAVING count(*) > 1)
       UNION ALL SELECT 'active stop exists', count(*) FROM sph WHERE node_id NOT IN (SELECT node_id FROM stops WHERE is_active)
       UNION ALL SELECT 'hour range', count(*) FILTER (NOT (hour BETWEEN 0 AND 23)) FROM ev
       UNION ALL SELECT 'value positive', count(*) FILTER (v <= 0) FROM ev
       UNION ALL SELECT 'value at most 100', count(*) FILTER (v > 100) FROM ev""",
)
register(
    "paged_scan",
    "o_orderkey:i idx:i",
    lambda t: dense_index(t.raw("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").filter(F.col("idx").between(2000, 2999)),
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000 OFFSET 2000""",
)

# SQL surface --------------------------------------------------------------------------------------


def guarded(t):
    """Ten of twenty districts: the limit in the subquery doesn't end the query."""
    shp(t).createOrReplaceTempView("station_hourly_patterns")
    found = sql_rules.guarded_sql(
        t.spark,
        """SELECT district_name, sum(total_traffic) AS total_traffic FROM station_hourly_patterns
           WHERE district_name IN (SELECT district_name FROM station_hourly_patterns GROUP BY district_name ORDER BY district_name LIMIT 20)
           GROUP BY district_name ORDER BY total_traffic DESC, district_name;""",
        limit=10,
    )
    totals = one_row(found.summary, "row_count", "truncated")
    return found.rows.withColumn("totals", totals).select("district_name", "total_traffic", "totals.*")


register(
    "guarded_sql",
    "district_name:s total_traffic:i row_count:i truncated:b",
    guarded,
    """SELECT district_name, total_traffic, count(*) OVER () AS row_count, found > 10 AS truncated FROM (
         SELECT *, count(*) OVER () AS found FROM (SELECT district_name, sum(total_traffic) AS total_traffic FROM shp
           WHERE district_name IN (SELECT DISTINCT district_name FROM shp ORDER BY 1 LIMIT 20) GROUP BY 1)
         ORDER BY total_traffic DESC, district_name LIMIT 10)""",
)


def sql_functions(t):
    sql_rules.register_sql_functions(t.spark)
    rows = features(t).join(t.stops.select(F.col("node_id").alias("stop_id"), "latitude", "longitude"), "stop_id")
    rows.createOrReplaceTempView("feature_rows")
    return t.spark.sql(
        """SELECT stop_id, recorded_at,
                  calculate_drt_probability(boarding_count, applicable_interval, hour_of_day, is_weekend, is_holiday, service_availability) AS p,
                  calculate_distance(latitude, longitude, 37.5665, 126.978) AS metres
           FROM feature_rows"""
    )


register(
    "sql_functions",
    "stop_id:s recorded_at:s p:f3 metres:f1",
    sql_functions,
    """SELECT stop_id, recorded_at, round(p + 1e-10, 4) AS p, 2 * 6371000 * asin(sqrt(pow(sin(radians(37.5665 - latitude) / 2), 2)
         + cos(radians(latitude)) * cos(radians(37.5665)) * pow(sin(radians(126.978 - longitude) / 2), 2))) AS metres
       FROM featp JOIN stops ON stop_id = node_id""",
)


def table_functions(t):
    """The parameterised builders behind the set-returning functions, as one result."""
    s = shp(t)
    night = anomaly.night_peak_hour(anomaly.night_demand(s, MONTH, "NATION_3")).select(
        F.lit("night").alias("source"), "station_id", F.col("total_night_ride").alias("value"), "peak_hour"
    )
    rush = anomaly.rush_hour_top(s, MONTH, "NATION_3").select(
        F.lit("rush").alias("source"), "station_id", F.col("total_rush_ride").alias("value"), F.lit(None).cast("int").alias("peak_hour")
    )
    window = seq.feature_window(features(t), "2024-01-15 12:00:00", ["boarding_count"]).groupBy(F.col("scale_type").alias("source")).agg(
        F.min("stop_id").alias("station_id"), F.sum(F.size("recorded_at_sequence")).alias("value"), F.lit(None).cast("int").alias("peak_hour")
    )
    return night.unionByName(rush).unionByName(window)


register(
    "table_functions",
    "source:s station_id:s value:i peak_hour:i",
    table_functions,
    """SELECT * FROM (SELECT 'night' AS source, station_id, sum(total_ride) AS value,
         arg_max(hour, (h, -list_position([23, 0, 1, 2, 3], hour))) AS peak_hour
         FROM (SELECT station_id, hour, sum(total_ride) AS total_ride, sum(total_ride) AS h FROM shp WHERE district_name = 'NATION_3' AND hour IN (23, 0, 1, 2, 3) GROUP BY ALL)
         GROUP BY station_id HAVING sum(total_ride) > 0 ORDER BY 3 DESC, 2 LIMIT 5)
       UNION ALL SELECT * FROM (SELECT 'rush', station_id, sum(total_ride), NULL FROM shp
         WHERE district_name = 'NATION_3' AND day_type = 'weekday' AND hour IN (7, 8, 17, 18, 19) GROUP BY station_id HAVING sum(total_ride) > 0 ORDER BY 3 DESC, 2 LIMIT 5)"""
    + "".join(
        f""" UNION ALL SELECT '{s}', min(stop_id), count(*), NULL FROM usage WHERE recorded_at >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL {lo} HOUR
         AND recorded_at < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL {hi} HOUR"""
        for s, lo, hi in (("hour", 6, 0), ("day", 24, 0), ("week", 192, 168))
    ),
)
