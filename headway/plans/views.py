"""Base aggregate tables (survey section 2.5) and plain scans, predicates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import calendar as cal
from headway.operators import joins, views
from headway.plans.registry import define, register
from headway.plans.stored import stored

define(
    "cityfacts",
    """SELECT sph.*, sgg_code, sgg_name, adm_name, ride_passenger + alight_passenger AS traffic
       FROM sph JOIN sm ON sph.node_id = sm.node_id WHERE is_seoul""",
)

register(
    "hourly_traffic_patterns",
    "month_date:s day_type:s sgg_code:s sgg_name:s hour:i avg_ride_passengers:f2 avg_alight_passengers:f2 "
    "avg_total_passengers:f2 max_ride_passengers:i max_alight_passengers:i min_ride_passengers:i "
    "min_alight_passengers:i sample_count:i station_count:i day_count:i",
    lambda t: views.hourly_traffic_patterns(t.sph, t.sm),
    """SELECT month_date, day_type, sgg_code, sgg_name, hour, avg(ride_passenger) AS avg_ride_passengers,
       avg(alight_passenger) AS avg_alight_passengers, avg(traffic) AS avg_total_passengers,
       max(ride_passenger) AS max_ride_passengers, max(alight_passenger) AS max_alight_passengers,
       min(ride_passenger) AS min_ride_passengers, min(alight_passenger) AS min_alight_passengers,
       count(*) AS sample_count, count(DISTINCT node_id) AS station_count,
       count(DISTINCT record_date) AS day_count FROM cityfacts GROUP BY ALL""",
)
register(
    "district_monthly_traffic",
    "month_date:s district_code:s district_name:s total_ride:i total_alight:i total_traffic:i "
    "avg_daily_traffic:f2 station_count:i operating_days:i q1_traffic:f4 q2_traffic:f4 q3_traffic:f4 "
    "max_hourly_traffic:i min_hourly_traffic:i",
    lambda t: views.district_monthly_traffic(t.sph, t.sm),
    """SELECT month_date, sgg_code AS district_code, sgg_name AS district_name, sum(ride_passenger) AS total_ride,
       sum(alight_passenger) AS total_alight, sum(traffic) AS total_traffic, avg(traffic) AS avg_daily_traffic,
       count(DISTINCT node_id) AS station_count, count(DISTINCT record_date) AS operating_days,
       quantile_cont(traffic, 0.25) AS q1_traffic, quantile_cont(traffic, 0.5) AS q2_traffic,
       quantile_cont(traffic, 0.75) AS q3_traffic, max(traffic) AS max_hourly_traffic,
       min(traffic) AS min_hourly_traffic FROM cityfacts GROUP BY ALL""",
)
register(
    "station_monthly_traffic",
    "month_date:s sgg_code:s district_name:s station_id:s station_name:s latitude:f6 longitude:f6 total_ride:i "
    "total_alight:i total_traffic:i daily_average:f2 operating_days:i route_count:i operating_hours:i",
    lambda t: views.station_monthly_traffic(t.sph, t.sm, t.stops),
    """SELECT month_date, sgg_code, sgg_name AS district_name, c.node_id AS station_id, node_name AS station_name,
       latitude, longitude, sum(ride_passenger) AS total_ride, sum(alight_passenger) AS total_alight,
       sum(traffic) AS total_traffic, avg(traffic) AS daily_average, count(DISTINCT record_date) AS operating_days,
       count(DISTINCT route_id) AS route_count, count(DISTINCT hour) AS operating_hours
       FROM cityfacts AS c JOIN stops ON c.node_id = stops.node_id GROUP BY ALL""",
)
define(
    "district_hours",
    """SELECT month_date, day_type, sgg_name, hour, round(avg(ride_passenger) + 1e-9, 2) AS ar,
       round(avg(alight_passenger) + 1e-9, 2) AS aa, round(avg(traffic) + 1e-9, 2) AS tt,
       max(ride_passenger) AS mr, max(alight_passenger) AS ma, count(*) AS n, count(DISTINCT node_id) AS k
       FROM cityfacts GROUP BY ALL""",
)
register(
    "city_hourly_patterns",
    "month_date:s day_type:s hour:i avg_ride_passengers:f4 avg_alight_passengers:f4 avg_total_passengers:f4 "
    "max_ride_passengers:i max_alight_passengers:i total_samples:i total_stations:i",
    lambda t: views.city_hourly_patterns(views.hourly_traffic_patterns(t.sph, t.sm)),
    """SELECT month_date, day_type, hour, sum(ar * n) / sum(n) AS avg_ride_passengers,
       sum(aa * n) / sum(n) AS avg_alight_passengers, sum(tt * n) / sum(n) AS avg_total_passengers,
       max(mr) AS max_ride_passengers, max(ma) AS max_alight_passengers, sum(n) AS total_samples,
       sum(k) AS total_stations FROM district_hours GROUP BY ALL""",
)
SHP_COLUMNS = (
    "month_date:s day_type:s sgg_code:s district_name:s station_id:s station_name:s latitude:f6 longitude:f6 "
    "administrative_dong:s hour:i total_ride:i total_alight:i total_traffic:i operating_days:i route_count:i "
    "record_count:i"
)


def shp(t, month=None):
    """Station-hour patterns; those of one month come from the stored view."""
    if month is not None:
        return stored(t, "station_hourly_patterns", month)
    return t.built("shp", lambda: views.station_hourly_patterns(t.sph, t.sm, t.stops))


register("station_hourly_patterns", SHP_COLUMNS, shp, "SELECT * FROM shp")
register(
    "monthly_district_summary",
    "analysis_month:s sgg_code:s sgg_name:s station_count:i total_traffic:i total_ride:i total_alight:i "
    "avg_daily_traffic:f4 max_daily_traffic:i",
    lambda t: views.monthly_district_summary(t.sph, t.sm),
    """SELECT month_date AS analysis_month, sgg_code, sgg_name, count(DISTINCT node_id) AS station_count,
       sum(traffic) AS total_traffic, sum(ride_passenger) AS total_ride, sum(alight_passenger) AS total_alight,
       avg(traffic) AS avg_daily_traffic, max(traffic) AS max_daily_traffic FROM cityfacts GROUP BY ALL""",
)
define(
    "daysum",
    """SELECT record_date, count(*) AS total_records, sum(ride_passenger) AS total_boarding,
       sum(alight_passenger) AS total_alighting, sum(ride_passenger + alight_passenger) AS total_traffic,
       avg(ride_passenger) AS avg_boarding, avg(alight_passenger) AS avg_alighting,
       max(ride_passenger) AS max_boarding, max(alight_passenger) AS max_alighting,
       count(DISTINCT node_id) AS active_stations, count(DISTINCT route_id) AS active_routes
       FROM sph GROUP BY record_date""",
)
register(
    "daily_traffic_summary",
    "record_date:s total_records:i total_boarding:i total_alighting:i total_traffic:i avg_boarding:f4 "
    "avg_alighting:f4 max_boarding:i max_alighting:i active_stations:i active_routes:i",
    lambda t: views.daily_traffic_summary(t.sph),
    "SELECT * FROM daysum",
)
define(
    "dayhours",
    """SELECT record_date, hour, sum(ride_passenger) AS total_boarding, sum(alight_passenger) AS total_alighting,
       sum(ride_passenger + alight_passenger) AS total_traffic, avg(ride_passenger) AS avg_boarding,
       avg(alight_passenger) AS avg_alighting, count(DISTINCT node_id) AS active_stations,
       count(DISTINCT route_id) AS active_routes FROM sph GROUP BY record_date, hour""",
)
register(
    "daily_hourly_traffic",
    "record_date:s hour:i total_boarding:i total_alighting:i total_traffic:i avg_boarding:f4 avg_alighting:f4 "
    "active_stations:i active_routes:i",
    lambda t: views.daily_hourly_traffic(t.sph),
    "SELECT * FROM dayhours",
)
define(
    "daydistricts",
    """SELECT record_date, sgg_name AS district_name, sum(ride_passenger) AS total_boarding,
       sum(alight_passenger) AS total_alighting, sum(traffic) AS total_traffic, avg(ride_passenger) AS avg_boarding,
       avg(alight_passenger) AS avg_alighting, count(DISTINCT node_id) AS active_stations,
       count(DISTINCT route_id) AS active_routes FROM cityfacts GROUP BY ALL""",
)
register(
    "daily_district_traffic",
    "record_date:s district_name:s total_boarding:i total_alighting:i total_traffic:i avg_boarding:f4 "
    "avg_alighting:f4 active_stations:i active_routes:i",
    lambda t: views.daily_district_traffic(t.sph, t.sm),
    "SELECT * FROM daydistricts",
)
register(
    "daily_station_traffic",
    "record_date:s node_id:s district_name:s total_boarding:i total_alighting:i total_traffic:i route_count:i",
    lambda t: views.daily_station_traffic(t.sph, t.sm),
    """SELECT record_date, sph.node_id, sgg_name AS district_name, sum(ride_passenger) AS total_boarding,
       sum(alight_passenger) AS total_alighting, sum(ride_passenger + alight_passenger) AS total_traffic,
       count(DISTINCT route_id) AS route_count FROM sph LEFT JOIN sm ON sph.node_id = sm.node_id
       GROUP BY ALL HAVING sum(ride_passenger + alight_passenger) > 100""",
)
register(
    "period_summary",
    "period_start:s period_end:s total_days:i total_boarding:i total_alighting:i total_traffic:i "
    "avg_daily_traffic:f4 max_daily_traffic:i min_daily_traffic:i avg_active_stations:f4 avg_active_routes:f4",
    lambda t: views.period_summary(views.daily_traffic_summary(t.sph)),
    """SELECT min(record_date) AS period_start, max(record_date) AS period_end, count(*) AS total_days,
       sum(total_boarding) AS total_boarding, sum(total_alighting) AS total_alighting,
       sum(total_traffic) AS total_traffic, avg(total_traffic) AS avg_daily_traffic,
       max(total_traffic) AS max_daily_traffic, min(total_traffic) AS min_daily_traffic,
       avg(active_stations) AS avg_active_stations, avg(active_routes) AS avg_active_routes FROM daysum""",
)
register(
    "hourly_pattern",
    "hour:i total_boarding:i total_alighting:i total_traffic:i avg_traffic:f4 data_points:i",
    lambda t: views.hourly_pattern(views.daily_hourly_traffic(t.sph)),
    """SELECT hour, sum(total_boarding) AS total_boarding, sum(total_alighting) AS total_alighting,
       sum(total_traffic) AS total_traffic, avg(total_traffic) AS avg_traffic, count(*) AS data_points
       FROM dayhours GROUP BY hour""",
)
RANK_SQL = """SELECT district_name, sum(total_boarding) AS total_boarding, sum(total_alighting) AS total_alighting,
       sum(total_traffic) AS total_traffic, avg(total_traffic) AS avg_daily_traffic, count(*) AS data_points,
       rank() OVER (ORDER BY sum(total_traffic) DESC) AS traffic_rank FROM daydistricts GROUP BY district_name"""
register(
    "district_ranking",
    "district_name:s total_boarding:i total_alighting:i total_traffic:i avg_daily_traffic:f4 data_points:i "
    "traffic_rank:i",
    lambda t: views.district_ranking(views.daily_district_traffic(t.sph, t.sm)),
    RANK_SQL,
)
register(
    "rank_over_total",
    "record_date:s traffic_rank:i total_traffic:i",
    lambda t: views.daily_traffic_summary(t.sph)
    .withColumnRenamed("record_date", "district_name")
    .transform(lambda d: views.rank_districts(d, "total_traffic", "traffic_rank"))
    .withColumnRenamed("district_name", "record_date"),
    "SELECT record_date, rank() OVER (ORDER BY total_traffic DESC) AS traffic_rank, total_traffic FROM daysum",
)
register(
    "stop_weekly_avg",
    "stop_id:s stop_name:s avg_boarding:f4 avg_alighting:f4 days_with_data:i",
    lambda t: views.stop_weekly_avg(t.usage, t.stops, "2024-01-31"),
    """SELECT stop_id, node_name AS stop_name, avg(boarding_count) AS avg_boarding,
       avg(alighting_count) AS avg_alighting, count(DISTINCT CAST(recorded_at AS DATE)) AS days_with_data
       FROM usage JOIN stops ON stop_id = node_id
       WHERE recorded_at >= TIMESTAMP '2024-01-24' AND is_operational GROUP BY stop_id, node_name""",
)
define(
    "stopstats",
    """SELECT stop_id, coalesce(round(avg(dispatch_interval)), 1440) AS avg_weekday_interval,
       coalesce(round(avg(saturday_interval)), 1440) AS avg_saturday_interval,
       coalesce(round(avg(sunday_interval)), 1440) AS avg_sunday_interval,
       count(DISTINCT routes.route_id) AS route_count
       FROM route_stops LEFT JOIN routes ON route_stops.route_id = routes.route_id GROUP BY stop_id""",
)
register(
    "stop_route_stats",
    "stop_id:s avg_weekday_interval:f1 avg_saturday_interval:f1 avg_sunday_interval:f1 route_count:i",
    lambda t: views.stop_route_stats(t.route_stops, t.routes),
    "SELECT * FROM stopstats",
)
register(
    "heatmap_query_totals",
    "district_name:s total_ride:i total_alight:i total_traffic:i",
    lambda t: views.heatmap_query_totals(t.sph, t.sm, "2024-01-08", "2024-01-21"),
    """SELECT sgg_name AS district_name, sum(ride_passenger) AS total_ride, sum(alight_passenger) AS total_alight,
       sum(traffic) AS total_traffic FROM cityfacts
       WHERE record_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY sgg_name""",
)

# scans, predicates and simple joins ---------------------------------------------------------
register(
    "scan_table",
    "route_id:s node_id:s hour:i record_date:s ride_passenger:i",
    lambda t: t.sph.filter(cal.month_filter(F.col("record_date"), "2024-01-01")),
    """SELECT route_id, node_id, hour, record_date, ride_passenger FROM sph
       WHERE record_date >= DATE '2024-01-01' AND record_date < DATE '2024-02-01'""",
)
register(
    "day_type",
    "o_orderkey:i day_type:s",
    lambda t: t.raw("orders").select("o_orderkey", cal.day_type(F.col("o_orderdate").cast("date")).alias("day_type")),
    """SELECT o_orderkey, CASE WHEN dayofweek(o_orderdate) BETWEEN 1 AND 5 THEN 'weekday' ELSE 'weekend' END
       AS day_type FROM orders""",
)
register(
    "date_parts",
    "o_orderkey:i day_of_week:i is_weekend:b week_of_month:i",
    lambda t: cal.date_parts(
        t.raw("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")), "d"
    ),
    """SELECT o_orderkey, dayofweek(o_orderdate) AS day_of_week, dayofweek(o_orderdate) IN (0, 6) AS is_weekend,
       (day(o_orderdate) + 6) // 7 AS week_of_month FROM orders""",
)
register(
    "month_bucket",
    "month_date:s orders:i",
    lambda t: t.raw("orders")
    .groupBy(cal.month_bucket(F.col("o_orderdate").cast("date")).alias("month_date"))
    .agg(F.count(F.lit(1)).alias("orders")),
    "SELECT date_trunc('month', o_orderdate)::DATE AS month_date, count(*) AS orders FROM orders GROUP BY 1",
)
register(
    "time_band",
    "record_date:s node_id:s hour:i route_id:s vulnerable_category:s is_tourism_time:b",
    lambda t: t.sph.select(
        "record_date",
        "node_id",
        "hour",
        "route_id",
        cal.vulnerable_band(F.col("hour")).alias("vulnerable_category"),
        cal.is_tourism_hour(F.col("hour")).alias("is_tourism_time"),
    ),
    """SELECT record_date, node_id, hour, route_id,
       CASE WHEN hour IN (9, 10, 11) THEN 'medical' WHEN hour IN (14, 15, 16) THEN 'welfare'
            WHEN hour IN (18, 19, 20) THEN 'evening' ELSE 'normal' END AS vulnerable_category,
       hour >= 10 AND hour <= 16 AS is_tourism_time FROM sph""",
)
register(
    "min_traffic_filter",
    "station_id:s day_type:s hour:i total_traffic:i",
    lambda t: shp(t).filter(F.col("total_traffic") > F.coalesce(F.lit(20), F.lit(0))),
    "SELECT station_id, day_type, hour, total_traffic FROM shp WHERE total_traffic > 20",
)
register(
    "optional_district_filter",
    "district_name:s station_id:s total_traffic:i",
    lambda t: joins.in_district(shp(t), "NATION_3").groupBy("district_name", "station_id").agg(F.sum("total_traffic").alias("total_traffic")),
    """SELECT district_name, station_id, sum(total_traffic) AS total_traffic FROM shp
       WHERE district_name = 'NATION_3' GROUP BY ALL""",
)
register(
    "in_list",
    "district_name:s hour:i total_traffic:i",
    lambda t: shp(t)
    .filter(F.col("district_name").isin("NATION_1", "NATION_2", "NATION_7"))
    .groupBy("district_name", "hour")
    .agg(F.sum("total_traffic").alias("total_traffic")),
    """SELECT district_name, hour, sum(total_traffic) AS total_traffic FROM shp
       WHERE district_name IN ('NATION_1', 'NATION_2', 'NATION_7') GROUP BY ALL""",
)
register(
    "any_array",
    "station_id:s total_traffic:i",
    lambda t: shp(t)
    .join(joins.top_n(views.district_ranking(views.daily_district_traffic(t.sph, t.sm)), 3, F.asc("traffic_rank"), F.asc("district_name")).select("district_name"), "district_name", "left_semi")
    .groupBy("station_id")
    .agg(F.sum("total_traffic").alias("total_traffic")),
    """SELECT station_id, sum(total_traffic) AS total_traffic FROM shp WHERE district_name IN
       (SELECT district_name FROM daydistricts GROUP BY 1 ORDER BY sum(total_traffic) DESC, 1 LIMIT 3)
       GROUP BY station_id""",
)
register(
    "data_range_flag",
    "o_orderkey:i format_ok:b in_range:b suggested_date:s",
    lambda t: cal.data_range_flag(
        t.raw("orders").select(
            "o_orderkey",
            F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("asked"),
        ),
        "asked",
        t.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("record_date")),
    ),
    """SELECT o_orderkey, asked IS NOT NULL AS format_ok, coalesce(asked BETWEEN lo AND hi, false) AS in_range,
       CASE WHEN asked BETWEEN lo AND hi THEN asked ELSE hi END AS suggested_date
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE END AS asked,
             (SELECT min(l_shipdate)::DATE FROM lineitem) AS lo, (SELECT max(l_shipdate)::DATE FROM lineitem) AS hi
             FROM orders)""",
)
register(
    "active_station_count",
    "district_name:s active_stations:i",
    lambda t: joins.active_stations(t.sph, t.sm, "2024-01-08", "2024-01-21"),
    """SELECT sgg_name AS district_name, count(DISTINCT node_id) AS active_stations FROM cityfacts
       WHERE record_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' AND traffic > 0 GROUP BY 1""",
)
register(
    "time_slice_filters",
    "slice:s total_ride:i total_alight:i",
    lambda t: joins.time_slices(shp(t)),
    """SELECT 'night' AS slice, sum(total_ride) AS total_ride, sum(total_alight) AS total_alight FROM shp
       WHERE hour IN (23, 0, 1, 2, 3)
       UNION ALL SELECT 'rush', sum(total_ride), sum(total_alight) FROM shp
       WHERE hour IN (6, 7, 8, 17, 18, 19) AND day_type = 'weekday'
       UNION ALL SELECT 'weekend', sum(total_ride), sum(total_alight) FROM shp WHERE day_type = 'weekend'""",
)
register(
    "fact_dim_join",
    "record_date:s route_id:s node_id:s hour:i sgg_name:s node_name:s day_type:s traffic:i",
    lambda t: joins.fact_dim(views.dated(t.sph), t.sm, t.stops),
    """SELECT record_date, route_id, c.node_id, hour, sgg_name, node_name, day_type, traffic
       FROM cityfacts AS c JOIN stops ON c.node_id = stops.node_id""",
)
register(
    "left_enrich",
    "s_suppkey:i node_name:s sgg_name:s",
    lambda t: t.raw("supplier")
    .select("s_suppkey", (F.col("s_suppkey") * 29).cast("string").alias("node_id"))
    .join(t.stops, "node_id", "left")
    .join(t.sm, "node_id", "left"),
    """SELECT s_suppkey, node_name, sgg_name FROM supplier LEFT JOIN stops ON CAST(s_suppkey * 29 AS VARCHAR) = stops.node_id
       LEFT JOIN sm ON CAST(s_suppkey * 29 AS VARCHAR) = sm.node_id""",
)
register(
    "or_join_sections",
    "node_id:s hour:i passengers:i",
    lambda t: joins.section_ends(t.sections, "hour", "passenger_count")
    .groupBy("node_id", "hour")
    .agg(F.sum("passenger_count").alias("passengers")),
    """SELECT node_id, hour, sum(passenger_count) AS passengers FROM (
         SELECT from_node_id AS node_id, hour, passenger_count FROM sections
         UNION ALL SELECT to_node_id, hour, passenger_count FROM sections WHERE to_node_id <> from_node_id)
       GROUP BY ALL""",
)
register(
    "grid_cross_join",
    "station_id:s hour:i",
    lambda t: joins.hours_grid(shp(t).select("station_id").distinct()),
    "SELECT station_id, unnest(range(24)) AS hour FROM (SELECT DISTINCT station_id FROM shp)",
)
register(
    "scalar_cross_join",
    "station_id:s scaled:f4",
    lambda t: joins.min_max_scaled(shp(t).groupBy("station_id").agg(F.sum("total_traffic").alias("v")), "v", "scaled"),
    """SELECT station_id, (v - (SELECT min(v) FROM (SELECT sum(total_traffic) AS v FROM shp GROUP BY station_id)))
       / ((SELECT max(v) - min(v) FROM (SELECT sum(total_traffic) AS v FROM shp GROUP BY station_id))) AS scaled
       FROM (SELECT station_id, CAST(sum(total_traffic) AS DOUBLE) AS v FROM shp GROUP BY station_id)""",
)
register(
    "semi_exists",
    "node_id:s node_name:s",
    lambda t: t.stops.join(shp(t).select(F.col("station_id").alias("node_id")), "node_id", "left_semi"),
    "SELECT node_id, node_name FROM stops WHERE node_id IN (SELECT station_id FROM shp)",
)
register(
    "row_number_per_group",
    "station_id:s hour:i traffic:i rank:i",
    lambda t: joins.best_per_group(
        shp(t).groupBy("station_id", "hour").agg(F.sum("total_traffic").alias("traffic")),
        ["station_id"], 24, F.desc("traffic"), F.asc("hour"),
    ),
    """SELECT station_id, hour, traffic, row_number() OVER (PARTITION BY station_id ORDER BY traffic DESC, hour) AS rank
       FROM (SELECT station_id, hour, sum(total_traffic) AS traffic FROM shp GROUP BY ALL)""",
)
register(
    "first_by_order",
    "station_id:s peak_hour:i",
    lambda t: shp(t)
    .groupBy("station_id", "hour").agg(F.sum("total_traffic").alias("v"))
    .groupBy("station_id").agg(F.max_by("hour", F.struct("v", -F.col("hour"))).alias("peak_hour")),
    """SELECT station_id, first(hour ORDER BY v DESC, hour) AS peak_hour
       FROM (SELECT station_id, hour, sum(total_traffic) AS v FROM shp GROUP BY ALL) GROUP BY station_id""",
)
register(
    "any_value_array",
    "node_id:s first_route:s",
    lambda t: t.sph.groupBy("node_id").agg(F.min_by("route_id", F.struct("record_date", "hour", "route_id")).alias("first_route")),
    "SELECT node_id, first(route_id ORDER BY record_date, hour, route_id) AS first_route FROM sph GROUP BY node_id",
)
register(
    "group_max_broadcast",
    "station_id:s day_type:s hour:i share:f6",
    lambda t: joins.share_of_max(shp(t), ["station_id", "day_type"], "total_traffic", "share"),
    """SELECT station_id, day_type, hour, CASE WHEN m > 0 THEN total_traffic / m ELSE 0 END AS share FROM
       (SELECT *, max(total_traffic) OVER (PARTITION BY station_id, day_type) AS m FROM shp)""",
)
register(
    "top_n",
    "station_id:s traffic:i",
    lambda t: joins.top_n(shp(t).groupBy("station_id").agg(F.sum("total_traffic").alias("traffic")), 10, F.desc("traffic"), F.asc("station_id")),
    "SELECT station_id, sum(total_traffic) AS traffic FROM shp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
register(
    "union_distinct",
    "station_id:s",
    lambda t: shp(t).filter("day_type = 'weekday'").select("station_id").union(shp(t).filter("day_type = 'weekend'").select("station_id")).distinct(),
    "SELECT DISTINCT station_id FROM shp",
)
register(
    "distinct_months",
    "month_date:s",
    lambda t: t.raw("orders").select(cal.month_bucket(F.col("o_orderdate").cast("date")).alias("month_date")).distinct().orderBy(F.desc("month_date")),
    "SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month_date FROM orders",
)
register(
    "nullif_ratio",
    "station_id:s day_type:s hour:i ride_share:f6",
    lambda t: shp(t).withColumn("ride_share", F.try_divide(F.col("total_ride").cast("double"), F.col("total_ride") + F.col("total_alight"))),
    """SELECT station_id, day_type, hour, total_ride / nullif(total_ride + total_alight, 0) AS ride_share FROM shp""",
)
register(
    "greatest_least_coalesce",
    "station_id:s day_type:s hour:i per_day:f4 capped:f4",
    lambda t: shp(t).withColumns(
        {
            "per_day": F.col("total_traffic") / F.greatest("operating_days", F.lit(1)),
            "capped": F.least(F.coalesce(F.col("total_traffic"), F.lit(0)) / 1000, F.lit(1.0)),
        }
    ),
    """SELECT station_id, day_type, hour, total_traffic / greatest(operating_days, 1) AS per_day,
       least(total_traffic / 1000, 1.0) AS capped FROM shp""",
)
register(
    "concat_key",
    "route_id:s section_pairs:i",
    lambda t: t.sections.groupBy("route_id").agg(F.countDistinct("from_node_id", "to_node_id").alias("section_pairs")),
    """SELECT route_id, count(DISTINCT from_node_id || '-' || to_node_id) AS section_pairs FROM sections GROUP BY 1""",
)
register(
    "default_station_list",
    "node_id:s node_name:s sgg_name:s",
    lambda t: joins.top_n(t.stops.filter("is_active").join(joins.in_city(t.sm), "node_id"), 10, F.asc("node_name"), F.asc("node_id")),
    """SELECT stops.node_id, node_name, sgg_name FROM stops JOIN sm ON stops.node_id = sm.node_id
       WHERE is_active AND is_seoul ORDER BY node_name, stops.node_id LIMIT 10""",
)
