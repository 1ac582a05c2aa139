"""Traffic profiles, heat map and indicators (survey section 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import classes
from headway.operators import traffic, views
from headway.plans.registry import define, register
from headway.plans.stored import stored
from headway.sources.mapping import MONTH


def district_hours(t):
    return t.built("district hours", lambda: views.hourly_traffic_patterns(t.sph, t.sm))


def profile(t):
    d = district_hours(t)
    return traffic.regions(views.city_hourly_patterns(d), d)


def hours(t):
    return traffic.hourly_traffic(profile(t))


def districts(t):
    return t.built("districts", lambda: traffic.heatmap_districts(stored(t, "district_monthly_traffic"), MONTH))


def stations(t, threshold=None):
    return traffic.heatmap_stations(stored(t, "station_monthly_traffic"), MONTH, threshold)


define(
    "profile",
    """SELECT month_date, sgg_name AS region_name, day_type, hour, ar, aa, tt FROM district_hours
       UNION ALL SELECT month_date, '서울시 전체', day_type, hour, sum(ar * n) / sum(n), sum(aa * n) / sum(n),
       sum(tt * n) / sum(n) FROM district_hours GROUP BY month_date, day_type, hour""",
)
define(
    "hours24",
    """SELECT g.month_date, g.region_name, g.day_type, g.hour, coalesce(ar, 0) AS ar, coalesce(aa, 0) AS aa,
       coalesce(tt, 0) AS tt FROM (
         SELECT *, unnest(range(24)) AS hour FROM (SELECT DISTINCT month_date, region_name, d AS day_type
         FROM profile, (VALUES ('weekday'), ('weekend')) AS v(d))) AS g
       LEFT JOIN profile AS p ON g.month_date = p.month_date AND g.region_name = p.region_name
         AND g.day_type = p.day_type AND g.hour = p.hour""",
)
register(
    "hourly_traffic",
    "month_date:s region_name:s day_type:s hour:i avg_ride_passengers:f4 avg_alight_passengers:f4 avg_total_passengers:f4",
    hours,
    """SELECT month_date, region_name, day_type, hour, ar AS avg_ride_passengers, aa AS avg_alight_passengers,
       tt AS avg_total_passengers FROM hours24""",
)
define(
    "peaks",
    """SELECT month_date, region_name,
       first(hour ORDER BY tt DESC, hour) FILTER (day_type = 'weekday' AND hour BETWEEN 6 AND 10) AS morning_peak_hour,
       max(tt) FILTER (day_type = 'weekday' AND hour BETWEEN 6 AND 10) AS morning_peak,
       first(hour ORDER BY tt DESC, hour) FILTER (day_type = 'weekday' AND hour BETWEEN 17 AND 20) AS evening_peak_hour,
       max(tt) FILTER (day_type = 'weekday' AND hour BETWEEN 17 AND 20) AS evening_peak,
       first(hour ORDER BY tt DESC, hour) FILTER (day_type = 'weekend') AS weekend_peak_hour,
       max(tt) FILTER (day_type = 'weekend') AS weekend_peak FROM hours24 GROUP BY ALL""",
)
register(
    "peak_hours",
    "month_date:s region_name:s morning_peak_hour:i morning_peak:f1 evening_peak_hour:i evening_peak:f1 "
    "weekend_peak_hour:i weekend_peak:f1",
    lambda t: traffic.peak_hours(hours(t)),
    "SELECT * FROM peaks",
)
define(
    "daysides",
    """SELECT month_date, region_name, floor(wd + 1e-6) AS total_weekday_passengers,
       floor(we + 1e-6) AS total_weekend_passengers,
       CASE WHEN we > 0 THEN round(wd / we + 1e-9, 2) ELSE 0 END AS weekday_weekend_ratio
       FROM (SELECT month_date, region_name, sum(tt) FILTER (day_type = 'weekday') AS wd,
             sum(tt) FILTER (day_type = 'weekend') AS we FROM hours24 GROUP BY ALL)""",
)
register(
    "weekday_weekend_ratio",
    "month_date:s region_name:s total_weekday_passengers:i total_weekend_passengers:i weekday_weekend_ratio:f2",
    lambda t: traffic.weekday_weekend_ratio(hours(t)),
    "SELECT * FROM daysides",
)
register(
    "traffic_profile_totals",
    "month_date:s region_name:s weekday_boarding:f2 weekday_alighting:f2 weekend_boarding:f2 weekend_alighting:f2",
    lambda t: traffic.profile_totals(hours(t)),
    """SELECT month_date, region_name, sum(ar) FILTER (day_type = 'weekday') AS weekday_boarding,
       sum(aa) FILTER (day_type = 'weekday') AS weekday_alighting,
       sum(ar) FILTER (day_type = 'weekend') AS weekend_boarding,
       sum(aa) FILTER (day_type = 'weekend') AS weekend_alighting FROM hours24 GROUP BY ALL""",
)
define(
    "dmonth",
    """SELECT *, row_number() OVER (ORDER BY total_traffic DESC, district_name) AS traffic_rank FROM (
       SELECT sgg_name AS district_name, sgg_code AS district_code, sum(ride_passenger) AS total_ride,
       sum(alight_passenger) AS total_alight, sum(traffic) AS total_traffic,
       count(DISTINCT node_id) AS station_count, avg(traffic) AS avg_daily_traffic
       FROM cityfacts WHERE month_date = DATE '2024-01-01' GROUP BY ALL) WHERE total_traffic > 0""",
)
define(
    "smonth",
    """SELECT sgg_name AS district_name, c.node_id AS station_id, node_name AS station_name, latitude, longitude,
       sum(ride_passenger) AS total_ride, sum(alight_passenger) AS total_alight, sum(traffic) AS total_traffic,
       round(avg(traffic) + 1e-9, 2) AS daily_average
       FROM cityfacts AS c JOIN stops ON c.node_id = stops.node_id
       WHERE month_date = DATE '2024-01-01' GROUP BY ALL HAVING sum(traffic) > 0""",
)
DISTRICT_COLS = (
    "district_code:s district_name:s total_traffic:i total_ride:i total_alight:i avg_daily_traffic:f2 "
    "station_count:i traffic_rank:i traffic_density:f2"
)
register(
    "heatmap_districts",
    DISTRICT_COLS,
    districts,
    "SELECT *, total_traffic / station_count AS traffic_density FROM dmonth",
)
register(
    "district_detail",
    DISTRICT_COLS,
    lambda t: traffic.district_detail(districts(t), "NATION_5"),
    "SELECT *, total_traffic / station_count AS traffic_density FROM dmonth WHERE district_name = 'NATION_5'",
)
register(
    "heatmap_stations",
    "district_name:s station_id:s station_name:s latitude:f6 longitude:f6 total_traffic:i total_ride:i "
    "total_alight:i daily_average:f1",
    lambda t: stations(t, 500),
    "SELECT * FROM smonth WHERE total_traffic > 500",
)


def whole_districts(pages):
    """One row per district: its pages in order, each one shortened to a text before they meet."""
    texts = pages.select(
        "district_name", "total_traffic", "page_no", F.size("stations").alias("n"),
        F.array_join(F.transform("stations", lambda s: s["station_id"]), ",").alias("ids"),
    )
    rows = texts.groupBy("district_name", "total_traffic").agg(
        F.sum("n").alias("station_count"), F.sort_array(F.collect_list(F.struct("page_no", "ids"))).alias("pages")
    )
    listed = F.array_join(F.transform("pages", lambda p: p["ids"]), ",")
    return rows.withColumn("station_list", F.when(F.col("station_count") > 0, listed))


register(
    "heatmap_nested",
    "district_name:s total_traffic:i station_count:i station_list:s",
    lambda t: whole_districts(traffic.heatmap_nested(districts(t), stations(t))),
    """SELECT d.district_name, d.total_traffic, count(station_id) AS station_count,
       string_agg(station_id, ',' ORDER BY s.total_traffic DESC, station_id) AS station_list
       FROM dmonth AS d LEFT JOIN smonth AS s ON d.district_name = s.district_name
       GROUP BY d.district_name, d.total_traffic""",
)


def excl(source: str, prefix: str) -> str:
    """Exclusive quartiles in SQL over the column ``v`` of ``source``."""
    cut = lambda i: (
        f"max(CASE WHEN pos = greatest(least({i} * (n + 1) // 4, n - 1), 1) THEN v END) AS lo{i}, "
        f"max(CASE WHEN pos = greatest(least({i} * (n + 1) // 4, n - 1), 1) + 1 THEN v END) AS hi{i}, "
        f"max({i} * (n + 1) - 4 * greatest(least({i} * (n + 1) // 4, n - 1), 1)) AS w{i}"
    )
    pick = ", ".join(f"CAST(trunc((lo{i} * (4 - w{i}) + hi{i} * w{i}) / 4) AS BIGINT) AS {prefix}{i}" for i in (1, 2, 3))
    return (
        f"SELECT {pick} FROM (SELECT {', '.join(cut(i) for i in (1, 2, 3))} FROM (SELECT v, "
        f"row_number() OVER (ORDER BY v) AS pos, count(*) OVER () AS n FROM ({source})))"
    )


register(
    "quartiles_exclusive",
    "q1:i q2:i q3:i",
    lambda t: traffic.exclusive_quartiles(stations(t), "total_traffic"),
    excl("SELECT total_traffic AS v FROM smonth", "q"),
)
register(
    "heatmap_statistics",
    "max_district_traffic:i min_district_traffic:i max_station_traffic:i min_station_traffic:i total_city_traffic:i "
    "total_stations:i district_q1:i district_q2:i district_q3:i station_q1:i station_q2:i station_q3:i",
    lambda t: traffic.heatmap_statistics(districts(t), stations(t)),
    f"""SELECT max_district_traffic, min_district_traffic, total_city_traffic, max_station_traffic,
       min_station_traffic, total_stations, d.*, s.* FROM
       (SELECT max(total_traffic) AS max_district_traffic, min(total_traffic) AS min_district_traffic,
        sum(total_traffic) AS total_city_traffic FROM dmonth) CROSS JOIN
       (SELECT max(total_traffic) AS max_station_traffic, min(total_traffic) AS min_station_traffic,
        count(*) AS total_stations FROM smonth) CROSS JOIN
       ({excl('SELECT total_traffic AS v FROM dmonth', 'district_q')}) AS d CROSS JOIN
       ({excl('SELECT total_traffic AS v FROM smonth', 'station_q')}) AS s""",
)
register(
    "kpi_overview",
    "total_traffic:i total_stations:i mean_per_district:i max_traffic:i max_district:s min_traffic:i "
    "min_district:s ride_alight_ratio:f2",
    lambda t: traffic.kpi_overview(districts(t)),
    """SELECT sum(total_traffic) AS total_traffic, sum(station_count) AS total_stations,
       floor(avg(total_traffic)) AS mean_per_district, max(total_traffic) AS max_traffic,
       first(district_name ORDER BY total_traffic DESC, district_name) AS max_district,
       min(total_traffic) AS min_traffic, first(district_name ORDER BY total_traffic, district_name) AS min_district,
       sum(total_ride) / sum(total_alight) AS ride_alight_ratio FROM dmonth""",
)
register(
    "kpi_concentration",
    "scope:s top_share_pct:f1",
    lambda t: traffic.kpi_concentration(districts(t), "district_name")
    .withColumn("scope", F.lit("districts"))
    .unionByName(traffic.kpi_concentration(stations(t), "station_id").withColumn("scope", F.lit("stations"))),
    """SELECT 'districts' AS scope, 100.0 * (SELECT sum(total_traffic) FROM (SELECT total_traffic FROM dmonth ORDER BY 1 DESC LIMIT 5))
         / (SELECT sum(total_traffic) FROM dmonth) AS top_share_pct
       UNION ALL SELECT 'stations', 100.0 * (SELECT sum(total_traffic) FROM (SELECT total_traffic FROM smonth ORDER BY 1 DESC LIMIT 5))
         / (SELECT sum(total_traffic) FROM smonth)""",
)
register(
    "kpi_inequality",
    "max_min_ratio:f1 need_class:s",
    lambda t: traffic.kpi_inequality(stations(t)),
    """SELECT r AS max_min_ratio, CASE WHEN r > 10 THEN 'DRT 필요성 매우 높음' WHEN r > 5 THEN 'DRT 필요성 높음'
       WHEN r > 3 THEN 'DRT 필요성 보통' ELSE 'DRT 필요성 낮음' END AS need_class
       FROM (SELECT round(max(total_traffic) / min(total_traffic) + 1e-9, 1) AS r FROM smonth)""",
)
register(
    "overview_metrics",
    "month_date:s total_traffic:i total_passengers:i peak_hour:i top_districts:s traffic_trend:f2 balance_score:i",
    lambda t: (lambda h: traffic.overview_metrics(districts(t), traffic.weekday_weekend_ratio(h), traffic.peak_hours(h)))(hours(t)),
    """SELECT r.month_date, (SELECT sum(total_traffic) FROM dmonth) AS total_traffic,
       total_weekday_passengers + total_weekend_passengers AS total_passengers,
       floor((morning_peak_hour + evening_peak_hour) / 2 + 0.5) AS peak_hour,
       (SELECT string_agg(district_name, ',' ORDER BY traffic_rank) FROM dmonth WHERE traffic_rank <= 5) AS top_districts,
       weekday_weekend_ratio AS traffic_trend,
       CASE WHEN weekday_weekend_ratio = 1 THEN 100
            ELSE least(100, floor((10 / abs(weekday_weekend_ratio - 1) + 50) * 1.2 + 0.5)) END AS balance_score
       FROM daysides AS r JOIN peaks AS p ON r.month_date = p.month_date AND r.region_name = p.region_name
       WHERE r.region_name = '서울시 전체'""",
)
register(
    "top_stations",
    "station_id:s district_name:s total_traffic:i",
    lambda t: traffic.top_stations(stations(t)),
    "SELECT station_id, district_name, total_traffic FROM smonth ORDER BY total_traffic DESC, station_id LIMIT 5",
)
register(
    "station_display_name",
    "station_id:s display_name:s",
    lambda t: traffic.station_display_name(
        t.raw("part").select(
            F.concat(F.lit("stop"), F.col("p_partkey").cast("string")).alias("station_id"),
            F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")).alias("station_name"),
        )
    ),
    """SELECT station_id, CASE WHEN count(*) OVER (PARTITION BY station_name) > 1
         THEN station_name || ' (' || right(station_id, 6) || ')' ELSE station_name END AS display_name
       FROM (SELECT 'stop' || p_partkey AS station_id, p_name || ' ' || p_brand || ' ' || p_size AS station_name FROM part)""",
)


def chain(v: str, scale, other: str, op: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} {op} {limit} THEN '{label}'" for limit, label in scale) + f" ELSE '{other}' END"


register(
    "traffic_class_district",
    "o_orderkey:i class:s",
    lambda t: t.raw("orders").select("o_orderkey", classes.traffic_class_district(F.floor(F.col("o_totalprice") * 20)).alias("class")),
    f"""SELECT o_orderkey, {chain('floor(o_totalprice * 20)', classes.DISTRICT_TRAFFIC, 'very low', '>')} AS class FROM orders""",
)
register(
    "traffic_class_station",
    "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i class:s map_class:s",
    lambda t: t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        classes.traffic_class_station(F.floor("l_extendedprice")).alias("class"),
        classes.traffic_class_map(F.floor(F.col("l_extendedprice") * 5)).alias("map_class"),
    ),
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {chain('floor(l_extendedprice)', classes.STATION_TRAFFIC, 'very low', '>')} AS class,
       {chain('floor(l_extendedprice * 5)', classes.MAP_TRAFFIC, 'low', '>')} AS map_class FROM lineitem""",
)
register(
    "efficiency_grade",
    "station_id:s grade:s",
    lambda t: stations(t).select("station_id", classes.efficiency_grade(F.col("total_traffic") / 100).alias("grade")),
    f"SELECT station_id, {chain('total_traffic / 100', classes.EFFICIENCY, 'F', '>=')} AS grade FROM smonth",
)
register(
    "demand_level",
    "o_orderkey:i level:s",
    lambda t: t.raw("orders").select("o_orderkey", classes.demand_level(F.floor(F.col("o_totalprice") * 5)).alias("level")),
    f"SELECT o_orderkey, {chain('floor(o_totalprice * 5)', classes.DEMAND, 'low', '>=')} AS level FROM orders",
)
register(
    "delay_level",
    "route_id:s from_node_id:s mean_trip:f4 level:s",
    lambda t: t.speeds.groupBy("route_id", "from_node_id").agg(F.avg("trip_time").alias("mean_trip")).withColumn("level", classes.delay_level(F.col("mean_trip"), 40.0)),
    f"""SELECT *, {chain('(mean_trip / 40.0)', classes.DELAY, 'smooth', '>=')} AS level FROM
       (SELECT route_id, from_node_id, avg(trip_time) AS mean_trip FROM speeds GROUP BY ALL)""",
)
register(
    "delay_index",
    "route_id:s hour:i delay_index:f4",
    lambda t: t.speeds.groupBy("route_id", "hour").agg(classes.delay_index(F.avg("trip_time")).alias("delay_index")),
    "SELECT route_id, hour, least(avg(trip_time) / 90 * 100, 200) AS delay_index FROM speeds GROUP BY ALL",
)
