"""Origin–destination tables and questions (survey section 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import classes, geo
from headway.operators import od, od_queries as oq
from headway.plans.registry import define, register, rounded_even
from headway.plans.stored import stored
from headway.plans.traffic import chain
from headway.sources.mapping import MONTH

H = [f"h{h:02d}" for h in range(24)]


def stop_routes(t):
    return od.collect_routes_per_stop(t.route_stops, t.routes)


def daily(t):
    return od.daily_od_build(t.od_wide, t.od_stops, stop_routes(t))


def generated(t):
    return od.daily_od_generated(daily(t))


def summary(t, month=None):
    """OD summary; that of one month comes from the stored view."""
    if month is not None:
        return stored(t, "monthly_od_summary", month)
    return t.built("od summary", lambda: od.monthly_od_summary(generated(t), t.stops))


KM = """CASE WHEN a.latitude = 0 OR a.longitude = 0 OR b.latitude = 0 OR b.longitude = 0 THEN 0 ELSE
 round(2 * 6371 * asin(sqrt(least(1, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude))
 * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))), 2) END"""
define(
    "stoproutes",
    """SELECT DISTINCT stop_id, route_stops.route_id, node_sequence, dispatch_interval FROM route_stops
       JOIN routes ON route_stops.route_id = routes.route_id WHERE is_active""",
)
define(
    "pairs",
    f"""SELECT a.station_id AS f, b.station_id AS t, {KM} AS km, coalesce(c.n, 0) AS n_common, c.avg_i, c.max_i, c.min_i,
       c.harm, coalesce(c.unknown, 0) AS c_unknown, fa.n AS nf, fb.n AS nt, fa.mean_i AS fm, fb.mean_i AS tm,
       coalesce(fa.unknown, 0) + coalesce(fb.unknown, 0) AS ft_unknown,
       coalesce(fa.n, 0) - coalesce(c.n, 0) AS n_from_only, coalesce(fb.n, 0) - coalesce(d.n, 0) AS n_to_only
       FROM od_stops AS a CROSS JOIN od_stops AS b
       LEFT JOIN (SELECT x.stop_id AS f, y.stop_id AS t, count(*) AS n, avg(dispatch_interval) AS avg_i,
            max(dispatch_interval) AS max_i, min(dispatch_interval) AS min_i,
            count(*) / sum(1 / greatest(dispatch_interval, 1)) AS harm,
            count(*) - count(dispatch_interval) AS unknown
            FROM stoproutes AS x JOIN (SELECT DISTINCT stop_id, route_id FROM stoproutes) AS y ON x.route_id = y.route_id
            GROUP BY ALL) AS c ON c.f = a.station_id AND c.t = b.station_id
       LEFT JOIN (SELECT y.stop_id AS f, x.stop_id AS t, count(*) AS n
            FROM stoproutes AS x JOIN (SELECT DISTINCT stop_id, route_id FROM stoproutes) AS y ON x.route_id = y.route_id
            GROUP BY ALL) AS d ON d.f = a.station_id AND d.t = b.station_id
       LEFT JOIN (SELECT stop_id, count(*) AS n, avg(dispatch_interval) AS mean_i, count(*) - count(dispatch_interval) AS unknown FROM stoproutes GROUP BY 1) AS fa ON fa.stop_id = a.station_id
       LEFT JOIN (SELECT stop_id, count(*) AS n, avg(dispatch_interval) AS mean_i, count(*) - count(dispatch_interval) AS unknown FROM stoproutes GROUP BY 1) AS fb ON fb.stop_id = b.station_id
       WHERE a.is_active AND b.is_active""",
)
define(
    "odday",
    f"""SELECT o.*, {' + '.join(H)} AS total_passengers, dayofweek(record_date) AS day_of_week,
       dayofweek(record_date) IN (0, 6) AS is_weekend, (day(record_date) + 6) // 7 AS week_of_month,
       h07 + h08 + h09 AS mp, h17 + h18 + h19 AS ep, h22 + h23 + h00 + h01 + h02 + h03 + h04 + h05 AS np,
       h10 + h11 + h12 + h13 + h14 + h15 + h16 AS dp, km, n_common, n_from_only, n_to_only, n_common = 0 AS transfer
       FROM od_wide AS o JOIN pairs ON from_station_id = f AND to_station_id = t WHERE {' + '.join(H)} > 0""",
)
conc = lambda c: f"round({c} / total_passengers + 1e-10, 4)"
define(
    "odmonth",
    f"""SELECT *, daily_stddev_passengers / daily_avg_passengers AS cv_coefficient,
       weekend_total_passengers / nullif(weekday_total_passengers, 0) AS weekend_weekday_ratio,
       CASE WHEN transfer AND daily_avg_passengers >= 100 THEN 10 ELSE 0 END AS p1_score,
       CASE WHEN transfer AND daily_avg_passengers >= 20 AND daily_avg_passengers <= 99 THEN 5 ELSE 0 END AS p2_score,
       CASE WHEN min_direct_connections <= 2 AND NOT transfer AND daily_avg_passengers >= 100 THEN 3 ELSE 0 END AS p3_score,
       CASE WHEN daily_avg_passengers < 50 AND avg_distance_km >= 5 THEN 1 ELSE 0 END AS p4_score,
       p1_score + p2_score + p3_score + p4_score AS drt_priority_score,
       drt_priority_score + CASE WHEN avg_dispatch_interval > 30 THEN 2 WHEN avg_dispatch_interval > 20 THEN 1 ELSE 0 END AS adjusted_drt_priority_score,
       CASE WHEN transfer AND daily_avg_passengers >= 100 THEN 'DRT 최우선고려구간' WHEN transfer AND daily_avg_passengers >= 20 THEN 'DRT 우선고려구간'
            WHEN min_direct_connections <= 2 AND daily_avg_passengers >= 100 THEN 'DRT 고려구간'
            WHEN daily_avg_passengers < 50 AND avg_distance_km >= 5 THEN 'DRT 검토 가능' ELSE '기존 서비스' END AS drt_recommendation,
       CASE WHEN appearance_days = 17 THEN '매일' WHEN appearance_days >= 13 THEN '거의매일 (13-16일)'
            WHEN appearance_days >= 9 THEN '고빈도 (9-12일)' WHEN appearance_days >= 5 THEN '중빈도 (5-8일)' ELSE '저빈도 (<5일)' END AS frequency_category
       FROM (SELECT date_trunc('month', record_date)::DATE AS analysis_month, from_station_id, to_station_id,
         any_value(a.station_name) AS from_station_name, any_value(b.station_name) AS to_station_name,
         any_value(a.longitude) AS from_coordinates_x, any_value(a.latitude) AS from_coordinates_y,
         any_value(b.longitude) AS to_coordinates_x, any_value(b.latitude) AS to_coordinates_y,
         any_value(a.district) AS from_district_name, any_value(b.district) AS to_district_name,
         any_value(a.admin_dong) AS from_admin_dong, any_value(b.admin_dong) AS to_admin_dong,
         any_value(x.node_num) AS from_station_num, any_value(y.node_num) AS to_station_num,
         count(*) AS appearance_days, count(*) FILTER (NOT is_weekend) AS weekday_appearances,
         count(*) FILTER (is_weekend) AS weekend_appearances, sum(total_passengers) AS monthly_total_passengers,
         avg(total_passengers) AS daily_avg_passengers, max(total_passengers) AS daily_max_passengers,
         min(total_passengers) AS daily_min_passengers, stddev_samp(total_passengers) AS daily_stddev_passengers,
         {', '.join(f'sum({h}) AS monthly_{h}' for h in H)}, sum(mp) AS monthly_morning_peak, sum(ep) AS monthly_evening_peak,
         sum(np) AS monthly_night, sum(dp) AS monthly_daytime, sum(total_passengers) FILTER (NOT is_weekend) AS weekday_total_passengers,
         sum(total_passengers) FILTER (is_weekend) AS weekend_total_passengers,
         avg(total_passengers) FILTER (NOT is_weekend) AS weekday_avg_passengers,
         avg(total_passengers) FILTER (is_weekend) AS weekend_avg_passengers,
         avg({conc('mp')}) AS avg_morning_concentration, avg({conc('ep')}) AS avg_evening_concentration,
         avg({conc('np')}) AS avg_night_concentration, avg({conc('dp')}) AS avg_daytime_concentration,
         max(o.km) AS avg_distance_km, max(o.n_common) AS min_direct_connections, bool_or(o.transfer) AS transfer,
         any_value(p.avg_i) AS avg_dispatch_interval, any_value(p.max_i) AS max_dispatch_interval, any_value(p.min_i) AS min_dispatch_interval
         FROM odday AS o JOIN od_stops AS a ON from_station_id = a.station_id JOIN od_stops AS b ON to_station_id = b.station_id
         JOIN pairs AS p ON p.f = from_station_id AND p.t = to_station_id
         LEFT JOIN stops AS x ON from_station_id = x.node_id LEFT JOIN stops AS y ON to_station_id = y.node_id GROUP BY ALL)""",
)
register(
    "collect_routes_per_stop",
    "station_id:s n_routes:i route_list:s",
    lambda t: stop_routes(t).select(
        "station_id", F.size("routes").alias("n_routes"),
        F.array_join(F.transform("routes", lambda r: F.concat_ws("/", r["route_id"], r["stop_sequence"].cast("string"))), ",").alias("route_list"),
    ),
    """SELECT stop_id AS station_id, count(*) AS n_routes,
       string_agg(route_id || '/' || node_sequence, ',' ORDER BY route_id, node_sequence) AS route_list FROM stoproutes GROUP BY 1""",
)
register(
    "od_enrich",
    "record_date:s from_station_id:s to_station_id:s from_station_name:s to_district_name:s cnt:i from_n:i to_n:i",
    lambda t: od.od_enrich(t.od_wide, t.od_stops, stop_routes(t)).withColumns({"from_n": F.size("from_routes"), "to_n": F.size("to_routes")}),
    """SELECT record_date, from_station_id, to_station_id, a.station_name AS from_station_name, b.district AS to_district_name,
       cnt, coalesce(nf, 0) AS from_n, coalesce(nt, 0) AS to_n FROM od_wide
       JOIN pairs ON from_station_id = f AND to_station_id = t JOIN od_stops AS a ON f = a.station_id
       JOIN od_stops AS b ON t = b.station_id""",
)
register(
    "array_set_ops",
    "from_station_id:s to_station_id:s n_common:i n_from_only:i n_to_only:i",
    lambda t: od.route_overlap(od.od_enrich(t.od_wide.select("from_station_id", "to_station_id").distinct(), t.od_stops, stop_routes(t))).select(
        "from_station_id", "to_station_id", *[F.size(f"{k}_routes").alias(f"n_{k}") for k in ("common", "from_only", "to_only")]
    ),
    """SELECT DISTINCT from_station_id, to_station_id, n_common, n_from_only, n_to_only FROM od_wide
       JOIN pairs ON from_station_id = f AND to_station_id = t""",
)
DAY = "record_date:s from_station_id:s to_station_id:s "
register(
    "daily_od_build",
    "analysis_date:s from_station_id:s to_station_id:s from_station_name:s to_admin_dong:s estimated_distance_km:f2 "
    "direct_connection_count:i transfer_required:b h08:i h18:i n_from_only:i n_to_only:i",
    lambda t: daily(t).withColumns({"n_from_only": F.size("from_only_routes"), "n_to_only": F.size("to_only_routes")}),
    """SELECT record_date AS analysis_date, from_station_id, to_station_id, a.station_name AS from_station_name,
       b.admin_dong AS to_admin_dong, km AS estimated_distance_km, n_common AS direct_connection_count,
       transfer AS transfer_required, h08, h18, n_from_only, n_to_only
       FROM odday JOIN od_stops AS a ON from_station_id = a.station_id JOIN od_stops AS b ON to_station_id = b.station_id""",
)
GEN = (
    "analysis_date:s from_station_id:s to_station_id:s total_passengers:i day_of_week:i is_weekend:b week_of_month:i "
    "morning_peak_passengers:i evening_peak_passengers:i night_passengers:i daytime_passengers:i morning_concentration:f4 "
    "evening_concentration:f4 night_concentration:f4 daytime_concentration:f4"
)
GEN_SQL = """SELECT *, record_date AS analysis_date, mp AS morning_peak_passengers, ep AS evening_peak_passengers,
       np AS night_passengers, dp AS daytime_passengers, mp / total_passengers AS morning_concentration,
       ep / total_passengers AS evening_concentration, np / total_passengers AS night_concentration,
       dp / total_passengers AS daytime_concentration FROM odday"""
register("daily_od_generated", GEN, generated, GEN_SQL)
register(
    "hour_band_sums",
    "analysis_date:s from_station_id:s to_station_id:s morning:i evening:i night:i daytime:i night_share:f4",
    lambda t: od.daily_od_generated(t.od_wide.withColumnRenamed("record_date", "analysis_date")).select(
        "analysis_date", "from_station_id", "to_station_id", F.col("morning_peak_passengers").alias("morning"),
        F.col("evening_peak_passengers").alias("evening"), F.col("night_passengers").alias("night"),
        F.col("daytime_passengers").alias("daytime"), F.col("night_concentration").alias("night_share"),
    ),
    f"""SELECT record_date AS analysis_date, from_station_id, to_station_id, h07 + h08 + h09 AS morning, h17 + h18 + h19 AS evening,
       h22 + h23 + h00 + h01 + h02 + h03 + h04 + h05 AS night, h10 + h11 + h12 + h13 + h14 + h15 + h16 AS daytime,
       CASE WHEN cnt > 0 THEN (h22 + h23 + h00 + h01 + h02 + h03 + h04 + h05) / cnt ELSE 0 END AS night_share FROM od_wide""",
)
AGG = (
    "analysis_month:s from_station_id:s to_station_id:s from_station_name:s to_station_name:s from_district_name:s to_district_name:s "
    "from_admin_dong:s appearance_days:i weekday_appearances:i weekend_appearances:i monthly_total_passengers:i daily_avg_passengers:f4 "
    "daily_max_passengers:i daily_min_passengers:i daily_stddev_passengers:f4 monthly_h00:i monthly_h08:i monthly_h18:i monthly_h23:i "
    "monthly_morning_peak:i monthly_evening_peak:i monthly_night:i monthly_daytime:i weekday_total_passengers:i "
    "weekend_total_passengers:i weekday_avg_passengers:f4 weekend_avg_passengers:f4 avg_morning_concentration:f4 "
    "avg_evening_concentration:f4 avg_night_concentration:f4 avg_daytime_concentration:f4 avg_distance_km:f2 "
    "min_direct_connections:i ever_transfer_required:b"
)
register(
    "monthly_od_aggregation",
    AGG,
    lambda t: od.monthly_od_aggregation(generated(t)),
    "SELECT *, transfer AS ever_transfer_required FROM odmonth",
)
register(
    "monthly_od_summary",
    AGG + " from_station_num:s to_station_num:s frequency_category:s cv_coefficient:f4 weekend_weekday_ratio:f4 "
    "avg_dispatch_interval:f4 max_dispatch_interval:i min_dispatch_interval:i p1_score:i p2_score:i p3_score:i p4_score:i "
    "drt_priority_score:i adjusted_drt_priority_score:i drt_recommendation:s",
    summary,
    "SELECT *, transfer AS ever_transfer_required FROM odmonth",
)
PAIR = "from_station_id:s to_station_id:s "
for key, cols in {
    "od_frequency_class": "appearance_days:i frequency_category:s",
    "od_cv": "daily_avg_passengers:f4 cv_coefficient:f4",
    "od_weekend_ratio": "weekend_weekday_ratio:f4",
    "od_dispatch_stats": "avg_dispatch_interval:f4 max_dispatch_interval:i min_dispatch_interval:i",
    "od_priority_scores": "p1_score:i p2_score:i p3_score:i p4_score:i drt_priority_score:i adjusted_drt_priority_score:i",
    "od_recommendation": "drt_recommendation:s",
    "scalar_subquery_lookup": "from_station_num:s to_station_num:s",
}.items():
    register(key, PAIR + cols, summary, "SELECT * FROM odmonth")
register(
    "json_array_extract",
    "from_station_id:s interval:i",
    lambda t: stop_routes(t).select(F.col("station_id").alias("from_station_id"), F.explode("routes").alias("r")).select(
        "from_station_id", F.get_json_object(F.to_json("r"), "$.dispatch_interval").cast("int").alias("interval")
    ).filter("interval IS NOT NULL"),
    "SELECT stop_id AS from_station_id, dispatch_interval AS interval FROM stoproutes WHERE dispatch_interval IS NOT NULL",
)
register(
    "od_p1_transfers",
    PAIR + "from_district_name:s to_district_name:s avg_distance_km:f2 daily_avg_passengers:f4 priority_category:s priority_score:i",
    lambda t: oq.p1_transfers(summary(t, MONTH), MONTH),
    """SELECT *, p1_score + p2_score AS priority_score, CASE WHEN p1_score > 0 THEN 'P1_고수요_환승구간' ELSE 'P1_저수요_환승구간' END AS priority_category
       FROM odmonth WHERE p1_score + p2_score > 0
       ORDER BY p1_score + p2_score DESC, daily_avg_passengers DESC, from_station_id, to_station_id LIMIT 50""",
)
register(
    "od_p2_high_demand",
    PAIR + "daily_avg_passengers:f4 avg_dispatch_interval:f4 priority_category:s",
    lambda t: oq.p2_high_demand(summary(t, MONTH), MONTH),
    """SELECT *, 'P2_직행노선부족' AS priority_category FROM odmonth WHERE p3_score > 0
       ORDER BY p3_score DESC, from_station_id, to_station_id LIMIT 50""",
)
register(
    "od_p3_low_efficiency",
    PAIR + "daily_avg_passengers:f4 demand_per_km:f4 service_recommendation:s",
    lambda t: oq.p3_low_efficiency(summary(t, MONTH), MONTH),
    """SELECT *, daily_avg_passengers / avg_distance_km AS demand_per_km,
       CASE WHEN daily_avg_passengers / avg_distance_km < 10 THEN 'DRT 전환 권장' ELSE '현행 유지' END AS service_recommendation
       FROM odmonth WHERE p4_score > 0 ORDER BY p4_score DESC, from_station_id, to_station_id LIMIT 50""",
)
define(
    "origins",
    """SELECT *, CASE WHEN destination_count >= 20 THEN '높음' WHEN destination_count >= 10 THEN '보통' ELSE '낮음' END AS drt_potential,
       CASE WHEN time_period_demand / total > 0.4 THEN '시간대 집중 운영' WHEN time_period_demand / total > 0.2 THEN '기존 노선 보완'
            ELSE '수요 모니터링 필요' END AS service_recommendation
       FROM (SELECT from_station_id, from_station_name, from_district_name, sum(monthly_morning_peak) AS time_period_demand,
             sum(monthly_total_passengers) AS total, count(*) AS destination_count, avg(avg_distance_km) AS avg_distance_km
             FROM odmonth WHERE from_station_id <> to_station_id AND monthly_morning_peak > 0 GROUP BY ALL)
       ORDER BY time_period_demand DESC, from_station_id LIMIT 20""",
)


def origins(t):
    return oq.time_origins(summary(t, MONTH), MONTH, "morning_peak")


def destinations(t):
    s = summary(t, MONTH)
    return oq.time_destinations(s, MONTH, "morning_peak", oq.time_origins(s, MONTH, "morning_peak"))


register(
    "od_time_origins",
    "from_station_id:s from_station_name:s from_district_name:s time_period_demand:i destination_count:i avg_distance_km:f2 "
    "drt_potential:s service_recommendation:s",
    origins,
    "SELECT * FROM origins",
)
define(
    "dests",
    """SELECT * FROM (SELECT from_station_id, to_station_id, to_district_name, monthly_morning_peak AS demand,
       row_number() OVER (PARTITION BY from_station_id ORDER BY monthly_morning_peak DESC, to_station_id) AS rank
       FROM odmonth WHERE from_station_id <> to_station_id AND monthly_morning_peak > 0
       AND from_station_id IN (SELECT from_station_id FROM origins)) WHERE rank <= 20""",
)
register("od_time_destinations", PAIR + "to_district_name:s demand:i rank:i", destinations, "SELECT * FROM dests")
register(
    "row_number_global",
    "to_station_id:s demand:i rank:i",
    lambda t: oq.time_destinations(summary(t, MONTH), MONTH, "morning_peak", t.od_stops.filter("station_id = '3'").select(F.col("station_id").alias("from_station_id"))),
    """SELECT to_station_id, monthly_morning_peak AS demand, row_number() OVER (ORDER BY monthly_morning_peak DESC, to_station_id) AS rank
       FROM odmonth WHERE from_station_id = '3' AND to_station_id <> '3' AND monthly_morning_peak > 0 ORDER BY rank LIMIT 20""",
)
register(
    "od_destination_spread",
    "from_station_id:s districts:i destination_spread:s",
    lambda t: oq.destination_spread(destinations(t)),
    """SELECT from_station_id, k AS districts, CASE WHEN k <= 3 THEN '집중형' WHEN k <= 7 THEN '분산형' ELSE '광역형' END AS destination_spread
       FROM (SELECT from_station_id, count(DISTINCT to_district_name) AS k FROM dests GROUP BY 1)""",
)
register(
    "od_time_summary",
    "total_origins:i total_demand:i avg_destinations:f1",
    lambda t: oq.time_summary(origins(t)),
    f"""SELECT count(*) AS total_origins, sum(time_period_demand) AS total_demand,
       {rounded_even('avg(destination_count)', 1)} AS avg_destinations FROM origins""",
)
define(
    "quality",
    """SELECT *, CASE WHEN broken THEN 50 ELSE greatest(0, 100 - wait * 1.5) * 0.6::DOUBLE + least(100, diversity * 15) * 0.2::DOUBLE
         + CASE WHEN penalty = 0 THEN 100 ELSE 30 END * 0.2::DOUBLE END AS score
       FROM (SELECT m.*, CASE WHEN min_direct_connections > 0 THEN c_unknown > 0 ELSE ft_unknown > 0 END AS broken,
         CASE WHEN broken THEN 30 WHEN min_direct_connections > 0 THEN harm ELSE coalesce(fm, 30) + coalesce(tm, 30) + 10 END AS wait,
         CASE WHEN broken THEN 1 WHEN min_direct_connections > 0 THEN n_common ELSE 0 END AS diversity,
         CASE WHEN broken OR min_direct_connections > 0 THEN 0.0 ELSE 1.0 END AS penalty
         FROM odmonth AS m JOIN pairs ON from_station_id = f AND to_station_id = t)""",
)
register(
    "od_service_quality",
    PAIR + "service_quality_score:f4 avg_dispatch_interval_min:f4 route_diversity_index:f1 transfer_penalty:f1",
    lambda t: oq.service_quality(summary(t)),
    """SELECT *, score AS service_quality_score, wait AS avg_dispatch_interval_min, diversity AS route_diversity_index,
       penalty AS transfer_penalty FROM quality""",
)
register(
    "harmonic_mean_array",
    PAIR + "harmonic:f4",
    lambda t: summary(t).filter("min_direct_connections > 0").withColumn("i", F.transform("common_routes", lambda r: r["dispatch_interval"]))
    .filter(F.forall("i", lambda x: x.isNotNull())).withColumn("harmonic", oq.harmonic_mean(F.col("i"))),
    "SELECT from_station_id, to_station_id, harm AS harmonic FROM odmonth JOIN pairs ON from_station_id = f AND to_station_id = t WHERE n_common > 0 AND c_unknown = 0",
)
MIS = """SELECT *, round(ratio0 + 1e-9, 2) AS demand_service_ratio FROM (
         SELECT *, daily_avg_passengers / greatest(score, 1) AS ratio0 FROM (SELECT * FROM quality WHERE daily_avg_passengers >= 10)) WHERE ratio0 >= 1
       ORDER BY round(ratio0 + 1e-9, 2) DESC, daily_avg_passengers DESC, from_station_id, to_station_id LIMIT 20"""
define("mism", MIS)
register(
    "od_mismatch",
    PAIR + "daily_avg_passengers:f1 service_quality_score:f1 avg_dispatch_interval_min:f1 route_diversity_index:f1 transfer_penalty:f1 demand_service_ratio:f2",
    lambda t: oq.mismatch(summary(t, MONTH), MONTH),
    """SELECT *, score AS service_quality_score, wait AS avg_dispatch_interval_min, diversity AS route_diversity_index,
       penalty AS transfer_penalty FROM mism""",
)
register(
    "od_summary_stats",
    "total_od_pairs:i drt_applicable_pairs:i monthly_transfer_demand:i",
    lambda t: oq.summary_stats(summary(t, MONTH), MONTH),
    """SELECT count(*) AS total_od_pairs, count(*) FILTER (drt_priority_score > 0) AS drt_applicable_pairs,
       coalesce(sum(monthly_total_passengers) FILTER (transfer), 0) AS monthly_transfer_demand FROM odmonth""",
)
register(
    "od_priority_distribution",
    "p1_count:i p2_count:i p3_count:i p4_count:i",
    lambda t: oq.priority_distribution(summary(t, MONTH), MONTH),
    "SELECT " + ", ".join(f"count(*) FILTER (p{i}_score > 0) AS p{i}_count" for i in (1, 2, 3, 4)) + " FROM odmonth",
)
define(
    "pairhour",
    f"""SELECT *, unnest(range(24)) AS hour, unnest(hs) AS v0, list_position(hs, list_max(hs)) - 1 AS peak_hour, list_max(hs) AS pk,
       monthly_morning_peak * 100 / greatest(monthly_total_passengers, 1) AS am, monthly_evening_peak * 100 / greatest(monthly_total_passengers, 1) AS pm,
       monthly_daytime * 100 / greatest(monthly_total_passengers, 1) AS noon, monthly_night * 100 / greatest(monthly_total_passengers, 1) AS nt
       FROM (SELECT *, [{', '.join(f'monthly_{h}' for h in H)}] AS hs FROM odmonth)""",
)
register(
    "od_pair_hourly",
    PAIR + "hour:i passengers:f1 peak_hour:i peak_passengers:f1 morning_peak_pct:f1 evening_peak_pct:f1 daytime_pct:f1 night_pct:f1 pattern_type:s",
    lambda t: oq.pair_hourly(summary(t, MONTH), MONTH),
    f"""SELECT from_station_id, to_station_id, hour, {rounded_even('CAST(v0 AS DOUBLE) / appearance_days', 1)} AS passengers, peak_hour,
       {rounded_even('CAST(pk AS DOUBLE) / appearance_days', 1)} AS peak_passengers, {rounded_even('am', 1)} AS morning_peak_pct,
       {rounded_even('pm', 1)} AS evening_peak_pct, {rounded_even('noon', 1)} AS daytime_pct, {rounded_even('nt', 1)} AS night_pct,
       CASE WHEN am > pm AND am > 20 THEN '출근시간 집중형' WHEN pm > am AND pm > 20 THEN '퇴근시간 집중형'
            WHEN noon > 50 THEN '주간 분산형' ELSE '균등 분산형' END AS pattern_type FROM pairhour""",
)
register(
    "hour_pivot_columns",
    "record_date:s from_station_id:s to_station_id:s hour:i passengers:i",
    lambda t: oq.hour_series(t.od_wide, "record_date", "from_station_id", "to_station_id"),
    f"""SELECT record_date, from_station_id, to_station_id, unnest(range(24)) AS hour, unnest([{', '.join(H)}]) AS passengers FROM od_wide""",
)


def edges(t):
    s = summary(t, MONTH)
    dest = oq.time_destinations(s, MONTH, "morning_peak", oq.time_origins(s, MONTH, "morning_peak"))
    return oq.flow_edges(dest, oq.mismatch(s, MONTH), minimum=50, min_ratio=1.5)


register(
    "od_flow_edges",
    "analysis_type:s from_station_id:s to_station_id:s demand:f4 demand_class:s",
    edges,
    f"""SELECT *, {chain('demand', classes.OD_DEMAND, 'minimal', '>=')} AS demand_class FROM (
       SELECT 'time_based' AS analysis_type, from_station_id, to_station_id, CAST(demand AS DOUBLE) AS demand FROM dests WHERE demand >= 50
       UNION ALL SELECT 'mismatch', from_station_id, to_station_id, daily_avg_passengers FROM mism WHERE demand_service_ratio >= 1.5)""",
)
register(
    "dong_od",
    "start_district:s end_district:s total_passenger_count:i",
    lambda t: oq.dong_totals(t.dong_od),
    "SELECT start_district, end_district, sum(total_passenger_count) AS total_passenger_count FROM dong_od GROUP BY ALL",
)
register(
    "haversine_km",
    "from_id:s to_id:s km:f2",
    lambda t: t.od_wide.select("from_station_id", "to_station_id").distinct()
    .join(t.od_stops.select(F.col("station_id").alias("from_station_id"), F.col("longitude").alias("x1"), F.col("latitude").alias("y1")), "from_station_id")
    .join(t.od_stops.select(F.col("station_id").alias("to_station_id"), F.col("longitude").alias("x2"), F.col("latitude").alias("y2")), "to_station_id")
    .select(F.col("from_station_id").alias("from_id"), F.col("to_station_id").alias("to_id"), geo.haversine_km(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")).alias("km")),
    f"""SELECT DISTINCT from_station_id AS from_id, to_station_id AS to_id, {KM} AS km FROM od_wide
       JOIN od_stops AS a ON from_station_id = a.station_id JOIN od_stops AS b ON to_station_id = b.station_id""",
)
