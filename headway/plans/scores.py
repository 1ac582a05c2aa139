"""Score models, their queries and daily features (survey section 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import classes
from headway.operators import daily_features as daily
from headway.operators import score_queries as sq
from headway.operators import scores
from headway.plans.registry import define, register
from headway.plans.stored import ensure, stored
from headway.plans.traffic import chain
from headway.plans.views import shp
from headway.sources.mapping import MONTH

M = "month_date = DATE '2024-01-01'"
S = "record_date >= DATE '2024-01-01' AND record_date < DATE '2024-02-01'"
BAND = "CASE WHEN hour IN (9,10,11) THEN 'medical' WHEN hour IN (14,15,16) THEN 'welfare' WHEN hour IN (18,19,20) THEN 'evening' ELSE 'normal' END"


def dispatch(name, day):
    where = f" AND day_type = '{day}'" if day else ""
    define(name, f"SELECT node_id AS station_id, hour, avg(dispatch_count) AS d FROM sph WHERE {M}{where} GROUP BY ALL")


dispatch("disp_wd", "weekday")
dispatch("disp_we", "weekend")
dispatch("disp_all", None)
for tag, day in (("wd", "weekday"), ("we", "weekend")):
    define(
        f"perday_{tag}",
        f"SELECT station_id, hour, district_name, (total_ride + total_alight) // greatest(operating_days, 1) AS a FROM shp WHERE {M} AND day_type = '{day}'",
    )
define("c_tc", "SELECT *, max(d) OVER (PARTITION BY station_id) AS mx, d / max(d) OVER (PARTITION BY station_id) AS tc FROM disp_wd")
define(
    "c_pdr",
    """SELECT *, max(a) OVER (PARTITION BY station_id) AS mt, CASE WHEN max(a) OVER (PARTITION BY station_id) > 0
       THEN a / max(a) OVER (PARTITION BY station_id) ELSE 0 END AS pdr FROM perday_wd""",
)
define(
    "touch",
    f"""SELECT node_id, record_date, hour, passenger_count FROM (
         SELECT from_node_id AS node_id, record_date, hour, passenger_count FROM sections
         UNION ALL SELECT to_node_id, record_date, hour, passenger_count FROM sections WHERE from_node_id <> to_node_id)
       WHERE {S}""",
)
define(
    "c_ru",
    f"""SELECT sm.node_id AS station_id, coalesce(s, 0) AS section_passenger_sum,
       CASE WHEN s IS NOT NULL AND shi > slo THEN (s - slo) / (shi - slo)
            WHEN s IS NULL AND r IS NOT NULL AND rhi > rlo THEN (r - rlo) / (rhi - rlo) ELSE 0 END AS ru
       FROM sm LEFT JOIN (SELECT node_id, CAST(sum(passenger_count) AS DOUBLE) AS s FROM touch GROUP BY 1) AS x ON sm.node_id = x.node_id
       LEFT JOIN (SELECT station_id, CAST(sum(total_traffic) AS DOUBLE) AS r FROM shp WHERE day_type = 'weekday' AND {M} GROUP BY 1) AS y ON sm.node_id = y.station_id
       CROSS JOIN (SELECT min(s) AS slo, max(s) AS shi FROM (SELECT sum(passenger_count) AS s FROM touch JOIN sm ON touch.node_id = sm.node_id GROUP BY sm.node_id) WHERE s > 0)
       CROSS JOIN (SELECT min(r) AS rlo, max(r) AS rhi FROM (SELECT sum(total_traffic) AS r FROM shp WHERE day_type = 'weekday' AND {M} GROUP BY station_id) WHERE r > 0)""",
)


def grid(where):
    return f"(SELECT station_id, unnest(range(24)) AS hour FROM (SELECT DISTINCT station_id FROM shp WHERE {M} {where}))"


define(
    "commuter",
    f"""SELECT g.station_id, coalesce(district_name, '기타') AS district_name, DATE '2024-01-01' AS analysis_month,
       g.hour AS hour_of_day, coalesce(tc, 0) AS tc_score, coalesce(pdr, 0) AS pdr_score, coalesce(ru, 0) AS ru_score,
       coalesce(d, 0) AS avg_dispatch_count, coalesce(mx, 0) AS max_daily_dispatch, coalesce(a, 0) AS avg_traffic_count,
       coalesce(mt, 0) AS max_daily_traffic, coalesce(section_passenger_sum, 0) AS section_passenger_sum,
       round((coalesce(tc, 0) * 0.4::DOUBLE + coalesce(pdr, 0) * 0.4::DOUBLE + coalesce(ru, 0) * 0.2::DOUBLE) * 100 + 1e-10, 4) AS total_drt_score
       FROM {grid("AND day_type = 'weekday'")} AS g LEFT JOIN c_tc AS t ON g.station_id = t.station_id AND g.hour = t.hour
       LEFT JOIN c_pdr AS p ON g.station_id = p.station_id AND g.hour = p.hour
       LEFT JOIN c_ru AS r ON g.station_id = r.station_id""",
)
register(
    "commuter_tc",
    "station_id:s hour_of_day:i avg_dispatch_count:f4 max_daily_dispatch:f4 tc_score:f6",
    lambda t: scores.commuter_tc(t.sph, MONTH),
    "SELECT station_id, hour AS hour_of_day, d AS avg_dispatch_count, mx AS max_daily_dispatch, tc AS tc_score FROM c_tc",
)
register(
    "commuter_pdr",
    "station_id:s hour_of_day:i avg_traffic_count:i max_daily_traffic:i pdr_score:f6",
    lambda t: scores.commuter_pdr(shp(t, MONTH), MONTH),
    "SELECT station_id, hour AS hour_of_day, a AS avg_traffic_count, mt AS max_daily_traffic, pdr AS pdr_score FROM c_pdr",
)
register(
    "commuter_ru",
    "station_id:s section_passenger_sum:i ru_score:f6",
    lambda t: scores.commuter_ru(t.sections, shp(t, MONTH), t.sm, MONTH),
    "SELECT station_id, section_passenger_sum, ru AS ru_score FROM c_ru",
)
BASE = "station_id:s district_name:s analysis_month:s hour_of_day:i "


def commuter(t):
    return stored(t, "commuter_scores")


def tourism(t):
    return stored(t, "tourism_scores")


def vulnerable(t):
    return stored(t, "vulnerable_scores")


def models(t):
    ensure(t, ("commuter_scores", "tourism_scores", "vulnerable_scores"))
    return {"commuter": commuter(t), "tourism": tourism(t), "vulnerable": vulnerable(t)}


register(
    "commuter_scores",
    BASE + "tc_score:f6 pdr_score:f6 ru_score:f6 avg_dispatch_count:f2 max_daily_dispatch:f2 avg_traffic_count:f2 "
    "max_daily_traffic:f2 section_passenger_sum:f2 total_drt_score:f4",
    commuter,
    "SELECT * FROM commuter",
)
TOUR = "hour BETWEEN 10 AND 16"
define(
    "t_tc",
    f"""SELECT *, CASE WHEN {TOUR} THEN least(d / mx * 1.2::DOUBLE, 1.0) ELSE d / mx END AS tc
       FROM (SELECT *, max(d) OVER (PARTITION BY station_id) AS mx FROM disp_we)""",
)
define(
    "t_tdr",
    f"""SELECT *, CASE WHEN mt = 0 THEN 0 WHEN {TOUR} THEN least(a / mt * 1.1::DOUBLE, 1.0) ELSE a / mt END AS tdr
       FROM (SELECT *, max(a) OVER (PARTITION BY station_id) AS mt FROM perday_we)""",
)


def load_sql(dates, rides_where):
    return f"""SELECT g.node_id AS station_id, g.hour, coalesce(CAST(s AS DOUBLE), r, 0) AS x
       FROM (SELECT node_id, unnest(range(24)) AS hour FROM sm) AS g
       LEFT JOIN (SELECT node_id, hour, sum(passenger_count) AS s FROM touch {dates} GROUP BY ALL) AS a
         ON g.node_id = a.node_id AND g.hour = a.hour
       LEFT JOIN (SELECT node_id, hour, avg(ride_passenger + alight_passenger) AS r FROM sph WHERE {M} {rides_where} GROUP BY ALL) AS b
         ON g.node_id = b.node_id AND g.hour = b.hour"""


define(
    "load_we",
    load_sql(f"WHERE record_date IN (SELECT record_date FROM sph WHERE day_type = 'weekend' AND {M})", "AND day_type = 'weekend'"),
)
define("load_all", load_sql("", ""))
define("t_ru", f"SELECT *, CASE WHEN x > 0 THEN least(x / 1000 * (CASE WHEN {TOUR} THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END), 1.0) ELSE 0 END AS ru FROM load_we")
define(
    "tourism",
    f"""SELECT g.station_id, coalesce(district_name, '기타') AS district_name, DATE '2024-01-01' AS analysis_month,
       g.hour AS hour_of_day, coalesce(tc, 0) AS tc_t_score, coalesce(tdr, 0) AS tdr_t_score, coalesce(ru, 0) AS ru_t_score,
       coalesce(d, 0) AS avg_dispatch_count, coalesce(mx, 0) AS max_daily_dispatch, coalesce(a, 0) AS avg_traffic_count,
       coalesce(mt, 0) AS max_daily_traffic, coalesce(x, 0) / 1000 AS section_passenger_density,
       g.hour BETWEEN 10 AND 16 AS is_tourism_time,
       round((coalesce(tc, 0) * 0.35::DOUBLE + coalesce(tdr, 0) * 0.35::DOUBLE + coalesce(ru, 0) * 0.3::DOUBLE) * 100 + 1e-10, 4) AS total_drt_score
       FROM {grid("AND day_type = 'weekend'")} AS g LEFT JOIN t_tc AS t ON g.station_id = t.station_id AND g.hour = t.hour
       LEFT JOIN t_tdr AS p ON g.station_id = p.station_id AND g.hour = p.hour
       LEFT JOIN t_ru AS r ON g.station_id = r.station_id AND g.hour = r.hour""",
)
register(
    "tourism_tc",
    "station_id:s hour_of_day:i avg_dispatch_count:f4 max_daily_dispatch:f4 tc_t_score:f6",
    lambda t: scores.tourism_tc(t.sph, MONTH),
    "SELECT station_id, hour AS hour_of_day, d AS avg_dispatch_count, mx AS max_daily_dispatch, tc AS tc_t_score FROM t_tc",
)
register(
    "tourism_tdr",
    "station_id:s hour_of_day:i avg_traffic_count:i max_daily_traffic:i tdr_t_score:f6",
    lambda t: scores.tourism_tdr(shp(t, MONTH), MONTH),
    "SELECT station_id, hour AS hour_of_day, a AS avg_traffic_count, mt AS max_daily_traffic, tdr AS tdr_t_score FROM t_tdr",
)
register(
    "tourism_ru",
    "station_id:s hour_of_day:i raw_passengers:f4 ru_t_score:f6",
    lambda t: scores.tourism_ru(t.sections, t.sph, t.sm, MONTH),
    "SELECT station_id, hour AS hour_of_day, x AS raw_passengers, ru AS ru_t_score FROM t_ru",
)
register(
    "tourism_scores",
    BASE + "tc_t_score:f6 tdr_t_score:f6 ru_t_score:f6 avg_dispatch_count:f2 max_daily_dispatch:f2 avg_traffic_count:f2 "
    "max_daily_traffic:f2 section_passenger_density:f4 is_tourism_time:b total_drt_score:f4",
    tourism,
    "SELECT * FROM tourism",
)
define(
    "v_var",
    f"""SELECT *, CASE {BAND} WHEN 'medical' THEN least(d / vd * 1.5::DOUBLE, 1.0) WHEN 'welfare' THEN least(d / vd * 1.3::DOUBLE, 1.0)
         WHEN 'evening' THEN least(d / vd * 1.2::DOUBLE, 1.0) ELSE coalesce(d / vd, 0) END AS var
       FROM (SELECT *, sum(d) FILTER ({BAND} <> 'normal') OVER (PARTITION BY station_id) AS vd FROM disp_all)""",
)
define(
    "v_sed",
    f"""SELECT *, CASE WHEN coalesce(vt, 0) = 0 THEN 0 WHEN a < 100 AND hour IN (9, 14, 18) THEN least(a / vt * 1.4::DOUBLE * 1.2::DOUBLE, 1.0)
         WHEN a < 100 THEN least(a / vt * 1.4::DOUBLE, 1.0) WHEN hour IN (9, 14, 18) THEN least(a / vt * 1.2::DOUBLE, 1.0)
         ELSE a / vt END AS sed
       FROM (SELECT *, sum(a) FILTER ({BAND} <> 'normal') OVER (PARTITION BY station_id) AS vt FROM
         (SELECT station_id, hour, sum(total_traffic) / sum(operating_days) AS a, max(district_name) AS district_name
          FROM shp WHERE {M} GROUP BY ALL))""",
)
define(
    "v_mdi",
    f"""SELECT *, (1000 - least(x, 1000)) / 1000 * (CASE WHEN {BAND} = 'normal' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END) AS mdi FROM load_all
       WHERE station_id IN (SELECT station_id FROM shp WHERE {M})""",
)
define(
    "vulnerable",
    f"""SELECT g.station_id, coalesce(district_name, '기타') AS district_name, DATE '2024-01-01' AS analysis_month,
       g.hour AS hour_of_day, coalesce(var, 0) AS var_t_score, coalesce(sed, 0) AS sed_t_score, coalesce(mdi, 0) AS mdi_t_score,
       coalesce(d, 0) AS avg_dispatch_count, coalesce(vd, 0) AS vulnerable_total_dispatch, coalesce(a, 0) AS avg_traffic_count,
       coalesce(vt, 0) AS vulnerable_total_traffic, coalesce(x, 0) AS section_passenger_count,
       {BAND.replace('hour', 'g.hour')} <> 'normal' AS is_vulnerable_time, {BAND.replace('hour', 'g.hour')} AS vulnerable_category,
       round((coalesce(var, 0) * 0.3::DOUBLE + coalesce(sed, 0) * 0.3::DOUBLE + coalesce(mdi, 0) * 0.4::DOUBLE) * 100 + 1e-10, 4) AS total_drt_score
       FROM {grid("")} AS g LEFT JOIN v_var AS t ON g.station_id = t.station_id AND g.hour = t.hour
       LEFT JOIN v_sed AS p ON g.station_id = p.station_id AND g.hour = p.hour
       LEFT JOIN v_mdi AS r ON g.station_id = r.station_id AND g.hour = r.hour""",
)
register(
    "vulnerable_var",
    "station_id:s hour_of_day:i avg_dispatch_count:f4 vulnerable_total_dispatch:f4 var_t_score:f6",
    lambda t: scores.vulnerable_var(t.sph, MONTH),
    "SELECT station_id, hour AS hour_of_day, d AS avg_dispatch_count, vd AS vulnerable_total_dispatch, var AS var_t_score FROM v_var",
)
register(
    "vulnerable_sed",
    "station_id:s hour_of_day:i avg_traffic_count:f4 vulnerable_total_traffic:f4 sed_t_score:f6",
    lambda t: scores.vulnerable_sed(shp(t, MONTH), MONTH),
    "SELECT station_id, hour AS hour_of_day, a AS avg_traffic_count, vt AS vulnerable_total_traffic, sed AS sed_t_score FROM v_sed",
)
register(
    "vulnerable_mdi",
    "station_id:s hour_of_day:i raw_passengers:f4 mdi_t_score:f6",
    lambda t: scores.vulnerable_mdi(t.sections, t.sph, shp(t, MONTH), t.sm, MONTH),
    "SELECT station_id, hour AS hour_of_day, x AS raw_passengers, mdi AS mdi_t_score FROM v_mdi",
)
register(
    "vulnerable_scores",
    BASE + "var_t_score:f6 sed_t_score:f6 mdi_t_score:f6 avg_dispatch_count:f2 vulnerable_total_dispatch:f2 "
    "avg_traffic_count:f2 vulnerable_total_traffic:f2 section_passenger_count:f2 is_vulnerable_time:b "
    "vulnerable_category:s total_drt_score:f4",
    vulnerable,
    "SELECT * FROM vulnerable",
)

# questions over the score tables -------------------------------------------------------------
define(
    "peaks_c",
    """SELECT c.*, node_name AS station_name, latitude, longitude FROM (
       SELECT district_name, station_id, max(total_drt_score) AS drt_score,
       first(hour_of_day ORDER BY total_drt_score DESC, hour_of_day) AS peak_hour FROM commuter GROUP BY ALL) AS c
       JOIN stops ON c.station_id = stops.node_id""",
)
PEAK_SPEC = "district_name:s station_id:s station_name:s latitude:f6 longitude:f6 drt_score:f4 peak_hour:i"


def peaks(t):
    return sq.station_peaks(commuter(t), t.stops)


register(
    "district_drt_scores",
    PEAK_SPEC,
    lambda t: sq.district_drt_scores(commuter(t), t.stops, "NATION_3"),
    "SELECT * FROM peaks_c WHERE district_name = 'NATION_3'",
)
register(
    "station_drt_detail",
    "station_id:s hour_of_day:i total_drt_score:f4 var_t_score:f6 sed_t_score:f6 mdi_t_score:f6 peak_score:f4 "
    "peak_hour:i monthly_average:f4 current_hour:i current_score:f4",
    lambda t: sq.station_drt_detail(vulnerable(t), "vulnerable", ["7", "8", "11"], 8),
    """SELECT *, max(total_drt_score) OVER w AS peak_score, first(hour_of_day) OVER (PARTITION BY station_id ORDER BY total_drt_score DESC, hour_of_day) AS peak_hour,
       avg(total_drt_score) OVER w AS monthly_average, 8 AS current_hour,
       max(total_drt_score) FILTER (hour_of_day = 8) OVER w AS current_score
       FROM vulnerable WHERE station_id IN ('7', '8', '11') WINDOW w AS (PARTITION BY station_id)""",
)
STAT = """SELECT '{m}' AS model, (SELECT count(DISTINCT station_id) FROM {m}) AS total_stations,
       (SELECT avg(a) FROM (SELECT avg(total_drt_score) AS a FROM {m} GROUP BY station_id)) AS overall_avg_score,
       max(total_drt_score) AS overall_max_score, min(total_drt_score) AS overall_min_score,
       (SELECT hour_of_day FROM {m} GROUP BY 1 ORDER BY round(avg(total_drt_score), 8) DESC, 1 LIMIT 1) AS peak_hour,
       (SELECT hour_of_day FROM {m} GROUP BY 1 ORDER BY round(avg(total_drt_score), 8), 1 LIMIT 1) AS lowest_hour FROM {m}"""


def all_statistics(t):
    out = None
    for name, df in models(t).items():
        row = sq.drt_model_statistics(df).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


register(
    "drt_model_statistics",
    "model:s total_stations:i overall_avg_score:f4 overall_max_score:f4 overall_min_score:f4 peak_hour:i lowest_hour:i",
    all_statistics,
    " UNION ALL ".join(STAT.format(m=m) for m in ("commuter", "tourism", "vulnerable")),
)
register(
    "compare_drt_models",
    "station_id:s model:s peak_score:f4 peak_hour:i avg_score:f4",
    lambda t: sq.compare_drt_models(models(t), "7"),
    " UNION ALL ".join(
        f"""SELECT '7' AS station_id, '{m}' AS model, coalesce(max(total_drt_score), 0) AS peak_score,
        coalesce(first(hour_of_day ORDER BY total_drt_score DESC, hour_of_day), 0) AS peak_hour,
        coalesce(avg(total_drt_score), 0) AS avg_score FROM {m} WHERE station_id = '7'"""
        for m in ("commuter", "tourism", "vulnerable")
    ),
)
TEN = [f"NATION_{i}" for i in range(0, 20, 2)]
register(
    "city_top_drt",
    PEAK_SPEC,
    lambda t: sq.city_top_drt(peaks(t), TEN),
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY district_name ORDER BY drt_score DESC, station_id) AS k
       FROM peaks_c WHERE district_name IN ({', '.join(repr(d) for d in TEN)})) WHERE k <= 5 ORDER BY drt_score DESC, station_id LIMIT 10""",
)


def filtered(t):
    p = peaks(t)
    named = lambda k, df: df.withColumn("filter", F.lit(k))
    return (
        named("band", sq.drt_score_filter(p, band="90+"))
        .unionByName(named("top", sq.drt_score_filter(p, top=20)))
        .unionByName(named("search", sq.drt_score_filter(p, search="000000012")))
    )


register(
    "drt_score_filter",
    "filter:s " + PEAK_SPEC,
    filtered,
    """SELECT 'band' AS filter, * FROM peaks_c WHERE drt_score >= 90
       UNION ALL SELECT 'top', * FROM (SELECT * FROM peaks_c ORDER BY drt_score DESC, station_id LIMIT 20)
       UNION ALL SELECT 'search', * FROM (SELECT * FROM peaks_c WHERE lower(station_name) LIKE '%000000012%'
         OR lower(station_id) LIKE '%000000012%' ORDER BY station_id LIMIT 5)""",
)
register(
    "drt_area_mean",
    "district_name:s stations:i mean_score:f1",
    lambda t: sq.drt_area_mean(peaks(t)),
    "SELECT district_name, count(*) AS stations, avg(drt_score) AS mean_score FROM peaks_c GROUP BY 1",
)
register(
    "drt_suitability_class",
    "district_name:s model:s score:f4 rank:i suitability:s colour:s",
    lambda t: sq.drt_suitability_class(models(t)),
    f"""SELECT *, row_number() OVER (PARTITION BY district_name ORDER BY score DESC, model) AS rank,
       {chain('score', classes.SUITABILITY, '부적합', '>=')} AS suitability,
       {chain('score', classes.SCORE_COLOUR, 'gray', '>=')} AS colour
       FROM (SELECT district_name, model, round(avg(total_drt_score) + 1e-10, 4) AS score FROM (
         SELECT 'commuter' AS model, district_name, total_drt_score FROM commuter
         UNION ALL SELECT 'tourism', district_name, total_drt_score FROM tourism
         UNION ALL SELECT 'vulnerable', district_name, total_drt_score FROM vulnerable) GROUP BY ALL)""",
)

# daily features --------------------------------------------------------------------------------
define(
    "dayrows",
    """SELECT s.record_date, s.route_id, s.node_id, s.hour, dispatch_count AS d, ride_passenger + alight_passenger AS p,
       coalesce(m, 0) / 1000 AS ld, h IS NOT NULL AS has_sections FROM sph AS s
       LEFT JOIN (SELECT record_date, route_id, hour, avg(passenger_count) AS m FROM sections GROUP BY ALL) AS a
         ON s.record_date = a.record_date AND s.route_id = a.route_id AND s.hour = a.hour
       LEFT JOIN (SELECT DISTINCT record_date, route_id, 1 AS h FROM sections) AS b
         ON s.record_date = b.record_date AND s.route_id = b.route_id""",
)
W = "OVER (PARTITION BY record_date, route_id, node_id)"
SHARES = f"""d / max(d) {W} AS tc0, CASE WHEN max(p) {W} > 0 THEN p / max(p) {W} ELSE 0 END AS pd0"""
DKEY = "record_date:s route_id:s node_id:s hour:i "
register(
    "daily_commute_features",
    DKEY + "tc:f6 pdr:f6 ru:f6 commute_drt_score:f6",
    lambda t: daily.daily_commute_features(t.sph, t.sections),
    f"""SELECT *, tc0 AS tc, pd0 AS pdr, ld AS ru, tc0 * 0.3::DOUBLE + pd0 * 0.4::DOUBLE + ld * 0.2::DOUBLE + 0.05::DOUBLE AS commute_drt_score
       FROM (SELECT *, {SHARES} FROM dayrows)""",
)
register(
    "daily_tourism_features",
    DKEY + "tc:f6 tdr:f6 ru:f6 tourism_drt_score:f6",
    lambda t: daily.daily_tourism_features(t.sph, t.sections),
    f"""SELECT *, tc * 0.25 + tdr * 0.35::DOUBLE + ru * 0.25 + 0.105::DOUBLE AS tourism_drt_score FROM (
       SELECT *, tc0 * (CASE WHEN {TOUR} THEN 1.2::DOUBLE ELSE 1 END) AS tc, pd0 * (CASE WHEN {TOUR} THEN 1.1::DOUBLE ELSE 1 END) AS tdr,
       ld * (CASE WHEN {TOUR} THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) AS ru FROM (SELECT *, {SHARES} FROM dayrows))""",
)
register(
    "daily_vulnerable_features",
    DKEY + "var:f6 sed:f6 mdi:f6 vulnerable_drt_score:f6",
    lambda t: daily.daily_vulnerable_features(t.sph, t.sections),
    f"""SELECT *, var * 0.3::DOUBLE + sed * 0.25 + mdi * 0.25 + 0.14::DOUBLE AS vulnerable_drt_score FROM (
       SELECT *, CASE WHEN vd > 0 THEN d / vd ELSE 0 END * CASE band WHEN 'medical' THEN 1.5::DOUBLE WHEN 'welfare' THEN 1.3::DOUBLE WHEN 'evening' THEN 1.2::DOUBLE ELSE 1 END AS var,
       CASE WHEN vp > 0 THEN p / vp ELSE 0 END * CASE WHEN p < 100 THEN 1.4::DOUBLE ELSE 1 END * CASE WHEN hour IN (9, 14, 18) THEN 1.2::DOUBLE ELSE 1 END AS sed,
       CASE WHEN has_sections THEN greatest(least(1 - ld, 1), 0) ELSE 0.5 END * CASE WHEN band = 'normal' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS mdi
       FROM (SELECT *, {BAND} AS band, sum(CASE WHEN {BAND} <> 'normal' THEN d ELSE 0 END) {W} AS vd,
             sum(CASE WHEN {BAND} <> 'normal' THEN p ELSE 0 END) {W} AS vp FROM dayrows))""",
)
CATS = ["인구밀집지역", "발달상권", "관광특구", "고궁·문화유산", "공원", "기타"]
register(
    "poi_weights",
    "p_partkey:i category:s commute_weight:f2 tourism_weight:f2 vulnerable_weight:f2",
    lambda t: daily.poi_weights(
        t.raw("part").select(
            "p_partkey", F.element_at(F.array(*[F.lit(c) for c in CATS]), (F.col("p_size") % 6 + 1).cast("int")).alias("category")
        )
    ),
    f"""SELECT p_partkey, category, CASE category WHEN '인구밀집지역' THEN 1.0 WHEN '발달상권' THEN 0.8 WHEN '관광특구' THEN 0.6
         WHEN '고궁·문화유산' THEN 0.4 WHEN '공원' THEN 0.2 ELSE 0.1 END AS commute_weight,
       CASE category WHEN '관광특구' THEN 1.0 WHEN '고궁·문화유산' THEN 0.9 WHEN '발달상권' THEN 0.8 WHEN '공원' THEN 0.7 ELSE 0.1 END AS tourism_weight,
       CASE category WHEN '인구밀집지역' THEN 0.9 WHEN '공원' THEN 0.8 WHEN '고궁·문화유산' THEN 0.7 WHEN '발달상권' THEN 0.6 WHEN '관광특구' THEN 0.5 ELSE 0.1 END AS vulnerable_weight
       FROM (SELECT p_partkey, list_extract([{', '.join(repr(c) for c in CATS)}], p_size % 6 + 1) AS category FROM part)""",
)
