"""Spatial joins, features, sequences and graphs (survey sections 2.4, 2.11 and 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import demand, geo
from headway.functions.calendar import dow
from headway.operators import graph, sequences as seq, spatial, views
from headway.plans.registry import define, register
from headway.session import scratch
from headway.sources import tables

# spatial ------------------------------------------------------------------------------------
define("activestops", "SELECT * FROM stops WHERE is_active")
register(
    "spatial_within",
    "node_id:s adm_cd:s adm_nm:s sggnm:s",
    lambda t: spatial.spatial_within(t.stops, t.boundaries),
    """SELECT node_id, arg_min(adm_cd, adm_cd) AS adm_cd, arg_min(adm_nm, adm_cd) AS adm_nm, arg_min(sggnm, adm_cd) AS sggnm
       FROM activestops JOIN boundaries ON longitude > x0 AND longitude < x1 AND latitude > y0 AND latitude < y1 GROUP BY node_id""",
)
register(
    "distinct_on",
    "district:s node_id:s",
    lambda t: t.sm.groupBy(F.col("sgg_name").alias("district")).agg(F.min_by("node_id", F.struct("adm_name", "node_id")).alias("node_id")),
    "SELECT DISTINCT ON (sgg_name) sgg_name AS district, node_id FROM sm ORDER BY sgg_name, adm_name, node_id",
)
KMS = """2 * 6371 * asin(sqrt(least(1, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude))
 * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"""


def radius_sql(km):
    return f"""SELECT a.node_id AS src, b.node_id AS dst, {KMS} AS dist_km FROM grid_stops AS a JOIN grid_stops AS b
       ON a.node_id <> b.node_id AND abs(a.latitude - b.latitude) <= {km / 111.0} WHERE {KMS} <= {km}"""


define("edges1", radius_sql(1.0))
define("edges3", radius_sql(3.0))
EDGE = "src:s dst:s dist_km:f6"
register("range_radius_join", EDGE, lambda t: spatial.range_radius_join(t.grid_stops, 3.0), "SELECT * FROM edges3")
register("adjacency_distance", EDGE, lambda t: graph.adjacency_distance(t.grid_stops, 1.0), "SELECT * FROM edges1")


def line_stops(t):
    """Two overlapping families of routes along the stop numbers."""
    k = F.col("c_custkey")
    base = t.raw("customer")
    short = base.select(F.concat(F.lit("a"), F.floor(k / 40).cast("string")).alias("route_id"), k.cast("string").alias("stop_id"), (k % 40).alias("stop_sequence"))
    long = base.select(F.concat(F.lit("b"), F.floor(k / 90).cast("string")).alias("route_id"), k.cast("string").alias("stop_id"), (k % 90).alias("stop_sequence"))
    return short.unionByName(long)


define(
    "linestops",
    """SELECT 'a' || (c_custkey // 40) AS route_id, CAST(c_custkey AS VARCHAR) AS stop_id, c_custkey % 40 AS stop_sequence FROM customer
       UNION ALL SELECT 'b' || (c_custkey // 90), CAST(c_custkey AS VARCHAR), c_custkey % 90 FROM customer""",
)
BAND_SQL = """SELECT DISTINCT a.stop_id AS src, b.stop_id AS dst FROM linestops AS a JOIN linestops AS b ON a.route_id = b.route_id
       AND abs(a.stop_sequence - b.stop_sequence) <= 2 AND a.stop_id <> b.stop_id"""
register("band_self_join", "src:s dst:s", lambda t: spatial.band_self_join(line_stops(t)), BAND_SQL)
register(
    "adjacency_route",
    "src:s dst:s",
    lambda t: graph.adjacency_route(line_stops(t), t.stops.filter("is_active")),
    f"""SELECT * FROM ({BAND_SQL}) WHERE src IN (SELECT node_id FROM activestops) AND dst IN (SELECT node_id FROM activestops)""",
)
register(
    "geodesic_m",
    "node_id:s metres:f1",
    lambda t: t.stops.select("node_id", geo.geodesic_m(F.col("latitude"), F.col("longitude"), F.lit(37.5665), F.lit(126.978)).alias("metres")),
    f"""SELECT a.node_id, {KMS} * 1000 AS metres FROM stops AS a CROSS JOIN (SELECT CAST(37.5665 AS DOUBLE) AS latitude, CAST(126.978 AS DOUBLE) AS longitude) AS b""",
)
register(
    "make_point",
    "node_id:s lon:f4 lat:f4",
    lambda t: t.stops.select("node_id", geo.make_point(F.when(F.col("is_active"), F.col("longitude")), F.col("latitude")).alias("p")).select("node_id", "p.lon", "p.lat"),
    "SELECT node_id, CASE WHEN is_active THEN longitude END AS lon, CASE WHEN is_active THEN latitude END AS lat FROM stops",
)
register(
    "boundary_outer_ring",
    "district_name:s adm_cd:s vertices:i lon0:f3 lat0:f3",
    lambda t: spatial.boundary_outer_ring(
        t.raw("supplier").select(F.concat(F.lit("D"), F.floor(F.col("s_suppkey") / 16).cast("string")).alias("district_name")).distinct(), t.boundaries
    ).select("district_name", "adm_cd", F.size("ring").alias("vertices"), F.col("ring")[0]["lon"].alias("lon0"), F.col("ring")[0]["lat"].alias("lat0")),
    """SELECT d AS district_name, adm_cd, 5 AS vertices, coalesce(x0, 126.9) AS lon0, coalesce(y0, 37.5) AS lat0
       FROM (SELECT DISTINCT 'D' || (s_suppkey // 16) AS d FROM supplier) LEFT JOIN boundaries ON d = sggnm""",
)
register(
    "city_boundary_union",
    "x1:f3 y1:f3 x2:f3 y2:f3",
    lambda t: spatial.city_boundary_union(t.boundaries).select(
        F.col("a.lon").alias("x1"), F.col("a.lat").alias("y1"), F.col("b.lon").alias("x2"), F.col("b.lat").alias("y2")
    ),
    """SELECT x1, y1, x2, y2 FROM (SELECT x0 AS x1, y0 AS y1, x1 AS x2, y0 AS y2 FROM boundaries
         UNION ALL SELECT x0, y1, x1, y1 FROM boundaries UNION ALL SELECT x0, y0, x0, y1 FROM boundaries
         UNION ALL SELECT x1, y0, x1, y1 FROM boundaries) GROUP BY ALL HAVING count(*) = 1""",
)

# scalar features ------------------------------------------------------------------------------


def features(t):
    return seq.mstgcn_features(t.usage, views.stop_route_stats(t.route_stops, t.routes))


define(
    "feat",
    """SELECT *, greatest(ap, 1) AS i1, CASE WHEN NOT is_operational THEN 0 WHEN NOT is_in_service_hours THEN 1 ELSE 2 END AS av,
       is_weekend OR is_holiday AS rest FROM (
       SELECT u.*, hour(recorded_at) AS h, dayofweek(recorded_at) AS w, coalesce(route_count, 1) AS rc,
       CASE WHEN x IS NULL OR x = 0 THEN 1440 ELSE abs(x) END AS ap FROM (
         SELECT usage.*, route_count, CASE dayofweek(recorded_at) WHEN 0 THEN coalesce(avg_sunday_interval, 1440) WHEN 6 THEN coalesce(avg_saturday_interval, 1440)
           ELSE coalesce(avg_weekday_interval, 1440) END AS x FROM usage LEFT JOIN stopstats ON usage.stop_id = stopstats.stop_id) AS u)""",
)
define(
    "featp",
    """SELECT *, (ln(boarding_count + 1) - 0.153::DOUBLE) / 0.456::DOUBLE AS nb, (ln(i1) - 4.9986::DOUBLE) / 0.7142::DOUBLE AS ni,
       greatest(0::DOUBLE, least(1::DOUBLE, ((0.05::DOUBLE + 0.9::DOUBLE / (1 + exp(-ni))) * (CASE av WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.2::DOUBLE ELSE 1 END) * 0.5::DOUBLE
         + greatest(0.05::DOUBLE, 1 - (nb + 0.3355::DOUBLE) / 10.691::DOUBLE) * 0.3::DOUBLE
         + (CASE WHEN h IN (7, 8, 9, 17, 18, 19) THEN 1::DOUBLE WHEN h BETWEEN 10 AND 16 THEN 0.8::DOUBLE WHEN h IN (20, 21, 22) THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) * 0.2::DOUBLE)
         * (CASE WHEN rest THEN 1.2::DOUBLE ELSE 1 END))) AS p FROM feat""",
)
register(
    "mstgcn_features",
    "stop_id:s recorded_at:s normalized_log_boarding_count:f4 service_availability:i is_rest_day:b normalized_interval:f4 "
    "hour_of_day:i day_of_week:i applicable_interval:f1 route_count:i drt_probability:f4",
    features,
    """SELECT stop_id, recorded_at, nb AS normalized_log_boarding_count, av AS service_availability, rest AS is_rest_day,
       ni AS normalized_interval, h AS hour_of_day, w AS day_of_week, ap AS applicable_interval, rc AS route_count, p AS drt_probability FROM featp""",
)
register(
    "route_interval_join",
    "stop_id:s recorded_at:s weekday_interval:f1 saturday_interval:f1 sunday_interval:f1 route_count:i",
    lambda t: seq.route_interval_join(t.usage, views.stop_route_stats(t.route_stops, t.routes)),
    """SELECT u.stop_id, recorded_at, coalesce(avg_weekday_interval, 1440) AS weekday_interval, coalesce(avg_saturday_interval, 1440) AS saturday_interval,
       coalesce(avg_sunday_interval, 1440) AS sunday_interval, coalesce(route_count, 1) AS route_count
       FROM usage AS u LEFT JOIN stopstats AS s ON u.stop_id = s.stop_id""",
)
KEY = "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i "


def line_scalar(name, col, build, sql):
    register(
        name,
        KEY + col,
        lambda t: t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", build().alias(col.split(":")[0])),
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql} AS {col.split(':')[0]} FROM lineitem",
    )


line_scalar("log_z_boarding", "z:f4", lambda: demand.log_z_boarding(F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))),
            "(ln(CASE WHEN l_linenumber <> 7 THEN l_quantity ELSE 0 END + 1) - 0.153::DOUBLE) / 0.456::DOUBLE")
line_scalar("log_z_interval", "z:f4", lambda: demand.log_z_interval(F.when(F.col("l_linenumber") != 7, F.col("l_quantity") - 5)),
            "(ln(greatest(1, CASE WHEN l_linenumber <> 7 THEN l_quantity - 5 ELSE 1440 END)) - 4.9986::DOUBLE) / 0.7142::DOUBLE")
line_scalar("correct_interval", "minutes:f1", lambda: demand.correct_interval(F.when(F.col("l_linenumber") != 7, F.col("l_quantity") - 10)),
            "CASE WHEN l_linenumber = 7 OR l_quantity = 10 THEN 1440 ELSE abs(l_quantity - 10) END")
line_scalar("applicable_interval", "minutes:f1",
            lambda: demand.applicable_interval(F.col("l_quantity"), -F.col("l_quantity"), F.lit(0.0), dow(F.col("l_shipdate").cast("date"))),
            "CASE WHEN dayofweek(l_shipdate) = 0 THEN 1440 ELSE l_quantity END")
line_scalar("service_availability", "state:i", lambda: demand.service_availability(F.col("l_linenumber") > 2, F.col("l_quantity") > 20),
            "CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_quantity <= 20 THEN 1 ELSE 2 END")
line_scalar("is_rest_day", "rest:b", lambda: demand.is_rest_day(dow(F.col("l_shipdate").cast("date")).isin(0, 6), F.dayofmonth("l_shipdate") == 1),
            "dayofweek(l_shipdate) IN (0, 6) OR day(l_shipdate) = 1")
line_scalar("probability_bucket", "p:f2", lambda: demand.probability_bucket(F.col("l_quantity") * 10, F.col("l_linenumber") - 1),
            """CASE WHEN l_linenumber > 3 OR l_quantity * 10 > 999 THEN NULL ELSE
               (CASE WHEN l_quantity >= 30 THEN 0.9 WHEN l_quantity >= 12 THEN 0.7 WHEN l_quantity >= 6 THEN 0.5 ELSE 0.3 END)
               * (CASE WHEN l_linenumber = 1 THEN 1 ELSE 0.8 END) END""")
register(
    "drt_probability",
    "stop_id:s recorded_at:s drt_probability:f4",
    features,
    "SELECT stop_id, recorded_at, p AS drt_probability FROM featp",
)
register(
    "cyclical_time",
    "stop_id:s recorded_at:s hour_sin:f6 hour_cos:f6 day_sin:f6 day_cos:f6",
    lambda t: demand.cyclical_time(features(t)),
    """SELECT stop_id, recorded_at, sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos,
       sin(2 * pi() * w / 7) AS day_sin, cos(2 * pi() * w / 7) AS day_cos FROM featp""",
)
register(
    "training_view",
    "stop_id:s stop_name:s recorded_at:s latitude:f4 target_value:f4 hour_sin:f6 day_cos:f6",
    lambda t: seq.training_view(features(t), t.stops),
    """SELECT stop_id, node_name AS stop_name, recorded_at, latitude, p AS target_value, sin(2 * pi() * h / 24) AS hour_sin,
       cos(2 * pi() * w / 7) AS day_cos FROM featp JOIN stops ON stop_id = node_id""",
)
register(
    "features_stops_join",
    "stop_id:s stop_name:s recorded_at:s drt_probability:f4",
    lambda t: tables.features_with_stops(features(t), t.stops),
    "SELECT stop_id, node_name AS stop_name, recorded_at, p AS drt_probability FROM featp JOIN stops ON stop_id = node_id",
)
register(
    "extract_temporal",
    "stop_id:s recorded_at:s drt_probability:f4 hour_of_day:i day_of_week:i is_weekend:b",
    lambda t: seq.extract_temporal(features(t), "2024-01-05 00:00:00", "2024-01-20 23:00:00"),
    """SELECT stop_id, recorded_at, p AS drt_probability, h AS hour_of_day, w AS day_of_week, is_weekend FROM featp
       WHERE recorded_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 23:00:00'""",
)


def exported(t):
    path = tables.export_features_csv(features(t), t.stops, scratch(t.spark, "features"), "2024-01-03 00:00:00", "2024-01-25 23:00:00")
    return t.spark.read.option("header", True).csv(path)


register(
    "export_features_csv",
    "stop_id:s recorded_at:s drt_probability:f4 latitude:f4",
    lambda t: exported(t).withColumn("recorded_at", F.regexp_replace(F.substring("recorded_at", 1, 19), "T", " ")),
    """SELECT stop_id, recorded_at, p AS drt_probability, latitude FROM featp JOIN stops ON stop_id = node_id
       WHERE recorded_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25 23:00:00'""",
)
register(
    "export_features_sample",
    "stop_id:s recorded_at:s drt_probability:f4",
    lambda t: tables.export_features_sample(features(t), t.stops, 500, 42),
    """SELECT stop_id, recorded_at, p AS drt_probability FROM featp JOIN stops ON stop_id = node_id
       ORDER BY md5('42|' || stop_id || '|' || strftime(recorded_at, '%Y-%m-%d %H')) LIMIT 500""",
)
register(
    "feature_extract_info",
    "total_records:i unique_stops:i min_date:s max_date:s avg_name_length:f4",
    lambda t: tables.features_with_stops(features(t), t.stops, "2024-01-01 00:00:00", "2024-01-31 23:59:59").agg(
        F.count(F.lit(1)).alias("total_records"), F.countDistinct("stop_id").alias("unique_stops"), F.min("recorded_at").alias("min_date"),
        F.max("recorded_at").alias("max_date"), F.avg(F.length("stop_name")).alias("avg_name_length"),
    ),
    """SELECT count(*) AS total_records, count(DISTINCT stop_id) AS unique_stops, min(recorded_at) AS min_date, max(recorded_at) AS max_date,
       avg(length(node_name)) AS avg_name_length FROM usage JOIN stops ON stop_id = node_id""",
)
register(
    "stop_spatial_features",
    "stop_id:s avg_daily_boarding:f4 peak_demand_ratio:f4 zero_demand_rate:f4 avg_weekday_interval:f1 total_routes:i",
    lambda t: seq.stop_spatial_features(t.usage, views.stop_route_stats(t.route_stops, t.routes)),
    """SELECT u.*, avg_weekday_interval, route_count AS total_routes FROM (
       SELECT stop_id, sum(boarding_count) / count(DISTINCT CAST(recorded_at AS DATE)) AS avg_daily_boarding,
       max(boarding_count) / nullif(avg(boarding_count), 0) AS peak_demand_ratio,
       count(*) FILTER (boarding_count = 0) / count(*) AS zero_demand_rate FROM usage GROUP BY stop_id) AS u
       LEFT JOIN stopstats AS s ON u.stop_id = s.stop_id""",
)

# grids and sequences ---------------------------------------------------------------------------


def hourly(t):
    return seq.hour_grid(t.usage, ["boarding_count", "alighting_count"])


def grid(t):
    return hourly(t).rows()


define(
    "gridh",
    """SELECT g.stop_id, t_idx, hour_at, coalesce(boarding_count, 0) AS boarding_count, coalesce(alighting_count, 0) AS alighting_count
       FROM (SELECT stop_id, unnest(range(n + 1)) AS t_idx, lo + to_hours(unnest(range(n + 1))) AS hour_at FROM (SELECT DISTINCT stop_id FROM usage)
             CROSS JOIN (SELECT min(recorded_at) AS lo, date_diff('hour', min(recorded_at), max(recorded_at)) AS n FROM usage)) AS g
       LEFT JOIN usage AS u ON g.stop_id = u.stop_id AND hour_at = recorded_at""",
)
register(
    "densify_time_grid",
    "stop_id:s t_idx:i hour_at:s boarding_count:i alighting_count:i",
    grid,
    "SELECT * FROM gridh",
)
register(
    "pivot_feature_matrix",
    "feature:s stop_id:s t_idx:i value:f2",
    lambda t: seq.pivot_feature_matrix(grid(t), ["boarding_count", "alighting_count"]),
    """SELECT 'boarding_count' AS feature, stop_id, t_idx, boarding_count AS value FROM gridh
       UNION ALL SELECT 'alighting_count', stop_id, t_idx, alighting_count FROM gridh""",
)


def flat(df, *arrays):
    return df.withColumns({a: F.array_join(F.transform(a, lambda x: x.cast("long").cast("string")), ",") for a in arrays})


def frame(v, a, b):
    side = lambda n: f"{abs(n)} PRECEDING" if n < 0 else (f"{n} FOLLOWING" if n else "CURRENT ROW")
    return f"list({v}) OVER (PARTITION BY stop_id ORDER BY t_idx ROWS BETWEEN {side(a)} AND {side(b)})"


def text(x):
    return f"array_to_string(list_transform({x}, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')"


register(
    "multi_scale_sequences",
    "stop_id:s t_idx:i boarding_count_hour:s boarding_count_day:s boarding_count_week:s y:s",
    lambda t: flat(seq.multi_scale_sequences(hourly(t), ["boarding_count"], "alighting_count"), "boarding_count_hour", "boarding_count_day", "boarding_count_week", "y"),
    f"""SELECT stop_id, t_idx, {text('a')} AS boarding_count_hour, {text('b')} AS boarding_count_day, {text('c')} AS boarding_count_week, {text('d')} AS y
       FROM (SELECT stop_id, t_idx, {frame('boarding_count', -6, -1)} AS a, {frame('boarding_count', -24, -1)} AS b,
             {frame('boarding_count', -168, -145)} AS c, {frame('alighting_count', 0, 23)} AS d FROM gridh) WHERE t_idx >= 168 AND len(d) = 24""",
)


def lags(ks):
    return "[" + ", ".join(f"lag(boarding_count, {k}) OVER (PARTITION BY stop_id ORDER BY t_idx)" for k in ks) + "]"


register(
    "periodic_samples",
    "stop_id:s t_idx:i hour_sample:s day_sample:s week_sample:s target:s",
    lambda t: flat(seq.periodic_samples(hourly(t), "boarding_count"), "hour_sample", "day_sample", "week_sample", "target"),
    f"""SELECT stop_id, t_idx, CASE WHEN t_idx >= 6 THEN {text('a')} END AS hour_sample, {text('list_filter(b, lambda e: e IS NOT NULL)')} AS day_sample,
       {text('list_filter(c, lambda e: e IS NOT NULL)')} AS week_sample, CAST(CAST(boarding_count AS BIGINT) AS VARCHAR) AS target
       FROM (SELECT *, {frame('boarding_count', -6, -1)} AS a, {lags([24, 48, 72])} AS b, {lags([168, 336])} AS c FROM gridh)""",
)
register(
    "strided_samples",
    "stop_id:s t_idx:i hour_sample:s day_sample:s week_sample:s target:s",
    lambda t: flat(seq.strided_samples(hourly(t), "boarding_count"), "hour_sample", "day_sample", "week_sample", "target"),
    f"""SELECT stop_id, t_idx, CASE WHEN t_idx >= 6 THEN {text('a')} END AS hour_sample, CASE WHEN t_idx >= 72 THEN {text('b')} END AS day_sample,
       CASE WHEN t_idx >= 168 THEN {text('c')} END AS week_sample, CAST(CAST(boarding_count AS BIGINT) AS VARCHAR) AS target
       FROM (SELECT *, {frame('boarding_count', -6, -1)} AS a, {lags([72, 48, 24])} AS b, {lags([168, 144, 120, 96, 72, 48, 24])} AS c FROM gridh)""",
)
register(
    "sliding_windows",
    "stop_id:s t_idx:i x:s y:s",
    lambda t: flat(seq.sliding_windows(hourly(t), "boarding_count"), "x", "y"),
    f"""SELECT stop_id, t_idx, {text('a')} AS x, CAST(CAST(boarding_count AS BIGINT) AS VARCHAR) AS y
       FROM (SELECT *, {frame('boarding_count', -6, -1)} AS a FROM gridh) WHERE t_idx >= 6""",
)
define(
    "splits",
    """SELECT *, t_idx - 168 AS sample_idx, CASE WHEN t_idx - 168 < floor(n * 0.6) THEN 'train' WHEN t_idx - 168 < floor(n * 0.8) THEN 'val' ELSE 'test' END AS split
       FROM (SELECT *, max(t_idx) OVER () - 167 AS n FROM gridh WHERE t_idx >= 168)""",
)


def split(t):
    return seq.temporal_split(grid(t).filter("t_idx >= 168"))


register("temporal_split", "stop_id:s t_idx:i sample_idx:i split:s", split, "SELECT * FROM splits")
register(
    "train_zscore",
    "stop_id:s t_idx:i split:s z:f4",
    lambda t: seq.train_zscore(split(t), "boarding_count").withColumnRenamed("boarding_count_z", "z"),
    """SELECT stop_id, t_idx, split, (boarding_count - (SELECT avg(boarding_count) FROM splits WHERE split = 'train'))
       / (SELECT stddev_pop(boarding_count) FROM splits WHERE split = 'train') AS z FROM splits""",
)
register(
    "feature_stats",
    "feature:s min:f4 max:f4 mean:f4 std:f4",
    lambda t: seq.feature_stats(grid(t), ["boarding_count", "alighting_count"]),
    " UNION ALL ".join(
        f"SELECT '{v}' AS feature, min({v}) AS min, max({v}) AS max, avg({v}) AS mean, stddev_pop({v}) AS std FROM gridh"
        for v in ("boarding_count", "alighting_count")
    ),
)


def thirds(t):
    """Sequences of three periods of the month, each with its own time index, and their spans."""
    d = F.dayofmonth("recorded_at")
    cuts = [d <= 10, d.between(11, 20), d > 20]
    grids = [seq.hour_grid(t.usage.filter(c), ["boarding_count"]) for c in cuts]
    return [seq.sliding_windows(g, "boarding_count") for g in grids], [g.spans(first=seq.HOUR_LEN) for g in grids]


define(
    "commonst",
    """SELECT stop_id FROM (SELECT DISTINCT stop_id, CASE WHEN day(recorded_at) <= 10 THEN 0 WHEN day(recorded_at) <= 20 THEN 1 ELSE 2 END AS p FROM usage)
       GROUP BY 1 HAVING count(*) = 3""",
)
register(
    "common_stops",
    "stop_id:s",
    lambda t: seq.common_stops(t.usage.withColumn("p", F.least(F.floor((F.dayofmonth("recorded_at") - 1) / 10), F.lit(2))), "p"),
    "SELECT * FROM commonst",
)
register(
    "merge_monthly_sequences",
    "stop_id:s samples:i first_sample:i last_sample:i boardings:i",
    lambda t: seq.merge_monthly_sequences(*thirds(t)).groupBy("stop_id").agg(
        F.count(F.lit(1)).alias("samples"), F.min("sample_idx").alias("first_sample"), F.max("sample_idx").alias("last_sample"),
        F.sum(F.col("y")[0]).alias("boardings"),
    ),
    """WITH span AS (SELECT p, min(recorded_at) AS lo, date_diff('hour', min(recorded_at), max(recorded_at)) + 1 AS n FROM (
         SELECT *, CASE WHEN day(recorded_at) <= 10 THEN 0 WHEN day(recorded_at) <= 20 THEN 1 ELSE 2 END AS p FROM usage) GROUP BY p)
       SELECT c.stop_id, (SELECT sum(n - 6) FROM span) AS samples, 0 AS first_sample, (SELECT sum(n - 6) FROM span) - 1 AS last_sample,
       coalesce(sum(boarding_count) FILTER (date_diff('hour', lo, recorded_at) >= 6), 0) AS boardings
       FROM commonst AS c JOIN usage AS u ON c.stop_id = u.stop_id
       JOIN span ON p = CASE WHEN day(recorded_at) <= 10 THEN 0 WHEN day(recorded_at) <= 20 THEN 1 ELSE 2 END GROUP BY c.stop_id""",
)


def forecast(t):
    held = hourly(t)
    samples = seq.multi_scale_sequences(held, ["boarding_count"], "boarding_count", names=("day",))
    anchors = held.spans(first=seq.WEEK_BACK, ahead=seq.HORIZON - 1)
    return seq.forecast_error(seq.temporal_split(samples, spans=anchors), "boarding_count_day", "y", 32, seq.HORIZON)


register(
    "forecast_error",
    "mse:f6 rmse:f6",
    forecast,
    f"""SELECT avg(loss) AS mse, sqrt(avg(loss)) AS rmse FROM (
       SELECT (t_idx - 168) // 32 AS batch, avg((e - lagged) ** 2) AS loss FROM (
         SELECT t_idx, unnest(d) AS e, unnest(b) AS lagged FROM (
           SELECT t_idx, {frame('boarding_count', -24, -1)} AS b, {frame('boarding_count', 0, 23)} AS d FROM gridh) WHERE t_idx >= 168 AND len(d) = 24)
       GROUP BY 1)""",
)
ONE = "2024-01-15 12:00:00"
register(
    "multi_scale_window",
    "scale_type:s stop_id:s boardings:s states:s n:i",
    lambda t: seq.feature_window(features(t), ONE, ["boarding_count", "service_availability"]).select(
        "scale_type", "stop_id", F.array_join(F.col("boarding_count_sequence").cast("array<string>"), ",").alias("boardings"),
        F.array_join(F.col("service_availability_sequence").cast("array<string>"), ",").alias("states"), F.size("recorded_at_sequence").alias("n"),
    ),
    " UNION ALL ".join(
        f"""SELECT '{s}' AS scale_type, stop_id, string_agg(CAST(boarding_count AS VARCHAR), ',' ORDER BY recorded_at) AS boardings,
        string_agg(CAST(av AS VARCHAR), ',' ORDER BY recorded_at) AS states, count(*) AS n FROM feat
        WHERE recorded_at >= TIMESTAMP '{ONE}' - INTERVAL {lo} HOUR AND recorded_at < TIMESTAMP '{ONE}' - INTERVAL {hi} HOUR GROUP BY stop_id"""
        for s, lo, hi in (("hour", 6, 0), ("day", 24, 0), ("week", 192, 168))
    ),
)
register(
    "target_window",
    "stop_id:s probabilities:s",
    lambda t: seq.target_window(features(t), ONE).withColumn(
        "probabilities", F.array_join(F.transform("drt_probability_sequence", lambda x: x.cast("decimal(6,4)").cast("string")), ",")
    ),
    f"""SELECT stop_id, string_agg(CAST(CAST(round(p + 1e-10, 4) AS DECIMAL(6, 4)) AS VARCHAR), ',' ORDER BY recorded_at) AS probabilities FROM featp
       WHERE recorded_at >= TIMESTAMP '{ONE}' AND recorded_at < TIMESTAMP '{ONE}' + INTERVAL 24 HOUR GROUP BY stop_id""",
)
register(
    "timeseries_long",
    "stop_id:s stop_name:s hour_at:s boarding_count:i hour_of_day:i day_of_week:i is_weekend:b",
    lambda t: seq.timeseries_long(grid(t), t.stops),
    """SELECT stop_id, node_name AS stop_name, hour_at, boarding_count, hour(hour_at) AS hour_of_day, isodow(hour_at) - 1 AS day_of_week,
       isodow(hour_at) >= 6 AS is_weekend FROM gridh JOIN stops ON stop_id = node_id""",
)
register(
    "timeseries_sample",
    "stop_id:s hour_at:s boarding_count:i",
    lambda t: seq.timeseries_long(grid(t), t.stops, 10, 100),
    "SELECT stop_id, hour_at, boarding_count FROM gridh WHERE t_idx < 100 AND stop_id IN (SELECT DISTINCT stop_id FROM usage ORDER BY 1 LIMIT 10)",
)
register(
    "dataset_metadata",
    "num_nodes:i num_features:i num_timesteps:i first_hour:s last_hour:s",
    lambda t: seq.dataset_metadata(grid(t), ["boarding_count", "alighting_count"]),
    """SELECT count(DISTINCT stop_id) AS num_nodes, 2 AS num_features, max(t_idx) + 1 AS num_timesteps, min(hour_at) AS first_hour, max(hour_at) AS last_hour FROM gridh""",
)

# graph ----------------------------------------------------------------------------------------------
register(
    "stop_index",
    "stop_id:s node_idx:i",
    lambda t: graph.stop_index(t.stops.select(F.col("node_id").alias("stop_id"))),
    "SELECT node_id AS stop_id, row_number() OVER (ORDER BY node_id) - 1 AS node_idx FROM stops",
)
register(
    "value_counts_top",
    "stop_id:s recorded_at:s boarding_count:i",
    lambda t: graph.value_counts_top(t.usage),
    """SELECT stop_id, recorded_at, boarding_count FROM usage WHERE stop_id IN
       (SELECT stop_id FROM usage GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50)""",
)
register(
    "adjacency_complete",
    "src:s dst:s",
    lambda t: graph.adjacency_complete(t.usage),
    """WITH top AS (SELECT stop_id FROM usage GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50)
       SELECT a.stop_id AS src, b.stop_id AS dst FROM top AS a JOIN top AS b ON a.stop_id <> b.stop_id""",
)
register(
    "graph_stats",
    "edges:f1 mean_degree:f4 density:f6",
    lambda t: graph.graph_stats(t.grid_stops, graph.adjacency_distance(t.grid_stops, 3.0)),
    """SELECT count(*) / 2 AS edges, count(*) / (SELECT count(*) FROM grid_stops) AS mean_degree,
       count(*) / (SELECT count(*) FROM grid_stops) ** 2 AS density FROM edges3""",
)
register(
    "connected_components",
    "node_id:s component:s",
    lambda t: graph.connected_components(t.grid_stops, graph.adjacency_distance(t.grid_stops, 1.0)),
    "SELECT node_id, min(node_id) OVER (PARTITION BY CAST(node_id AS BIGINT) // 300) AS component FROM grid_stops",
)
LAP = "src:s dst:s weight:f6"
register(
    "normalized_laplacian_edges",
    LAP,
    lambda t: graph.normalized_laplacian_edges(t.grid_stops, graph.adjacency_distance(t.grid_stops, 1.0)),
    """WITH deg AS (SELECT node_id, greatest(count(src), 1) AS d FROM grid_stops LEFT JOIN edges1 ON node_id = src GROUP BY node_id)
       SELECT src, dst, -1 / sqrt(a.d * b.d) AS weight FROM edges1 JOIN deg AS a ON src = a.node_id JOIN deg AS b ON dst = b.node_id
       UNION ALL SELECT node_id, node_id, 1 FROM grid_stops""",
)
register(
    "laplacian_edges",
    LAP,
    lambda t: graph.laplacian_edges(t.grid_stops, graph.adjacency_distance(t.grid_stops, 1.0)),
    """SELECT src, dst, -1.0 AS weight FROM edges1 UNION ALL
       SELECT node_id, node_id, count(src) FROM grid_stops LEFT JOIN edges1 ON node_id = src GROUP BY node_id""",
)
