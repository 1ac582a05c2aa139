"""Sources, sinks, reshape and cleansing (survey sections 2.1 and 2.2).

Landed files are written from the given tables first, then read back by the operator.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.numbers import sum_if
from headway.operators import cleansing, od, reshape, views
from headway.operators.joins import one_row
from headway.plans.registry import define, register
from headway.plans.stored import ensure, monthly_views, store, stored
from headway.schemas import HH, KEYS, OD_CSV_COLUMNS, ROUTE_HEADERS, ROUTE_STOP_HEADERS, STATION_FEED, STOP_HEADERS
from headway.session import scratch
from headway.sources import files, stored_views, tables
from headway.sources.mapping import HOURS, MONTH, TransitTables


def pivoted(df, keys: dict, hour: str, measures: dict):
    """Wide feed rows from tall rows (keys: output name to input column)."""
    cells = [
        F.sum(F.when(F.col(hour) == h, F.col(src))).cast("string").alias(tpl.format(h=HH[h]))
        for tpl, src in measures.items()
        for h in range(24)
    ]
    return df.groupBy(*[F.col(s).cast("string").alias(d) for d, s in keys.items()]).agg(*cells)


def station_feed(t: TransitTables):
    wide = pivoted(
        t.sph,
        {"record_date": "record_date", "routeId": "route_id", "staId": "node_id"},
        "hour",
        {"a05Num{h}h": "dispatch_count", "ridePnsgerCnt{h}h": "ride_passenger", "alghPnsgerCnt{h}h": "alight_passenger"},
    )
    return wide.withColumns(
        {"routeNm": F.concat(F.lit("Line "), "routeId"), "staNm": F.concat(F.lit("Stop "), "staId"), "staSn": F.col("staId")}
    )


def section_feed(t: TransitTables):
    keys = {"record_date": "record_date", "routeId": "route_id", "fromStaId": "from_node_id", "toStaId": "to_node_id"}
    wide = pivoted(t.sections, keys, "hour", {"a18SumLoadPsngNum{h}h": "passenger_count"})
    total = sum(F.coalesce(F.col(f"a18SumLoadPsngNum{h}h").cast("long"), F.lit(0)) for h in HH)
    return wide.withColumns({"staSn": F.lit("1"), "a18SumLoadPsng": total.cast("string")})


def speed_feed(t: TransitTables):
    keys = {"record_date": "record_date", "routeId": "route_id", "fromStaId": "from_node_id", "toStaId": "to_node_id"}
    wide = pivoted(t.speeds, keys, "hour", {"tripTime{h}h": "trip_time"})
    return wide.withColumns({"fromStaSn": F.lit("1"), "toStaSn": F.lit("2")})


TALL = "record_date:s route_id:s node_id:s hour:i dispatch_count:i ride_passenger:i alight_passenger:i"
define(
    "talls",
    """SELECT g.*, coalesce(dispatch_count, 0) AS dispatch_count, coalesce(ride_passenger, 0) AS ride_passenger,
       coalesce(alight_passenger, 0) AS alight_passenger
       FROM (SELECT *, unnest(range(24)) AS hour FROM (SELECT DISTINCT record_date, route_id, node_id FROM sph)) AS g
       LEFT JOIN sph AS s ON g.record_date = s.record_date AND g.route_id = s.route_id AND g.node_id = s.node_id AND g.hour = s.hour""",
)
register("station_wide_to_tall", TALL, lambda t: reshape.station_wide_to_tall(station_feed(t)), "SELECT * FROM talls")
define(
    "tallsec",
    """SELECT g.*, passenger_count, sum(coalesce(passenger_count, 0)) OVER (PARTITION BY g.record_date, g.route_id, g.from_node_id, g.to_node_id) AS daily_total_passengers
       FROM (SELECT *, unnest(range(24)) AS hour FROM (SELECT DISTINCT record_date, route_id, from_node_id, to_node_id FROM sections)) AS g
       LEFT JOIN sections AS s ON g.record_date = s.record_date AND g.route_id = s.route_id AND g.from_node_id = s.from_node_id
         AND g.to_node_id = s.to_node_id AND g.hour = s.hour""",
)
register(
    "section_wide_to_tall",
    "record_date:s route_id:s from_node_id:s to_node_id:s hour:i passenger_count:i daily_total_passengers:i",
    lambda t: reshape.section_wide_to_tall(section_feed(t)),
    "SELECT * FROM tallsec",
)
SECTION = ["record_date", "route_id", "from_node_id", "to_node_id"]


def by_hour(tall):
    """One row per section with the hours that it has; sums by hour merge the rows of a section before they move."""
    sums = [F.sum(F.when(F.col("hour") == h, F.col("trip_time"))).alias(f"_{h}") for h in range(24)]
    cells = [F.concat(F.lit(f"{h}="), F.col(f"_{h}").cast("string")) for h in range(24)]
    return tall.groupBy(*SECTION).agg(*sums).select(*SECTION, F.concat_ws(",", *cells).alias("trip_times"))


register(
    "speed_wide_to_tall",
    "record_date:s route_id:s from_node_id:s to_node_id:s trip_times:s",
    lambda t: by_hour(reshape.speed_wide_to_tall(speed_feed(t))),
    """SELECT record_date, route_id, from_node_id, to_node_id, string_agg(hour || '=' || trip_time, ',' ORDER BY hour) AS trip_times FROM (
         SELECT g.*, coalesce(sum(s.trip_time), 0) AS trip_time
         FROM (SELECT *, unnest(range(24)) AS hour FROM (SELECT DISTINCT record_date, route_id, from_node_id, to_node_id FROM speeds)) AS g
         LEFT JOIN speeds AS s USING (record_date, route_id, from_node_id, to_node_id, hour) GROUP BY ALL)
       GROUP BY record_date, route_id, from_node_id, to_node_id""",
)
register(
    "od_api_to_table",
    "record_date:s start_district:s end_district:s total_passenger_count:i",
    lambda t: reshape.od_api_to_table(
        t.dong_od.groupBy("record_date", "start_district", "end_district").agg(F.sum("total_passenger_count").alias("n")).select(
            F.col("record_date").cast("string").alias("record_date"),
            F.col("start_district").alias("startSggNm"), F.lit("").alias("startEmdNm"),
            F.col("end_district").alias("endSggNm"), F.lit("").alias("endEmdNm"),
            F.when(F.col("n") % 10 != 0, F.col("n").cast("string")).alias("totPsngNum"),
        )
    ),
    """SELECT record_date, start_district, end_district, CASE WHEN n % 10 = 0 THEN 0 ELSE n END AS total_passenger_count
       FROM (SELECT record_date, start_district, end_district, sum(total_passenger_count) AS n FROM dong_od GROUP BY ALL)""",
)
register(
    "dedupe_keep_first",
    "user_id:i event_type:s hour:i event_id:i v:i",
    lambda t: reshape.dedupe_keep_first(t.ev.select("user_id", "event_type", "hour", "v", "event_id"), ["user_id", "event_type", "hour"], "event_id"),
    """SELECT user_id, event_type, hour, min(event_id) AS event_id, arg_min(v, event_id) AS v FROM ev GROUP BY ALL""",
)
register(
    "duplicate_key_report",
    "user_id:i event_type:s hour:i n:i",
    lambda t: reshape.duplicate_key_report(t.ev, ["user_id", "event_type", "hour"])[1],
    "SELECT user_id, event_type, hour, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1",
)
register(
    "duplicate_key_totals",
    "total_keys:i unique_keys:i repeated_keys:i",
    lambda t: reshape.duplicate_key_report(t.ev, ["user_id", "event_type", "hour"])[0],
    """SELECT sum(n) AS total_keys, count(*) AS unique_keys, count(*) FILTER (n > 1) AS repeated_keys
       FROM (SELECT count(*) AS n FROM ev GROUP BY user_id, event_type, hour)""",
)

# master data --------------------------------------------------------------------------------


def raw_stops(t):
    """Stop master rows with repeats, blanks and unreadable coordinates."""
    k = F.col("c_custkey")
    return t.raw("customer").select(
        (k - F.when(k % 50 == 49, 1).otherwise(0)).cast("string").alias("node_id"),
        F.col("c_name").alias("node_name"),
        F.when(k % 3 != 0, F.col("c_mktsegment")).alias("node_description"),
        F.when(k % 4 != 0, k.cast("string")).alias("node_num"),
        F.when(k % 6 == 0, "?").otherwise((k % 5).cast("string")).alias("node_type"),
        F.when(k % 13 == 0, "n/a").otherwise(F.format_string("%d.5", k % 180)).alias("coordinates_x"),
        F.format_string("%d.25", k % 90).alias("coordinates_y"),
        F.when(k % 5 == 0, "1.5").alias("mapping_x"),
        F.lit(None).cast("string").alias("mapping_y"),
        F.lit("1").alias("is_standard"),
        F.when(k % 17 == 0, "false").otherwise("true").alias("is_active"),
        k.alias("seq"),
    )


define(
    "cleanstops",
    """SELECT id AS node_id, c_name AS node_name, CASE WHEN k % 3 <> 0 THEN c_mktsegment ELSE '' END AS node_description,
       CASE WHEN k % 4 <> 0 THEN CAST(k AS VARCHAR) ELSE '' END AS node_num, CASE WHEN k % 6 = 0 THEN 0 ELSE k % 5 END AS node_type,
       k % 180 + 0.5 AS coordinates_x, k % 90 + 0.25 AS coordinates_y, CASE WHEN k % 5 = 0 THEN 1.5 ELSE k % 180 + 0.5 END AS mapping_x,
       k % 90 + 0.25 AS mapping_y, k % 17 <> 0 AS is_active
       FROM (SELECT *, c_custkey AS k, CAST(c_custkey - CASE WHEN c_custkey % 50 = 49 THEN 1 ELSE 0 END AS VARCHAR) AS id,
             row_number() OVER (PARTITION BY c_custkey - CASE WHEN c_custkey % 50 = 49 THEN 1 ELSE 0 END ORDER BY c_custkey) AS r FROM customer)
       WHERE r = 1 AND k % 13 <> 0""",
)
register(
    "clean_stops",
    "node_id:s node_name:s node_description:s node_num:s node_type:i coordinates_x:f4 coordinates_y:f4 mapping_x:f4 mapping_y:f4 is_active:b",
    lambda t: cleansing.clean_stops(raw_stops(t), "seq"),
    "SELECT * FROM cleanstops",
)


def raw_routes(t):
    k = F.col("p_partkey")
    frac = lambda n: F.when(k % n != 0, (k % 1440 + 0.5) / 1440.0).cast("string")
    return t.raw("part").select(
        (k % 500).cast("string").alias("route_id"),
        F.when(k % 7 != 0, F.col("p_name")).alias("route_name"),
        F.when(k % 9 == 0, "x").otherwise((k % 8 + 1).cast("string")).alias("route_type"),
        F.when(k % 4 != 0, F.format_string("%d.5", F.col("p_size"))).alias("total_distance"),
        F.when(k % 10 == 0, "false").otherwise("true").alias("is_operating"),
        F.lit(None).cast("string").alias("curvature"),
        (k % 60).cast("string").alias("max_speed"),
        *[frac(i + 3).alias(c) for i, c in enumerate(cleansing.TIME_COLUMNS)],
        *[F.when(k % (i + 2) != 0, (k % 50 + i).cast("string")).alias(c) for i, c in enumerate(cleansing.INTERVAL_COLUMNS)],
        k.alias("seq"),
    )


def routes_sql() -> str:
    times = ", ".join(
        f"CASE WHEN k % {i + 3} <> 0 AND k % 1440 > 0 THEN printf('%02d:%02d:00', (k % 1440) // 60, (k % 1440) % 60) "
        f"WHEN k % {i + 3} <> 0 THEN '00:00:00' END AS {c}"
        for i, c in enumerate(cleansing.TIME_COLUMNS)
    )
    waits = ", ".join(f"CASE WHEN k % {i + 2} <> 0 THEN k % 50 + {i} ELSE 0 END AS {c}" for i, c in enumerate(cleansing.INTERVAL_COLUMNS))
    return f"""SELECT CAST(k AS VARCHAR) AS route_id, CASE WHEN k % 7 <> 0 THEN p_name ELSE '' END AS route_name,
       CASE WHEN k % 9 = 0 THEN 0 ELSE k % 8 + 1 END AS route_type, CASE WHEN k % 4 <> 0 THEN p_size + 0.5 END AS total_distance,
       k % 10 <> 0 AS is_operating, 0.0 AS curvature, k % 60 AS max_speed, {times}, {waits}
       FROM (SELECT *, p_partkey AS k FROM part) WHERE k < 500"""


define("cleanroutes", routes_sql())
register(
    "clean_routes",
    "route_id:s route_name:s route_type:i total_distance:f2 is_operating:b weekday_first_time:s holiday_last_time:s "
    "weekday_interval:i max_interval:i curvature:f1 max_speed:f1",
    lambda t: (lambda c: c["routes"].join(c["schedules"], "route_id").join(c["details"], "route_id"))(cleansing.clean_routes(raw_routes(t), "seq")),
    "SELECT * FROM cleanroutes",
)
register(
    "day_fraction_to_time",
    "p_partkey:i clock:s",
    lambda t: t.raw("part").select("p_partkey", cleansing.day_fraction_to_time((F.col("p_partkey") % 3000 + 0.5) / 1440.0).alias("clock")),
    "SELECT p_partkey, printf('%02d:%02d:00', (p_partkey % 3000) // 60 % 24, (p_partkey % 3000) % 60) AS clock FROM part",
)
register(
    "dong_from_full_name",
    "p_partkey:i dong:s",
    lambda t: t.raw("part").select("p_partkey", cleansing.dong_from_full_name(
        F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_name", F.col("p_brand"))).otherwise(F.col("p_name"))).alias("dong")),
    """SELECT p_partkey, CASE WHEN len(string_split(n, ' ')) >= 3 THEN string_split(n, ' ')[3] ELSE n END AS dong
       FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || p_brand ELSE p_name END AS n FROM part)""",
)


def raw_route_stops(t):
    l = t.raw("lineitem")
    return l.select(
        F.when(F.col("l_orderkey") % 97 != 0, (F.col("l_partkey") % 700).cast("string")).alias("route_id"),
        (F.col("l_orderkey") % 2000).cast("string").alias("stop_id"),
        F.when(F.col("l_linenumber") == 7, "end").otherwise((F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).cast("string")).alias("node_sequence"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
    )


def master(t, rows, headers):
    """Rows written as a CSV with a byte-order mark and foreign headers, and read back."""
    path = scratch(t.spark, "master")
    foreign = {column: header for header, column in headers.items() if column in rows.columns}
    df = rows.select(*[F.col(c).alias(h) for c, h in foreign.items()])
    df.withColumnRenamed(df.columns[0], files.BOM + df.columns[0]).write.option("header", True).csv(path)
    return files.read_csv_bom(t.spark, path, headers)


def masters(t):
    """The three master files; each row shows its key and three more columns."""
    given = {
        "stops": (raw_stops(t), STOP_HEADERS, ("node_id", "node_name", "node_description", "mapping_x")),
        "routes": (raw_routes(t), ROUTE_HEADERS, ("route_id", "route_name", "max_speed", "total_distance")),
        "route_stops": (raw_route_stops(t).withColumn("is_active", F.lit("true")), ROUTE_STOP_HEADERS, ("route_id", "stop_id", "node_sequence", "is_active")),
    }
    shown = [
        master(t, rows, headers).select(F.lit(name).alias("file"), *[F.col(c).alias(n) for n, c in zip(("id", "a", "b", "c"), columns)])
        for name, (rows, headers, columns) in given.items()
    ]
    return reduce(DataFrame.unionByName, shown)


register(
    "read_csv_bom",
    "file:s id:s a:s b:s c:s",
    masters,
    """SELECT 'stops' AS file, CAST(k - CASE WHEN k % 50 = 49 THEN 1 ELSE 0 END AS VARCHAR) AS id, c_name AS a, CASE WHEN k % 3 <> 0 THEN c_mktsegment END AS b,
         CASE WHEN k % 5 = 0 THEN '1.5' END AS c FROM (SELECT *, c_custkey AS k FROM customer)
       UNION ALL SELECT 'routes', CAST(k % 500 AS VARCHAR), CASE WHEN k % 7 <> 0 THEN p_name END, CAST(k % 60 AS VARCHAR), CASE WHEN k % 4 <> 0 THEN p_size || '.5' END
       FROM (SELECT *, p_partkey AS k FROM part)
       UNION ALL SELECT 'route_stops', CASE WHEN l_orderkey % 97 <> 0 THEN CAST(l_partkey % 700 AS VARCHAR) END, CAST(l_orderkey % 2000 AS VARCHAR),
         CASE WHEN l_linenumber = 7 THEN 'end' ELSE CAST(l_linenumber * 10 + l_suppkey % 10 AS VARCHAR) END, 'true' FROM lineitem""",
)
define(
    "cleanroutestops",
    """SELECT route_id, stop_id, node_sequence FROM (
         SELECT l_partkey % 700 AS route_id, l_orderkey % 2000 AS stop_id, l_linenumber * 10 + l_suppkey % 10 AS node_sequence,
         row_number() OVER (PARTITION BY l_partkey % 700, l_linenumber * 10 + l_suppkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r
         FROM lineitem WHERE l_linenumber <> 7 AND l_orderkey % 97 <> 0) WHERE r = 1
       AND CAST(stop_id AS VARCHAR) IN (SELECT node_id FROM stops WHERE is_active) AND route_id IN (SELECT p_partkey % 500 FROM part)""",
)
register(
    "clean_route_stops",
    "route_id:s stop_id:s node_sequence:i",
    lambda t: cleansing.clean_route_stops(raw_route_stops(t), t.stops, cleansing.clean_routes(raw_routes(t), "seq")["routes"], "seq"),
    "SELECT * FROM cleanroutestops",
)


def known_routes(t):
    types = t.sph.select("route_id").distinct()
    return types.filter("route_id IN ('click', 'view')").withColumn("route_name", F.lit("")).unionByName(
        types.filter("route_id = 'error'").select(F.lit("none").alias("route_id"), F.concat(F.lit("Line "), "route_id").alias("route_name"))
    )


def known_feed(t):
    """The rows that stay, each with the counts before and after."""
    feed = station_feed(t)
    kept = cleansing.filter_known_routes(feed, known_routes(t))
    counts = one_row(cleansing.filter_counts(feed, kept), "fetched", "kept")
    return kept.select("record_date", F.col("routeId").alias("route_id"), F.col("staId").alias("node_id"), counts.alias("c")).select("*", "c.*")


register(
    "filter_known_routes",
    "record_date:s route_id:s node_id:s fetched:i kept:i",
    known_feed,
    """SELECT *, count(*) OVER () AS kept FROM (SELECT *, count(*) OVER () AS fetched FROM (SELECT DISTINCT record_date, route_id, node_id FROM sph))
       WHERE route_id IN ('click', 'view', 'error')""",
)
register(
    "authorized_route_names",
    "route_name:s",
    lambda t: cleansing.authorized_route_names(t.raw("part").select(F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("route_name"))),
    "SELECT DISTINCT p_name AS route_name FROM part",
)


def route_info(t):
    return t.raw("part").select(
        F.col("p_partkey").alias("route_id"), F.concat_ws(" ", "p_name", "p_brand").alias("route_name"),
        (F.col("p_size") % 8 + 1).alias("route_type"), F.col("p_partkey").alias("seq"),
    )


def route_nodes(t):
    return t.raw("lineitem").select(F.col("l_partkey").alias("route_id"), F.col("l_suppkey").alias("node_id")).distinct()


def node_info(t):
    return t.raw("supplier").select(F.col("s_suppkey").alias("node_id"), "s_name")


define(
    "keptroutes",
    """SELECT arg_min(p_partkey, p_partkey) AS route_id, p_name || ' ' || p_brand AS route_name, arg_min(p_size % 8 + 1, p_partkey) AS route_type
       FROM part WHERE p_size % 8 + 1 <> 8 GROUP BY p_name || ' ' || p_brand""",
)
define("keptnodes", "SELECT DISTINCT l_partkey AS route_id, l_suppkey AS node_id FROM lineitem WHERE l_partkey IN (SELECT route_id FROM keptroutes)")
register("filter_route_type", "route_id:i route_name:s route_type:i", lambda t: cleansing.filter_route_type(route_info(t), "seq"), "SELECT * FROM keptroutes")
register(
    "route_type_counts",
    "route_type:i routes:i",
    lambda t: cleansing.route_type_counts(route_info(t)),
    "SELECT p_size % 8 + 1 AS route_type, count(*) AS routes FROM part WHERE p_size % 8 + 1 <> 8 GROUP BY 1",
)


def kept_nodes(t):
    return cleansing.filter_route_nodes(route_nodes(t), cleansing.filter_route_type(route_info(t), "seq"))


register("filter_route_nodes", "route_id:i node_id:i", kept_nodes, "SELECT * FROM keptnodes")
register(
    "filter_node_info",
    "node_id:i s_name:s",
    lambda t: cleansing.filter_node_info(node_info(t), kept_nodes(t)),
    "SELECT s_suppkey AS node_id, s_name FROM supplier WHERE s_suppkey IN (SELECT node_id FROM keptnodes)",
)
register(
    "filter_summary",
    "item:s kept:i",
    lambda t: cleansing.filter_summary(cleansing.filter_route_type(route_info(t), "seq"), kept_nodes(t), cleansing.filter_node_info(node_info(t), kept_nodes(t))),
    """SELECT 'routes' AS item, count(*) AS kept FROM keptroutes UNION ALL SELECT 'nodes', count(DISTINCT node_id) FROM keptnodes
       UNION ALL SELECT 'stops', count(*) FROM supplier WHERE s_suppkey IN (SELECT node_id FROM keptnodes)""",
)

# file sources -----------------------------------------------------------------------------------


def od_files(t):
    path = scratch(t.spark, "od")
    wide = t.od_wide.select(
        F.date_format("record_date", "yyyyMMdd").alias("file_date"),
        F.col("from_station_id").alias(OD_CSV_COLUMNS[0]), F.col("to_station_id").alias(OD_CSV_COLUMNS[1]), F.col("cnt").alias("CNT"),
        *[F.when(F.col(HOURS[h]) > 0, F.col(HOURS[h])).alias(OD_CSV_COLUMNS[3 + h]) for h in range(24)],
    )
    wide.hint("rebalance", "file_date").write.partitionBy("file_date").option("header", True).csv(path)
    return path


register(
    "read_od_csv",
    "record_date:s from_station_id:s to_station_id:s cnt:i " + " ".join(f"{h}:i" for h in HOURS),
    lambda t: files.read_od_csv(t.spark, od_files(t)),
    "SELECT * FROM od_wide",
)


def station_pages(t):
    """Landed station pages: nested pages for even stops, bare rows for odd ones."""
    path = scratch(t.spark, "station-pages")
    feed = station_feed(t).select(*STATION_FEED.fieldNames())
    even = F.col("staId").cast("long") % 2 == 0
    pages = (
        feed.filter(even).groupBy("record_date", "staId").agg(F.collect_list(F.struct(*feed.columns)).alias("row"))
        .select(F.to_json(F.struct(F.struct("row").alias("stationPassenger"))).alias("value"))
    )
    pages.unionByName(feed.filter(~even).select(F.to_json(F.struct(*feed.columns)).alias("value"))).write.text(path)
    return path


register(
    "read_api_json",
    TALL,
    lambda t: reshape.station_wide_to_tall(files.read_api_json(t.spark, station_pages(t), "stationPassenger", STATION_FEED)),
    "SELECT * FROM talls",
)


def geojson_files(t):
    path = scratch(t.spark, "geojson")
    ring = lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["lon"], v["lat"])))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            "adm_cd", F.col("adm_cd").alias("adm_cd2"), "adm_nm", F.col("sggnm").alias("sgg"), F.lit("11").alias("sido"),
            F.when(F.col("adm_cd").cast("int") % 5 == 4, "other").otherwise("서울특별시").alias("sidonm"), "sggnm",
        ).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.transform("polygons", ring).alias("coordinates")).alias("geometry"),
    )
    (
        t.boundaries.groupBy("sggnm").agg(F.collect_list(feature).alias("features"))
        .select("sggnm", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
        .repartition("sggnm").write.partitionBy("sggnm").text(path)
    )
    return path + "/*"


register(
    "read_geojson",
    "adm_cd:s adm_nm:s sggnm:s admin_dong_name:s rings:i x0:f3 y0:f3 x1:f3 y1:f3",
    lambda t: files.read_geojson(t.spark, geojson_files(t)).withColumns(
        {
            "rings": F.size(F.flatten("polygons")),
            **{k: pick(F.flatten(F.flatten("polygons")).getField(c)) for k, pick, c in
               (("x0", F.array_min, "lon"), ("y0", F.array_min, "lat"), ("x1", F.array_max, "lon"), ("y1", F.array_max, "lat"))},
        }
    ),
    """SELECT adm_cd, adm_nm, sggnm, string_split(adm_nm, ' ')[3] AS admin_dong_name, 1 AS rings, x0, y0, x1, y1
       FROM boundaries WHERE CAST(adm_cd AS INTEGER) % 5 <> 4""",
)


def geo_texts(t):
    """One GeoJSON-like text per customer, in six shapes."""
    k = F.col("c_custkey")
    coords = F.format_string("[%d.5,%d.25]", k % 180, k % 90)
    point = F.concat(F.lit('{"type":"Point","coordinates":'), coords, F.lit("}"))
    bare = F.lit('{"type":"Feature","properties":{"a":1},"geometry":null}')
    feature = F.concat(F.lit('{"type":"Feature","properties":{"k":'), k.cast("string"), F.lit('},"geometry":'), point, F.lit("}"))
    untyped = F.concat(F.lit('{"geometry":'), point, F.lit("}"))
    text = (
        F.when(k % 6 == 0, F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit(","), bare, F.lit("]}")))
        .when(k % 6 == 1, feature).when(k % 6 == 2, point)
        .when(k % 6 == 3, F.concat(F.lit("["), point, F.lit(","), untyped, F.lit(","), feature, F.lit("]")))
        .when(k % 6 == 4, F.concat(F.lit('{"features":['), untyped, F.lit("]}")))
        .otherwise(F.lit('{"note":"nothing here"}'))
    )
    return t.raw("customer").select("c_custkey", text.alias("text"))


register(
    "normalize_geojson",
    "c_custkey:i feature_idx:i geometry_type:s coordinates:s",
    lambda t: files.normalize_geojson(geo_texts(t), "text", "c_custkey"),
    """SELECT c_custkey, feature_idx, 'Point' AS geometry_type, '[' || (c_custkey % 180) || '.5,' || (c_custkey % 90) || '.25]' AS coordinates
       FROM (SELECT c_custkey, unnest(CASE c_custkey % 6 WHEN 3 THEN [0, 1, 2] WHEN 5 THEN CAST([] AS INTEGER[]) ELSE [0] END) AS feature_idx FROM customer)""",
)
register(
    "validate_geojson",
    "c_custkey:i valid:b errors:s",
    lambda t: files.validate_geojson(geo_texts(t), "text").withColumn("errors", F.array_join("errors", ";")),
    """SELECT c_custkey, c_custkey % 6 <> 5 AS valid, CASE WHEN c_custkey % 6 = 5 THEN 'No valid features found' ELSE '' END AS errors FROM customer""",
)


#: Files of one folder: more folders than 32 are listed by a job.
FOLDER_FILES = 1000


def text_files(t):
    """One file per document, as they would be landed.

    Tasks write them one by one: a writer of Spark costs several processes a file on a local file system.
    """
    path = scratch(t.spark, "texts")

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for text in batch.column(0):
                folder = f"{root}/part-{part:05d}-{n // FOLDER_FILES:05d}"
                if n % FOLDER_FILES == 0:
                    system.create_dir(folder)
                with system.open_output_stream(f"{folder}/{n % FOLDER_FILES:05d}.txt") as out:
                    out.write(text.as_py().encode() + b"\n")
                n += 1
        yield pa.record_batch([pa.array([n])], ["files"])

    t.raw("documents").filter("length(text) > 0").select("text").mapInArrow(land, "files long").agg(F.sum("files")).collect()
    return path


register(
    "read_text_docs",
    "digest:s file_type:s n_chars:i",
    lambda t: files.read_text_docs(t.spark, text_files(t)).select(
        "file_type",
        F.md5(F.regexp_replace("text", "\\n$", "")).alias("digest"),
        (F.length("text") - 1).alias("n_chars"),
    ),
    "SELECT md5(text) AS digest, 'txt' AS file_type, length(text) AS n_chars FROM documents WHERE length(text) > 0",
)

# sinks ----------------------------------------------------------------------------------------------


def twice(df, again, measure):
    """A first load of all rows and a second load that replaces some of them."""
    first = df.withColumn(tables.SEQ, F.lit(1))
    second = df.filter(again).withColumn(measure, F.col(measure) + 1000).withColumn(tables.SEQ, F.lit(2))
    return first, second


def register_upsert(key, build, measure, again, sql):
    """All rows after the two loads, next to SQL that states them row by row."""
    keys = KEYS[key]

    def plan(t):
        path = scratch(t.spark, f"upsert-{key}")
        first, second = twice(build(t), again, measure)
        tables.upsert(t.spark, path, first, keys, "record_date", fresh=True)
        return tables.upsert(t.spark, path, second, keys, "record_date", fresh=True)

    spec = " ".join(f"{k}:{'i' if k == 'hour' else 's'}" for k in keys)
    register(
        f"upsert_{key}",
        f"{spec} {measure}:i {tables.SEQ}:i",
        plan,
        f"""SELECT {', '.join(keys)}, {measure} + CASE WHEN {again} THEN 1000 ELSE 0 END AS {measure}, CASE WHEN {again} THEN 2 ELSE 1 END AS {tables.SEQ}
       FROM ({sql})""",
    )


def speed_facts(t):
    """One month of dates keeps the number of partition folders small; rows of all dates are used."""
    month = F.to_date(F.concat(F.lit("2024-01-"), F.format_string("%02d", F.dayofmonth("record_date"))))
    return t.speeds.withColumn("record_date", month).groupBy(*KEYS["speed"]).agg(F.max("trip_time").alias("trip_time"))


def dong_facts(t):
    month = F.to_date(F.concat(F.lit("2024-01-"), F.format_string("%02d", F.dayofmonth("record_date"))))
    return (
        t.dong_od.withColumns({"record_date": month, "start_admin_dong": F.lit(""), "end_admin_dong": F.lit("")})
        .groupBy(*KEYS["od"]).agg(F.sum("total_passenger_count").alias("total_passenger_count"))
    )


register_upsert("station", lambda t: t.sph, "ride_passenger", "hour % 3 = 0", "SELECT * FROM sph")
register_upsert("section", lambda t: t.sections, "passenger_count", "hour % 3 = 0", "SELECT * FROM sections")
register_upsert(
    "speed", speed_facts, "trip_time", "hour % 3 = 0",
    """SELECT make_date(2024, 1, day(record_date)) AS record_date, route_id, from_node_id, to_node_id, hour, max(trip_time) AS trip_time FROM speeds GROUP BY ALL""",
)
register_upsert(
    "od", dong_facts, "total_passenger_count", "start_district < end_district",
    """SELECT make_date(2024, 1, day(record_date)) AS record_date, start_district, '' AS start_admin_dong, end_district, '' AS end_admin_dong,
         sum(total_passenger_count) AS total_passenger_count FROM dong_od GROUP BY ALL""",
)


def dims_twice(t):
    """Five dimension tables, loaded in whole and then again in part with other values."""
    masters = cleansing.clean_routes(raw_routes(t), "seq")
    line = F.col("route_id").cast("int") % 3 == 0
    changes = {
        "stops": (t.stops, F.col("is_active"), "node_name", F.concat("node_name", F.lit("*"))),
        "routes": (masters["routes"], line, "route_name", F.concat("route_name", F.lit("*"))),
        "schedules": (masters["schedules"], line, "weekday_interval", F.col("weekday_interval") + 1),
        "details": (masters["details"], line, "max_speed", F.col("max_speed") + 1),
        "route_stops": (cleansing.clean_route_stops(raw_route_stops(t), t.stops, masters["routes"], "seq").drop("seq"), line, "stop_id", F.concat("stop_id", F.lit("*"))),
    }
    parts = []
    for name, (rows, again, column, value) in changes.items():
        path, keys = scratch(t.spark, f"dim-{name}"), KEYS[name]
        first = rows.withColumns({"bucket": F.pmod(F.xxhash64(*keys), F.lit(8)), tables.SEQ: F.lit(1)})
        tables.upsert(t.spark, path, first, keys, "bucket")
        after = tables.upsert(t.spark, path, first.filter(again).withColumns({column: value, tables.SEQ: F.lit(2)}), keys, "bucket")
        parts.append(after.select(F.lit(name).alias("table"), F.concat_ws("|", *keys).alias("key"), F.col(column).cast("string").alias("value"), tables.SEQ))
    return reduce(DataFrame.unionByName, parts)


def dim_sql(name, key, again, before, after, source):
    return f"""SELECT '{name}' AS "table", {key} AS key, CAST(CASE WHEN {again} THEN {after} ELSE {before} END AS VARCHAR) AS value,
       CASE WHEN {again} THEN 2 ELSE 1 END AS load_seq FROM {source}"""


THIRD = "CAST(route_id AS INTEGER) % 3 = 0"
register(
    "upsert_dims",
    "table:s key:s value:s load_seq:i",
    dims_twice,
    " UNION ALL ".join(
        [
            dim_sql("stops", "node_id", "is_active", "node_name", "node_name || '*'", "stops"),
            dim_sql("routes", "route_id", THIRD, "route_name", "route_name || '*'", "cleanroutes"),
            dim_sql("schedules", "route_id", THIRD, "weekday_interval", "weekday_interval + 1", "cleanroutes"),
            dim_sql("details", "route_id", THIRD, "printf('%.1f', max_speed::DOUBLE)", "printf('%.1f', max_speed::DOUBLE + 1)", "cleanroutes"),
            dim_sql("route_stops", "route_id || '|' || node_sequence", THIRD, "CAST(stop_id AS VARCHAR)", "stop_id || '*'", "cleanroutestops"),
        ]
    ),
)
NOW = dt.datetime(2024, 2, 1, 12, 0)


def population(t):
    """Cached counts per (district code, hour) with 28 age and sex groups, some long expired."""
    k = F.col("o_custkey")
    groups = [f"{s}_{a}" for s in ("male", "female") for a in ("0_9", *[f"{x}_{x + 4}" for x in range(10, 70, 5)], "70_plus")]
    base = t.raw("orders").groupBy((k % 400).cast("string").alias("admin_dong_code"), (F.col("o_orderkey") % 24).cast("int").alias("time_zone")).agg(
        F.count(F.lit(1)).alias("total_population"), *[F.count(F.when(F.col("o_orderkey") % 28 == i, 1)).alias(g) for i, g in enumerate(groups)]
    )
    age = F.col("time_zone")
    at = F.lit(NOW) - F.make_dt_interval(F.lit(0), age * 2)
    return base.withColumns({"cached_at": at, "expires_at": at + F.expr("INTERVAL 1 HOUR")})


define(
    "popcache",
    """SELECT CAST(o_custkey % 400 AS VARCHAR) AS admin_dong_code, o_orderkey % 24 AS time_zone, count(*) AS total_population,
       count(*) FILTER (o_orderkey % 28 = 0) AS male_0_9, TIMESTAMP '2024-02-01 12:00:00' - to_hours(2 * (o_orderkey % 24)) AS cached_at
       FROM orders GROUP BY ALL""",
)


def refreshed(t):
    cache = population(t)
    new = cache.filter("time_zone < 6").withColumn("total_population", F.col("total_population") + 1).drop("cached_at", "expires_at")
    return tables.upsert_population(cache, new, KEYS["population"], NOW + dt.timedelta(hours=1))


register(
    "upsert_population",
    "admin_dong_code:s time_zone:i total_population:i male_0_9:i hours_left:i",
    lambda t: refreshed(t).withColumn("hours_left", F.round((F.unix_timestamp("expires_at") - F.unix_timestamp(F.lit(NOW))) / 3600)),
    """SELECT admin_dong_code, time_zone, total_population + CASE WHEN time_zone < 6 THEN 1 ELSE 0 END AS total_population, male_0_9,
       CASE WHEN time_zone < 6 THEN 2 ELSE 1 - 2 * time_zone END AS hours_left FROM popcache""",
)
register(
    "purge_expired",
    "item:s n:i",
    lambda t: (lambda kept, gone: kept.agg(F.count(F.lit(1)).alias("n")).withColumn("item", F.lit("kept")).unionByName(
        gone.select(F.col("deleted").alias("n"), F.lit("deleted").alias("item"))))(*tables.purge_expired(population(t), NOW)),
    """SELECT CASE WHEN cached_at + INTERVAL 1 HOUR < TIMESTAMP '2024-01-31 12:00:00' THEN 'deleted' ELSE 'kept' END AS item, count(*) AS n
       FROM popcache GROUP BY 1""",
)


FEBRUARY = "2024-02-01"
SCORE_TABLES = ("commuter_scores", "tourism_scores", "vulnerable_scores")


def month_twice(t):
    """Load January and February of all score tables and the OD summary, then replace January only."""
    views_ = stored_views.MonthlyViews(t.spark, scratch(t.spark, "replaced"), "replaced_" + uuid.uuid4().hex[:12], monthly_views(t))
    names = (*SCORE_TABLES, "monthly_od_summary")
    ensure(t, names)
    january = {name: stored(t, name) for name in names}
    half = {name: "appearance_days % 2 = 0" if name == "monthly_od_summary" else "hour_of_day < 12" for name in names}
    february = {name: rows.withColumn("analysis_month", F.lit(FEBRUARY).cast("date")) for name, rows in january.items()}
    views_.replace_all({(name, MONTH): rows for name, rows in january.items()} | {(name, FEBRUARY): rows for name, rows in february.items()})
    views_.replace_all({(name, MONTH): rows.filter(half[name]) for name, rows in january.items()})
    parts = []
    for name in names:
        rows = views_.read(name)
        if name == "monthly_od_summary":
            rows = rows.select(F.concat_ws("-", "from_station_id", "to_station_id").alias("key"), F.lit(0).alias("hour"), F.col("drt_priority_score").alias("score"), "analysis_month")
        else:
            rows = rows.select(F.col("station_id").alias("key"), F.col("hour_of_day").alias("hour"), F.col("total_drt_score").alias("score"), "analysis_month")
        parts.append(rows.withColumn("table", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def two_months(select, half):
    return f"""SELECT DATE '2024-01-01' AS analysis_month, * FROM ({select}) WHERE {half} UNION ALL SELECT DATE '2024-02-01', * FROM ({select})"""


register(
    "replace_month",
    "table:s analysis_month:s key:s hour:i score:f4",
    month_twice,
    " UNION ALL ".join(
        two_months(f"SELECT '{m}_scores' AS \"table\", station_id AS key, hour_of_day AS hour, total_drt_score AS score FROM {m}", "hour < 12")
        for m in ("commuter", "tourism", "vulnerable")
    )
    + """ UNION ALL SELECT m.analysis_month, 'monthly_od_summary' AS "table", from_station_id || '-' || to_station_id AS key, 0 AS hour, drt_priority_score AS score
       FROM odmonth CROSS JOIN (VALUES (DATE '2024-01-01'), (DATE '2024-02-01')) AS m(analysis_month)
       WHERE odmonth.analysis_month = DATE '2024-01-01' AND (m.analysis_month = DATE '2024-02-01' OR appearance_days % 2 = 0)""",
)


def loaded_od(t):
    daily = od.daily_od_build(t.od_wide, t.od_stops, od.collect_routes_per_stop(t.route_stops, t.routes))
    return tables.bulk_load_od(daily, scratch(t.spark, "daily-od"))


register(
    "bulk_load_od",
    "analysis_date:s from_station_id:s to_station_id:s cnt:i common:i",
    lambda t: loaded_od(t).withColumn("common", F.json_array_length("common_routes")),
    "SELECT record_date AS analysis_date, from_station_id, to_station_id, cnt, n_common AS common FROM odday",
)


def job_log(t):
    """A load job per day with two runs of three steps, each step logged as it ends. The second run of every
    seventh day fails in step 2, and step 2 is logged twice, as if it had been tried again."""
    path = scratch(t.spark, "job-log")
    day = t.ev.groupBy("record_date").agg(F.count(F.lit(1)).alias("n"), sum_if(F.col("v") > 0, F.lit(1)).alias("positive"))
    runs = day.withColumn("no", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("broken", (F.col("no") == 2) & (F.dayofmonth("record_date") % 7 == 0))

    def logged(step, minutes, status, read, written, message):
        at = F.col("record_date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("no"), F.lit(minutes))
        return [
            F.concat(F.lit("load-"), F.col("record_date").cast("string")).alias("job"), F.concat(F.lit("run-"), F.col("no").cast("string")).alias("run"),
            F.lit(step).alias("step"), status.alias("status"), at.alias("logged_at"), read.cast("long").alias("rows_read"), written.cast("long").alias("rows_written"), message.alias("message"),
        ]

    none, going = F.lit(0), F.when(F.col("broken"), "FAILED").otherwise("RUNNING")
    said = F.when(F.col("broken"), "step 2 stopped").otherwise("")
    tables.log_steps(path, runs.select(*logged(1, 5, F.lit("RUNNING"), F.col("n"), none, F.lit(""))))
    tables.log_steps(path, runs.select(*logged(2, 10, F.lit("FAILED"), none, none, F.lit("first try"))))
    tables.log_steps(path, runs.select(*logged(2, 15, going, none, F.col("positive"), said)))
    tables.log_steps(path, runs.filter(~F.col("broken")).select(*logged(3, 20, F.lit("SUCCESS"), none, none, F.lit(""))))
    return tables.job_steps(t.spark, path)


register(
    "job_status_log",
    "job:s run:s step:i status:s message:s steps:i rows_read:i rows_written:i",
    lambda t: tables.latest_job_status(job_log(t)),
    """SELECT 'load-' || record_date AS job, 'run-2' AS run, CASE WHEN broken THEN 2 ELSE 3 END AS step, CASE WHEN broken THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       CASE WHEN broken THEN 'step 2 stopped' ELSE '' END AS message, CASE WHEN broken THEN 2 ELSE 3 END AS steps, rows_read, rows_written
       FROM (SELECT record_date, day(record_date) % 7 = 0 AS broken, count(*) AS rows_read, count(*) FILTER (v > 0) AS rows_written FROM ev GROUP BY record_date)""",
)


def late_rows(t):
    """Views of two months, built before and after the late rows of January came in."""
    late = (F.col("record_date") < F.lit(FEBRUARY).cast("date")) & (F.pmod(F.crc32("node_id"), F.lit(3)) == 0)
    months = F.explode(F.array(F.lit(0), F.lit(31)))
    every = t.sph.withColumn("shift", months).withColumn("record_date", F.date_add("record_date", F.col("shift"))).drop("shift")
    early = every.filter(~late)
    store_ = stored_views.MonthlyViews(t.spark, scratch(t.spark, "views"), "late_" + uuid.uuid4().hex[:12], monthly_views(t, early))
    names = ("hourly_traffic_patterns", "station_monthly_traffic", "city_hourly_patterns")
    store_.refresh(stored_views.month_prints(early, "record_date"), names)
    store_.use(monthly_views(t, every))
    store_.refresh(stored_views.month_prints(every, "record_date"), names)
    return store_


def refreshed_views(t):
    store_ = late_rows(t)
    loads = store_.metadata().select(F.col("view_name").alias("view"), F.col("month").alias("month_date"), "loads")
    rows = store_.read("station_monthly_traffic").withColumn("view", F.lit("station_monthly_traffic")).select("view", "month_date", F.col("station_id").alias("key"), "total_ride", "total_alight", "operating_days")
    city = store_.read("city_hourly_patterns").withColumn("view", F.lit("city_hourly_patterns")).groupBy("view", "month_date", F.col("hour").cast("string").alias("key")).agg(
        F.sum("max_ride_passengers").alias("total_ride"), F.sum("max_alight_passengers").alias("total_alight"), F.lit(0).alias("operating_days")
    )
    return rows.unionByName(city).join(loads, ["view", "month_date"])


define(
    "shifted",
    """SELECT record_date + s AS record_date, date_trunc('month', record_date + s)::DATE AS month_date, hour, sph.node_id, ride_passenger, alight_passenger,
       CASE WHEN dayofweek(record_date + s) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type
       FROM sph JOIN sm ON sph.node_id = sm.node_id, unnest([0, 31]) AS u(s) WHERE is_seoul""",
)
register(
    "refresh_views",
    "view:s month_date:s key:s total_ride:i total_alight:i operating_days:i loads:i",
    refreshed_views,
    """SELECT 'station_monthly_traffic' AS view, month_date, c.node_id AS key, sum(ride_passenger) AS total_ride, sum(alight_passenger) AS total_alight,
       count(DISTINCT record_date) AS operating_days, CASE WHEN month_date < DATE '2024-02-01' THEN 2 ELSE 1 END AS loads
       FROM shifted AS c JOIN stops ON c.node_id = stops.node_id GROUP BY month_date, c.node_id
       UNION ALL SELECT 'city_hourly_patterns', month_date, CAST(hour AS VARCHAR), sum(r), sum(a), 0, CASE WHEN month_date < DATE '2024-02-01' THEN 2 ELSE 1 END
       FROM (SELECT month_date, day_type, hour, max(ride_passenger) AS r, max(alight_passenger) AS a FROM shifted GROUP BY ALL) GROUP BY month_date, hour""",
)


def registry_rows(t):
    held = store(t)
    held.ensure_all([v.name for v in held.views], MONTH)
    return held.metadata()


FACTS, SECTIONS = "station_passenger_history", "section_passenger_history"
define(
    "viewsizes",
    f"""SELECT 'hourly_traffic_patterns' AS view_name, '{FACTS}' AS base_tables, count(*) AS rows FROM district_hours
       UNION ALL SELECT 'district_monthly_traffic', '{FACTS}', count(*) FROM dmonth
       UNION ALL SELECT 'station_monthly_traffic', '{FACTS}', count(*) FROM (SELECT DISTINCT station_id, month_date FROM shp)
       UNION ALL SELECT 'city_hourly_patterns', 'hourly_traffic_patterns', count(*) FROM (SELECT DISTINCT month_date, day_type, hour FROM district_hours)
       UNION ALL SELECT 'station_hourly_patterns', '{FACTS}', count(*) FROM shp
       UNION ALL SELECT 'commuter_scores', '{FACTS},{SECTIONS},station_hourly_patterns', count(*) FROM commuter
       UNION ALL SELECT 'tourism_scores', '{FACTS},{SECTIONS},station_hourly_patterns', count(*) FROM tourism
       UNION ALL SELECT 'vulnerable_scores', '{FACTS},{SECTIONS},station_hourly_patterns', count(*) FROM vulnerable
       UNION ALL SELECT 'monthly_od_summary', 'daily_od', count(*) FROM odmonth WHERE analysis_month = DATE '2024-01-01'""",
)
register(
    "view_metadata",
    "view_name:s base_tables:s refresh:s month:s rows:i",
    registry_rows,
    "SELECT *, 'monthly' AS refresh, DATE '2024-01-01' AS month FROM viewsizes",
)
