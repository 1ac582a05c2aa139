"""The transit tables, derived row by row from the given star-schema tables.

Each method returns a lazy DataFrame over the whole source table; nothing is cached or
collected. ``CTES`` states the same mapping for the SQL side of the checks. All rules are
local to a row or a plain ``groupBy``, so their work spreads with the input: neighbour stops
and OD partners come from arithmetic on the row instead of a window over all events.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOURS = [f"h{h:02d}" for h in range(24)]
MONTH = "2024-01-01"
TODAY = "2024-02-03"


class TransitTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    def built(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Plan of a derived frame, made once per query (the plan only; no data is kept)."""
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def raw(self, name: str) -> DataFrame:
        return self.built(f"raw {name}", lambda: self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    @cached_property
    def ev(self) -> DataFrame:
        ts = F.col("ts")
        return self.raw("events").select(
            "event_id",
            "ts",
            "user_id",
            "event_type",
            F.floor("value").cast("long").alias("v"),
            ts.cast("date").alias("record_date"),
            F.hour(ts).alias("hour"),
        )

    @cached_property
    def sph(self) -> DataFrame:
        """Boardings and alightings per (record_date, route_id, node_id, hour)."""
        even = F.col("event_id") % 2 == 0
        return self.ev.groupBy(
            "record_date",
            F.col("event_type").alias("route_id"),
            F.col("user_id").cast("string").alias("node_id"),
            "hour",
        ).agg(
            F.count(F.lit(1)).alias("dispatch_count"),
            F.sum(F.when(even, F.col("v")).otherwise(0)).alias("ride_passenger"),
            F.sum(F.when(even, 0).otherwise(F.col("v"))).alias("alight_passenger"),
        )

    @cached_property
    def stops(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.cast("string").alias("node_id"),
            F.col("c_name").alias("node_name"),
            (10000 + k).cast("string").alias("node_num"),
            ((126800 + (k % 37) * 10) / 1000.0).alias("longitude"),
            ((37450 + (k % 23) * 10) / 1000.0).alias("latitude"),
            (k % 17 != 0).alias("is_active"),
        )

    @cached_property
    def sm(self) -> DataFrame:
        """Stop to district mapping."""
        return (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").cast("string").alias("node_id"),
                F.col("c_nationkey").cast("string").alias("sgg_code"),
                F.col("n_name").alias("sgg_name"),
                F.col("c_mktsegment").alias("adm_name"),
                (F.col("c_custkey") % 10 != 0).alias("is_seoul"),
            )
        )

    @cached_property
    def grid_stops(self) -> DataFrame:
        """Stops on a lattice of constant density, for graph work."""
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.cast("string").alias("node_id"),
            ((124000 + (k % 300) * 10) / 1000.0).alias("longitude"),
            ((33000 + (F.floor(k / 300).cast("long") % 5000) * 10) / 1000.0).alias("latitude"),
        )

    @cached_property
    def sections(self) -> DataFrame:
        """Passengers on the section to a nearby stop (0, 1 or 2 numbers away)."""
        return self.ev.groupBy(
            "record_date",
            F.col("event_type").alias("route_id"),
            F.col("user_id").cast("string").alias("from_node_id"),
            F.greatest(F.col("user_id") + F.col("event_id") % 5 - 2, F.lit(0)).cast("string").alias("to_node_id"),
            "hour",
        ).agg(F.sum(F.when(F.col("event_id") % 19 != 0, F.col("v"))).alias("passenger_count"))

    @cached_property
    def speeds(self) -> DataFrame:
        days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
        return (
            self.raw("lineitem")
            .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("o_orderdate").cast("date").alias("record_date"),
                F.col("l_linenumber").cast("string").alias("route_id"),
                F.col("l_suppkey").cast("string").alias("from_node_id"),
                F.col("l_partkey").cast("string").alias("to_node_id"),
                (F.col("l_orderkey") % 24).cast("int").alias("hour"),
                F.when(days.between(0, 120), days).otherwise(0).alias("trip_time"),
            )
        )

    @cached_property
    def od_hourly(self) -> DataFrame:
        u, e = F.col("user_id"), F.col("event_id")
        return self.ev.select(
            "record_date",
            (u % 25).cast("string").alias("from_station_id"),
            ((u * 7 + e) % 25).cast("string").alias("to_station_id"),
            "hour",
            F.col("v").alias("passengers"),
        )

    @cached_property
    def od_wide(self) -> DataFrame:
        """One row per (date, from, to): CNT and the 24 hour counts of the daily OD file."""
        return self.od_hourly.groupBy("record_date", "from_station_id", "to_station_id").agg(
            F.sum("passengers").alias("cnt"),
            *[
                F.sum(F.when(F.col("hour") == h, F.col("passengers")).otherwise(0)).alias(HOURS[h])
                for h in range(24)
            ],
        )

    @cached_property
    def od_stops(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.raw("nation").select(
            k.cast("string").alias("station_id"),
            F.concat(F.lit("Stop "), F.col("n_name")).alias("station_name"),
            ((126800 + k * 13) / 1000.0).alias("longitude"),
            ((37450 + (k % 7) * 20) / 1000.0).alias("latitude"),
            F.concat(F.lit("D"), F.col("n_regionkey").cast("string")).alias("district"),
            F.col("n_name").alias("admin_dong"),
            (k != 24).alias("is_active"),
        )

    @cached_property
    def route_stops(self) -> DataFrame:
        k = F.col("s_suppkey")
        return (
            self.raw("supplier")
            .select(
                F.col("s_nationkey").cast("string").alias("stop_id"),
                (k % 13).cast("string").alias("route_id"),
                (k % 7).cast("int").alias("node_sequence"),
                F.lit(True).alias("is_active"),
            )
            .distinct()
        )

    @cached_property
    def routes(self) -> DataFrame:
        r = F.col("rid")
        return (
            self.raw("supplier")
            .select((F.col("s_suppkey") % 13).alias("rid"))
            .distinct()
            .select(
                r.cast("string").alias("route_id"),
                F.concat(F.lit("Line "), r.cast("string")).alias("route_name"),
                (r % 5 + 1).cast("string").alias("route_type"),
                F.when(r % 7 != 0, 5 + (r * 11) % 50).cast("int").alias("dispatch_interval"),
                (4 + r % 4).cast("int").alias("saturday_interval"),
                F.when(r % 3 != 0, -(r + 6)).cast("int").alias("sunday_interval"),
                ((r + 3) * 2.5).cast("double").alias("total_distance_km"),
            )
        )

    @cached_property
    def usage(self) -> DataFrame:
        """Hourly stop usage for the feature builders."""
        e = F.col("event_id")
        return (
            self.ev.groupBy(
                F.col("user_id").cast("string").alias("stop_id"),
                F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("recorded_at"),
            )
            .agg(
                F.count(F.when(e % 2 == 0, 1)).alias("boarding_count"),
                F.count(F.when(e % 2 == 1, 1)).alias("alighting_count"),
            )
            .withColumns(
                {
                    "is_operational": F.col("stop_id").cast("long") % 11 != 0,
                    "is_in_service_hours": F.hour("recorded_at").between(5, 23),
                    "is_weekend": (F.dayofweek("recorded_at") - 1).isin(0, 6),
                    "is_holiday": F.dayofmonth("recorded_at") == 1,
                }
            )
        )

    @cached_property
    def dong_od(self) -> DataFrame:
        """Trips between the nation of the customer and the nation of the supplier."""
        return (
            self.raw("lineitem")
            .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("o_orderdate").cast("date").alias("record_date"),
                F.col("c_nationkey").cast("string").alias("start_district"),
                F.col("s_nationkey").cast("string").alias("end_district"),
                F.col("l_quantity").cast("long").alias("total_passenger_count"),
            )
        )

    @cached_property
    def boundaries(self) -> DataFrame:
        """One rectangle per supplier, adjoining in rows of 20; a row is a district.

        The western and eastern sides lie on stop longitudes, so the boundary rule is used.
        """
        k = F.col("s_suppkey")
        row = F.floor(k / 20).cast("long")

        def vertex(dx: int, dy: int):
            return F.struct(
                ((126800 + (k % 20) * 20 + dx) / 1000.0).alias("lon"),
                ((37445 + row * 20 + dy) / 1000.0).alias("lat"),
            )

        ring = F.array(vertex(0, 0), vertex(20, 0), vertex(20, 20), vertex(0, 20), vertex(0, 0))
        district = F.concat(F.lit("D"), row.cast("string"))
        return self.raw("supplier").select(
            F.format_string("%09d", k).alias("adm_cd"),
            F.concat(F.lit("City "), district, F.lit(" "), F.col("s_name")).alias("adm_nm"),
            district.alias("sggnm"),
            F.array(F.array(ring)).alias("polygons"),
        )


CTES: dict[str, str] = {
    "ev": """SELECT event_id, ts, user_id, event_type, CAST(floor(value) AS BIGINT) AS v,
        CAST(ts AS DATE) AS record_date, CAST(hour(ts) AS INTEGER) AS hour FROM events""",
    "sph": """SELECT record_date, event_type AS route_id, CAST(user_id AS VARCHAR) AS node_id, hour,
        count(*) AS dispatch_count,
        CAST(sum(CASE WHEN event_id % 2 = 0 THEN v ELSE 0 END) AS BIGINT) AS ride_passenger,
        CAST(sum(CASE WHEN event_id % 2 = 1 THEN v ELSE 0 END) AS BIGINT) AS alight_passenger,
        date_trunc('month', record_date)::DATE AS month_date,
        CASE WHEN dayofweek(record_date) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type
        FROM ev GROUP BY record_date, event_type, user_id, hour""",
    "stops": """SELECT CAST(c_custkey AS VARCHAR) AS node_id, c_name AS node_name,
        CAST(10000 + c_custkey AS VARCHAR) AS node_num,
        CAST(126800 + (c_custkey % 37) * 10 AS DOUBLE) / 1000 AS longitude,
        CAST(37450 + (c_custkey % 23) * 10 AS DOUBLE) / 1000 AS latitude,
        c_custkey % 17 <> 0 AS is_active FROM customer""",
    "sm": """SELECT CAST(c_custkey AS VARCHAR) AS node_id, CAST(c_nationkey AS VARCHAR) AS sgg_code,
        n_name AS sgg_name, c_mktsegment AS adm_name, c_custkey % 10 <> 0 AS is_seoul
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "grid_stops": """SELECT CAST(c_custkey AS VARCHAR) AS node_id,
        CAST(124000 + (c_custkey % 300) * 10 AS DOUBLE) / 1000 AS longitude,
        CAST(33000 + ((c_custkey // 300) % 5000) * 10 AS DOUBLE) / 1000 AS latitude FROM customer""",
    "sections": """SELECT record_date, event_type AS route_id, CAST(user_id AS VARCHAR) AS from_node_id,
        CAST(greatest(user_id + event_id % 5 - 2, 0) AS VARCHAR) AS to_node_id, hour,
        CAST(sum(CASE WHEN event_id % 19 <> 0 THEN v END) AS BIGINT) AS passenger_count
        FROM ev GROUP BY 1, 2, 3, 4, 5""",
    "speeds": """SELECT CAST(o_orderdate AS DATE) AS record_date, CAST(l_linenumber AS VARCHAR) AS route_id,
        CAST(l_suppkey AS VARCHAR) AS from_node_id, CAST(l_partkey AS VARCHAR) AS to_node_id,
        l_orderkey % 24 AS hour,
        CASE WHEN date_diff('day', o_orderdate, l_shipdate) BETWEEN 0 AND 120
             THEN date_diff('day', o_orderdate, l_shipdate) ELSE 0 END AS trip_time
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "od_hourly": """SELECT record_date, CAST(user_id % 25 AS VARCHAR) AS from_station_id,
        CAST((user_id * 7 + event_id) % 25 AS VARCHAR) AS to_station_id, hour, v AS passengers FROM ev""",
    "od_wide": "SELECT record_date, from_station_id, to_station_id, CAST(sum(passengers) AS BIGINT) AS cnt, "
    + ", ".join(
        f"CAST(sum(CASE WHEN hour = {h} THEN passengers ELSE 0 END) AS BIGINT) AS {HOURS[h]}" for h in range(24)
    )
    + " FROM od_hourly GROUP BY record_date, from_station_id, to_station_id",
    "od_stops": """SELECT CAST(n_nationkey AS VARCHAR) AS station_id, 'Stop ' || n_name AS station_name,
        CAST(126800 + n_nationkey * 13 AS DOUBLE) / 1000 AS longitude,
        CAST(37450 + (n_nationkey % 7) * 20 AS DOUBLE) / 1000 AS latitude,
        'D' || n_regionkey AS district, n_name AS admin_dong, n_nationkey <> 24 AS is_active FROM nation""",
    "route_stops": """SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS stop_id,
        CAST(s_suppkey % 13 AS VARCHAR) AS route_id, CAST(s_suppkey % 7 AS INTEGER) AS node_sequence,
        true AS is_active FROM supplier""",
    "routes": """SELECT CAST(rid AS VARCHAR) AS route_id, 'Line ' || rid AS route_name,
        CAST(rid % 5 + 1 AS VARCHAR) AS route_type,
        CASE WHEN rid % 7 <> 0 THEN 5 + (rid * 11) % 50 END AS dispatch_interval,
        4 + rid % 4 AS saturday_interval, CASE WHEN rid % 3 <> 0 THEN -(rid + 6) END AS sunday_interval,
        CAST((rid + 3) * 2.5 AS DOUBLE) AS total_distance_km
        FROM (SELECT DISTINCT s_suppkey % 13 AS rid FROM supplier)""",
    "usage": """SELECT *, CAST(stop_id AS BIGINT) % 11 <> 0 AS is_operational,
        hour(recorded_at) BETWEEN 5 AND 23 AS is_in_service_hours,
        dayofweek(recorded_at) IN (0, 6) AS is_weekend, day(recorded_at) = 1 AS is_holiday
        FROM (SELECT CAST(user_id AS VARCHAR) AS stop_id, date_trunc('hour', ts) AS recorded_at,
              count(*) FILTER (event_id % 2 = 0) AS boarding_count,
              count(*) FILTER (event_id % 2 = 1) AS alighting_count
              FROM ev GROUP BY user_id, date_trunc('hour', ts))""",
    "dong_od": """SELECT CAST(o_orderdate AS DATE) AS record_date, CAST(c_nationkey AS VARCHAR) AS start_district,
        CAST(s_nationkey AS VARCHAR) AS end_district, CAST(l_quantity AS BIGINT) AS total_passenger_count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey""",
    "boundaries": """SELECT printf('%09d', s_suppkey) AS adm_cd,
        'City D' || (s_suppkey // 20) || ' ' || s_name AS adm_nm, 'D' || (s_suppkey // 20) AS sggnm,
        CAST(126800 + (s_suppkey % 20) * 20 AS DOUBLE) / 1000 AS x0,
        CAST(126820 + (s_suppkey % 20) * 20 AS DOUBLE) / 1000 AS x1,
        CAST(37445 + (s_suppkey // 20) * 20 AS DOUBLE) / 1000 AS y0,
        CAST(37465 + (s_suppkey // 20) * 20 AS DOUBLE) / 1000 AS y1 FROM supplier""",
    # the station-hour pattern table, used by most checks
    "shp": """SELECT month_date, day_type, sgg_code, sgg_name AS district_name, sph.node_id AS station_id,
        node_name AS station_name, longitude, latitude, coalesce(adm_name, '정보없음') AS administrative_dong,
        hour, CAST(sum(ride_passenger) AS BIGINT) AS total_ride, CAST(sum(alight_passenger) AS BIGINT) AS total_alight,
        CAST(sum(ride_passenger + alight_passenger) AS BIGINT) AS total_traffic,
        count(DISTINCT record_date) AS operating_days, count(DISTINCT route_id) AS route_count,
        count(*) AS record_count
        FROM sph JOIN sm ON sph.node_id = sm.node_id JOIN stops ON sph.node_id = stops.node_id
        WHERE is_seoul GROUP BY ALL""",
}
