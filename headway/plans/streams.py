"""Streaming versions (survey section 2.14). Each plan lands files, drains them, lands more,
drains again and returns the table; the checks compare with the batch result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from headway.plans.ingest import TALL, station_feed
from headway.plans.registry import define, register
from headway.schemas import STATION_FEED
from headway.session import scratch
from headway.sources import tables
from headway.streaming import feeds


def ingested(t):
    landing, table, checkpoint = (scratch(t.spark, n) for n in ("landing", "station-table", "ingest-checkpoint"))
    feed = station_feed(t).select(*STATION_FEED.fieldNames())
    share = F.pmod(F.xxhash64("routeId", "staId"), F.lit(3))
    # first landing: two thirds, with a wrong count that the second landing corrects
    feed.filter(share < 2).withColumn("ridePnsgerCnt08h", F.lit("9999")).write.json(f"{landing}/1")
    feeds.stream_ingest_station(t.spark, landing, table, checkpoint)
    feed.write.json(f"{landing}/2")
    feeds.stream_ingest_station(t.spark, landing, table, checkpoint)
    return tables.read_table(t.spark, table)


register("stream_ingest_station", TALL, ingested, "SELECT * FROM talls")


def landed_events(t, columns, repeats=True):
    """Events in two landings; the second may repeat every third event of the first."""
    path = scratch(t.spark, "events")
    ev = t.ev.select(*columns)
    half = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    ev.filter(half).write.parquet(f"{path}/1")
    rest = ~half | (F.col("event_id") % 3 == 0) if repeats else ~half
    return path, ev, lambda: ev.filter(rest).write.parquet(f"{path}/2")


COLUMNS = ["event_id", "ts", "user_id", "event_type", "v", "record_date"]


def source(t, path, schema):
    return feeds.landed(t.spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))


LATENESS = "3 days"
#: Lands first; some rows of these days land later, and count only if they are newer than the bound.
FIRST = "day(record_date) <= 20 AND event_id % 7 <> 0"
define("firstlanded", f"SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {LATENESS} AS bound FROM ev WHERE {FIRST}")


def in_order(t, repeats):
    """Events in two landings, mostly in order of time; the second may repeat every third event of the first."""
    path = scratch(t.spark, "events")
    ev, first = t.ev.select(*COLUMNS), F.expr(FIRST)
    ev.filter(first).write.parquet(f"{path}/1")
    rest = ~first | (F.col("event_id") % 3 == 0) if repeats else ~first
    return path, ev, lambda: ev.filter(rest).write.parquet(f"{path}/2")


def deduped(t):
    path, ev, more = in_order(t, repeats=True)
    out, checkpoint = scratch(t.spark, "dedupe-out"), scratch(t.spark, "dedupe-checkpoint")

    def run():
        stream = feeds.stream_dedupe(source(t, path, ev.schema), ["event_id"], "ts", LATENESS)
        return feeds.append_rows(stream, out, checkpoint)

    run()
    more()
    return run()


register(
    "stream_dedupe",
    "event_id:i user_id:i v:i",
    deduped,
    f"SELECT event_id, user_id, v FROM ev JOIN firstlanded ON true WHERE ({FIRST}) OR ts > bound",
)


def hourly(t):
    path, ev, more = in_order(t, repeats=False)
    table, checkpoint = scratch(t.spark, "hourly-table"), scratch(t.spark, "hourly-checkpoint")
    even = F.col("event_id") % 2 == 0

    def run():
        rows = source(t, path, ev.schema).withColumns(
            {
                "node_id": F.col("user_id").cast("string"),
                "ride_passenger": F.when(even, F.col("v")).otherwise(0),
                "alight_passenger": F.when(even, 0).otherwise(F.col("v")),
            }
        )
        return feeds.upsert_windows(feeds.stream_hourly_traffic(rows, "ts", LATENESS), "hour_at", ["hour_at", "node_id"], table, checkpoint)

    run()
    more()
    return run()


register(
    "stream_hourly_traffic",
    "hour_at:s node_id:s ride_passenger:i alight_passenger:i records:i",
    hourly,
    f"""SELECT date_trunc('hour', ts) AS hour_at, CAST(user_id AS VARCHAR) AS node_id, sum(CASE WHEN event_id % 2 = 0 THEN v ELSE 0 END) AS ride_passenger,
       sum(CASE WHEN event_id % 2 = 1 THEN v ELSE 0 END) AS alight_passenger, count(*) AS records
       FROM ev JOIN firstlanded ON true WHERE ({FIRST}) OR date_trunc('hour', ts) + INTERVAL 1 HOUR > bound GROUP BY 1, 2""",
)


def late(t):
    path = scratch(t.spark, "late-events")
    out, checkpoint = scratch(t.spark, "late-out"), scratch(t.spark, "late-checkpoint")
    ev = t.ev.select(*COLUMNS)
    early = F.dayofmonth("record_date") <= 20
    ev.filter(early).write.parquet(f"{path}/1")
    feeds.stream_late_rows(feeds.landed(t.spark, path, ev.schema), "record_date", 5, out, checkpoint)
    ev.filter(~early | (F.dayofmonth("record_date") == 10)).write.parquet(f"{path}/2")
    return feeds.stream_late_rows(feeds.landed(t.spark, path, ev.schema), "record_date", 5, out, checkpoint)


register(
    "stream_late_rows",
    "batch_id:i record_date:s delayed:i",
    late,
    """SELECT 0 AS batch_id, record_date, count(*) AS delayed FROM ev WHERE day(record_date) <= 20 AND
         date_diff('day', record_date, (SELECT max(record_date) FROM ev WHERE day(record_date) <= 20)) > 5 GROUP BY record_date
       UNION ALL SELECT 1, record_date, count(*) FROM ev WHERE (day(record_date) > 20 OR day(record_date) = 10)
         AND date_diff('day', record_date, (SELECT max(record_date) FROM ev WHERE day(record_date) > 20 OR day(record_date) = 10)) > 5 GROUP BY record_date""",
)
NOW = dt.datetime(2024, 1, 30, 12, 0)


def cached(t):
    path, ev, more = landed_events(t, ["event_id", "ts", "user_id", "v"])
    table, checkpoint = scratch(t.spark, "cache"), scratch(t.spark, "cache-checkpoint")

    def run():
        return feeds.stream_ttl_cache(feeds.landed(t.spark, path, ev.schema), ["user_id"], "ts", table, checkpoint, NOW, "12 HOURS")

    run()
    more()
    return run()


register(
    "stream_ttl_cache",
    "user_id:i event_id:i v:i",
    cached,
    """SELECT user_id, event_id, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM ev)
       WHERE r = 1 AND ts + INTERVAL 12 HOUR >= TIMESTAMP '2024-01-30 12:00:00'""",
)
