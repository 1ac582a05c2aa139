"""Continuous versions of ingest, de-duplication, hourly traffic and the expiring cache.

Each function starts a query that takes what has landed so far (``availableNow``) and returns
when it is done; run again, it continues from its checkpoint. Sinks are keyed, so a replayed
batch writes the same rows again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.operators import reshape
from headway.operators.joins import last_per_key
from headway.schemas import KEYS, STATION_FEED
from headway.sources import tables


def landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).format(fmt).load(path)


def drain(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()


def stream_ingest_station(spark: SparkSession, landing: str, table: str, checkpoint: str) -> None:
    """Landed station pages to the tall fact table.

    Inside a batch the first landed row of a key is kept; later batches replace earlier keys.
    """
    pages = landed(spark, landing, STATION_FEED, "json").select("*", "_metadata.file_modification_time", "_metadata.file_path")

    def sink(batch: DataFrame, batch_id: int) -> None:
        order = F.struct("file_modification_time", "file_path", F.monotonically_increasing_id().alias("row"))
        dated = batch.withColumns({"record_date": F.col("record_date").try_cast("date"), "_order": order})  # two spellings of a date are one key
        once = reshape.dedupe_keep_first(dated, ["record_date", "routeId", "staId"], "_order")
        tall = reshape.station_wide_to_tall(once).withColumn(tables.SEQ, F.lit(batch_id))
        tables.upsert(batch.sparkSession, table, tall, KEYS["station"], "record_date", fresh=True)

    drain(pages, checkpoint, sink)


def stream_dedupe(events: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """First row per key within the lateness bound; state older than the bound is dropped."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def stream_hourly_traffic(events: DataFrame, time: str, lateness: str) -> DataFrame:
    """Running boardings and alightings per stop and hour."""
    return (
        events.withWatermark(time, lateness)
        .groupBy(F.window(time, "1 hour").alias("w"), "node_id")
        .agg(
            F.sum("ride_passenger").alias("ride_passenger"),
            F.sum("alight_passenger").alias("alight_passenger"),
            F.count(F.lit(1)).alias("records"),
        )
        .select(F.col("w.start").alias("hour_at"), "node_id", "ride_passenger", "alight_passenger", "records")
    )


def append_rows(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Rows that are final once emitted, in one folder per batch; a replayed batch replaces its own."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    drain(stream, checkpoint, sink)
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)


def upsert_windows(stream: DataFrame, time: str, keys: list[str], table: str, checkpoint: str) -> DataFrame:
    """Running totals of windows, one row each: a batch rewrites the days of the windows that it changes,
    which the lateness bound of the stream keeps few."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"day": F.to_date(time), tables.SEQ: F.lit(batch_id)})
        tables.upsert(batch.sparkSession, table, rows, keys, "day")

    drain(stream, checkpoint, sink, "update")
    return tables.read_table(stream.sparkSession, table).drop("day", tables.SEQ)


def stream_late_rows(events: DataFrame, date: str, days: int, path: str, checkpoint: str) -> DataFrame:
    """Counts rows per date and batch that trail the newest date of their batch by more than ``days``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max(date).alias("m")).scalar()
        late = batch.filter(F.datediff(newest, F.col(date)) > days)
        counts = late.groupBy(date).agg(F.count(F.lit(1)).alias("delayed")).withColumn("batch_id", F.lit(batch_id))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    drain(events, checkpoint, sink)
    return events.sparkSession.read.parquet(path)


def stream_ttl_cache(events: DataFrame, keys: list[str], time: str, table: str, checkpoint: str, now: dt.datetime, ttl: str) -> DataFrame:
    """Latest row per key, dropped once older than ``ttl`` at the given clock.

    A batch adds its latest live row per key below the day of the row. Days that lie wholly before the
    bound are deleted; nothing is rewritten, and a replayed batch replaces its own rows. A row is the
    latest of its key exactly if it is the latest of the live ones, so older days are never needed.
    """
    spark = events.sparkSession
    bound = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz") - F.expr(f"INTERVAL {ttl}")
    live = F.col(time).cast("timestamp_ntz") >= bound

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = last_per_key(batch.filter(live), keys, time).withColumns({"day": F.to_date(time), "batch_id": F.lit(batch_id)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(table)

    drain(events, checkpoint, sink)
    first_day = spark.range(1).select(F.to_date(bound).cast("string").alias("d")).first().d
    for folder in tables.folders(spark, table):
        if folder.startswith("day=") and folder.removeprefix("day=") < first_day:
            tables.remove(spark, f"{table}/{folder}")
    schema = T.StructType([*events.schema.fields, T.StructField("day", T.DateType()), T.StructField("batch_id", T.LongType())])
    kept = spark.read.schema(schema).parquet(table).filter((F.col("day") >= F.lit(first_day).cast("date")) & live)
    return last_per_key(kept.select(events.columns), keys, time)
