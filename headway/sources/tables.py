"""Table writes: upserts, expiry and logs.

Parquet has no MERGE. An upserted table is a folder of loads, each with the merged rows of the
partitions that it touched, and a log that says which load holds a partition. One small file in
the log makes a load visible, so a reader sees the table before or after it, and a job that dies
earlier leaves the table as it was. A table has one writer at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.operators.joins import last_per_key

SEQ = "load_seq"
HELD = "folder string, load string, seq long"  # one row per partition folder and load


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it doesn't exist."""
    files, folder = _folder(spark, path)
    found = files.listStatus(folder) if files.exists(folder) else ()
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def remove(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.delete(folder, True)


def _held(spark: SparkSession, path: str) -> dict[str, tuple[str, int]]:
    """Load and its number by partition folder: one entry per partition."""
    if not exists(spark, f"{path}/_log"):
        return {}
    last = F.max_by(F.struct("load", "seq"), "seq").alias("last")
    rows = spark.read.schema(HELD).parquet(f"{path}/_log").groupBy("folder").agg(last).collect()
    return {r["folder"]: (r["last"]["load"], r["last"]["seq"]) for r in rows}


def _read(spark: SparkSession, path: str, held: dict[str, tuple[str, int]], schema: T.StructType | None) -> DataFrame:
    if not held:
        return spark.createDataFrame([], schema or T.StructType())
    reader = spark.read.option("basePath", path)
    rows = (reader.schema(schema) if schema else reader).parquet(*[f"{path}/{load}/{name}" for name, (load, _) in sorted(held.items())])
    return rows.select(schema.names) if schema else rows.drop("load")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """An upserted table as of now; later loads don't change what the frame reads."""
    return _read(spark, path, _held(spark, path), schema)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str, seq: str = SEQ, fresh: bool = False) -> DataFrame:
    """Insert or replace by key; among equal keys the largest ``seq`` wins.

    The batch is evaluated once, into a staging folder. Old rows of the partitions that it touches
    are merged with it into a folder of this load; then the log is written. The rebalance hint splits
    a partition value that holds much of the data over several tasks and joins small ones.

    ``fresh`` states that the batch holds each key once and that no old row has a larger ``seq`` (this is
    checked). Then the batch is written into its load at once, and only the old rows whose keys it lacks
    are added: they meet its keys, not its rows.
    """
    held, name = _held(spark, path), uuid.uuid4().hex
    number = 1 + max((n for _, n in held.values()), default=0)
    load = f"load={number:06d}-{name}"
    staged = f"{path}/{load}" if fresh else f"{path}/_staged/{name}"
    new.write.partitionBy(partition).parquet(staged)
    touched = [f for f in folders(spark, staged) if f.startswith(f"{partition}=")]
    if touched:
        rows = spark.read.schema(new.schema).parquet(staged).select(new.columns)
        held_here = {f: held[f] for f in touched if f in held}
        old = _read(spark, path, held_here, new.schema) if held_here else None
        if not fresh:
            rows = rows.unionByName(old) if old else rows
            last_per_key(rows, keys, seq).hint("rebalance", partition).write.partitionBy(partition).parquet(f"{path}/{load}")
        elif old:
            _check_newer(rows, old, seq)
            _lacking(old, rows, keys).hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(staged)
        _commit(spark, path, [(f, load, number) for f in touched])
    if not (fresh and touched):
        remove(spark, staged)
    return read_table(spark, path, new.schema)


def _check_newer(rows: DataFrame, old: DataFrame, seq: str) -> None:
    first, last = rows.agg(F.min(seq)).first()[0], old.agg(F.max(seq)).first()[0]
    if first is not None and last is not None and first < last:
        raise ValueError(f"rows of the table have a {seq} up to {last}, above {first} of a fresh batch")


def _lacking(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys are not among ``rows``. Sorting by a hash first seldom compares texts.

    Packed files look small to Spark, so without the hint it broadcasts keys that are many times larger.
    """
    left = old.withColumn("_hash", F.xxhash64(*keys))
    right = rows.select(F.xxhash64(*keys).alias("_hash"), *keys)
    same = left["_hash"] == right["_hash"]
    for k in keys:
        same = same & left[k].eqNullSafe(right[k])
    return left.join(right.hint("merge"), same, "left_anti").drop("_hash")


def _commit(spark: SparkSession, path: str, entries: list[tuple[str, str, int]]) -> None:
    spark.createDataFrame(entries, HELD).coalesce(1).write.mode("append").parquet(f"{path}/_log")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete staged rows and loads that hold no partition any more (once no reader needs them); returns their number."""
    current = {load for load, _ in _held(spark, path).values()}
    old = [f for f in folders(spark, path) if f.startswith("load=") and f not in current]
    gone = [f"{path}/{f}" for f in old] + [f"{path}/_staged/{f}" for f in folders(spark, f"{path}/_staged")]
    return sum(remove(spark, f) for f in gone)


def bulk_load_od(daily: DataFrame, path: str) -> DataFrame:
    """Append daily OD rows in fixed column order with route arrays as JSON."""
    arrays = [f.name for f in daily.schema.fields if f.dataType.typeName() == "array"]
    (
        daily.withColumns({a: F.to_json(a) for a in arrays})
        .hint("rebalance", "analysis_date")
        .write.mode("append")
        .partitionBy("analysis_date")
        .parquet(path)
    )
    return daily.sparkSession.read.parquet(path)


def stamp_expiry(df: DataFrame, now: dt.datetime, hours: int = 1) -> DataFrame:
    at = F.lit(now)
    return df.withColumns({"cached_at": at, "expires_at": at + F.expr(f"INTERVAL {hours} HOUR")})


def upsert_population(cache: DataFrame, new: DataFrame, keys: list[str], now: dt.datetime) -> DataFrame:
    """Cache rows after inserting ``new`` with a fresh expiry."""
    return last_per_key(cache.unionByName(stamp_expiry(new, now)), keys, "cached_at")


def purge_expired(cache: DataFrame, now: dt.datetime, grace_days: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one-row count of deleted rows)."""
    old = F.col("expires_at") < F.lit(now) - F.expr(f"INTERVAL {grace_days} DAY")
    return cache.filter(~old), cache.filter(old).agg(F.count(F.lit(1)).alias("deleted"))


def features_with_stops(features: DataFrame, stops: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    located = stops.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.col("node_id").alias("stop_id"), F.col("node_name").alias("stop_name"), "latitude", "longitude"
    )
    rows = features
    if start is not None:
        rows = rows.filter(F.col("recorded_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("recorded_at") <= F.lit(end).cast("timestamp_ntz"))
    return rows.join(located, "stop_id")


def export_features_csv(features: DataFrame, stops: DataFrame, path: str, start: str, end: str) -> str:
    """Globally ordered CSV parts: range partitions, each sorted."""
    (
        features_with_stops(features, stops, start, end)
        .repartitionByRange("recorded_at", "stop_id")
        .sortWithinPartitions("recorded_at", "stop_id")
        .write.option("header", True)
        .csv(path)
    )
    return path


def export_features_sample(features: DataFrame, stops: DataFrame, n: int, seed: int) -> DataFrame:
    """Random n rows. The order is a seeded hash of the key, so a retried task or another
    partitioning draws the same sample."""
    key = F.concat_ws("|", F.lit(str(seed)), "stop_id", F.date_format("recorded_at", "yyyy-MM-dd HH"))
    return features_with_stops(features, stops).orderBy(F.md5(key)).limit(n)


STEPS = "job string, run string, step int, status string, logged_at timestamp, rows_read long, rows_written long, message string"


def log_steps(path: str, steps: DataFrame) -> None:
    """Append one row per step of a job run; a step that is logged again has a later time."""
    steps.select([c.split()[0] for c in STEPS.split(", ")]).write.mode("append").parquet(path)


def job_steps(spark: SparkSession, path: str) -> DataFrame:
    """The log with each (job, run, step) once, as last written."""
    return last_per_key(spark.read.schema(STEPS).parquet(path), ["job", "run", "step"], "logged_at")


def latest_job_status(steps: DataFrame) -> DataFrame:
    """Last step of the last run of each job, and the rows of all steps of that run."""
    last = F.max_by(F.struct("step", "status", "logged_at", "message"), F.struct("step", "logged_at")).alias("l")
    runs = steps.groupBy("job", "run").agg(
        last, F.min("logged_at").alias("started_at"), F.count(F.lit(1)).alias("steps"),
        F.sum("rows_read").alias("rows_read"), F.sum("rows_written").alias("rows_written"),
    )
    return last_per_key(runs.select("job", "run", "l.*", "started_at", "steps", "rows_read", "rows_written"), ["job"], "started_at")
