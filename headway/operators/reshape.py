"""Wide feeds (24 columns per hour) to tall rows, and batch de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.operators.joins import first_per_key
from headway.schemas import HH

STATION_COLUMNS = {
    "record_date": "record_date",
    "routeId": "route_id",
    "staId": "node_id",
    "routeNm": "route_name",
    "staNm": "station_name",
    "staSn": "station_sequence",
}
SECTION_COLUMNS = {
    "record_date": "record_date",
    "routeId": "route_id",
    "fromStaId": "from_node_id",
    "toStaId": "to_node_id",
    "staSn": "station_sequence",
    "a18SumLoadPsng": "daily_total_passengers",
}
SPEED_COLUMNS = {
    "record_date": "record_date",
    "routeId": "route_id",
    "fromStaId": "from_node_id",
    "toStaId": "to_node_id",
    "fromStaSn": "from_station_sequence",
    "toStaSn": "to_station_sequence",
}


def unpivot_hours(wide: DataFrame, keep: dict[str, str], measures: dict[str, str], nulls: dict[str, bool]) -> DataFrame:
    """``measures`` maps a column template with ``{h}`` to a tall name. Values are read as
    integers; those with ``nulls`` false fall back to 0, the others stay NULL. The casts come after
    the explode, once for each measure: 24 of each make a method that the JVM doesn't compile."""
    lists = [F.array(*[F.col(template.format(h=h)) for h in HH]).alias(name) for template, name in measures.items()]
    hours = wide.select(*[F.col(src).alias(dst) for src, dst in keep.items()], *lists).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))

    def value(name: str) -> Column:
        cell = F.get(F.col(name), F.col("hour")).try_cast("long")
        return (cell if nulls[name] else F.coalesce(cell, F.lit(0).cast("long"))).alias(name)

    return hours.select(*keep.values(), "hour", *[value(name) for name in measures.values()])


def _numbers(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.expr(f"try_cast({c} AS int)"), F.lit(0)) for c in columns}).withColumn(
        "record_date", F.col("record_date").cast("date")
    )


def station_wide_to_tall(wide: DataFrame) -> DataFrame:
    measures = {"a05Num{h}h": "dispatch_count", "ridePnsgerCnt{h}h": "ride_passenger", "alghPnsgerCnt{h}h": "alight_passenger"}
    return _numbers(unpivot_hours(wide, STATION_COLUMNS, measures, dict.fromkeys(measures.values(), False)), "station_sequence")


def section_wide_to_tall(wide: DataFrame) -> DataFrame:
    """Unreadable or missing loads stay NULL; the day total is repeated on every hour."""
    measures = {"a18SumLoadPsngNum{h}h": "passenger_count"}
    tall = unpivot_hours(wide, SECTION_COLUMNS, measures, {"passenger_count": True})
    return _numbers(tall, "station_sequence", "daily_total_passengers")


def speed_wide_to_tall(wide: DataFrame) -> DataFrame:
    tall = unpivot_hours(wide, SPEED_COLUMNS, {"tripTime{h}h": "trip_time"}, {"trip_time": False})
    return _numbers(tall, "from_station_sequence", "to_station_sequence")


def od_api_to_table(feed: DataFrame) -> DataFrame:
    return feed.select(
        F.col("record_date").cast("date").alias("record_date"),
        F.col("startSggNm").alias("start_district"),
        F.col("startEmdNm").alias("start_admin_dong"),
        F.col("endSggNm").alias("end_district"),
        F.col("endEmdNm").alias("end_admin_dong"),
        F.coalesce(F.expr("try_cast(totPsngNum AS bigint)"), F.lit(0)).alias("total_passenger_count"),
    )


def dedupe_keep_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return first_per_key(df, keys, seq)


def duplicate_key_report(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(totals row, repeated keys with their counts)."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.agg(
        F.sum("n").alias("total_keys"),
        F.count(F.lit(1)).alias("unique_keys"),
        F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"),
    )
    return totals, counted.filter("n > 1")
