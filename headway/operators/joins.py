"""Join shapes shared by the builders.

No builder hints a broadcast for a table that can grow: Spark compares the measured size with
``spark.sql.autoBroadcastJoinThreshold`` (also at run time, through AQE) and otherwise shuffles
both sides, splitting skewed partitions. Spark estimates by the size of packed files, which rows
of stops and hours exceed many times; ``never_broadcast`` keeps those from passing the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def never_broadcast(df: DataFrame) -> DataFrame:
    """For the stop-sized side of a join."""
    return df.hint("merge")


def in_city(sm: DataFrame) -> DataFrame:
    return never_broadcast(sm.filter("is_seoul").drop("is_seoul"))


def fact_dim(facts: DataFrame, sm: DataFrame, stops: DataFrame) -> DataFrame:
    """Facts of stops that are mapped to the city and present in the stop table."""
    return facts.join(in_city(sm), "node_id").join(never_broadcast(stops), "node_id")


def section_ends(sections: DataFrame, *measures: str) -> DataFrame:
    """One row per stop that a section touches; a loop section counts once.

    Turns ``node = from OR node = to`` into an equi-join key.
    """
    ends = F.array_distinct(F.array("from_node_id", "to_node_id"))
    return sections.select(F.explode(ends).alias("node_id"), *measures)


def hours_grid(keys: DataFrame) -> DataFrame:
    """Every key row with hours 0 to 23, generated in place (no join)."""
    return keys.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))


def one_row(df: DataFrame, *columns: str) -> Column:
    """A one-row frame as a struct column (scalar subquery), to attach to every row."""
    return df.select(F.struct(*columns)).scalar()


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def best_per_group(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark prunes each partition to ``n`` rows before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Row with the smallest ``seq`` per key; a partition sends one row of a key, so hot keys shrink map-side."""
    return _pick(df, keys, F.asc_nulls_last(seq))


def last_per_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return _pick(df, keys, F.desc_nulls_last(seq))


def _pick(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))  # limited to one row a key before the shuffle
    return df.withColumn("_row", first).filter("_row = 1").drop("_row")


def in_district(df: DataFrame, district: str | None) -> DataFrame:
    """The predicate exists only when a district is given."""
    return df if district is None else df.filter(F.col("district_name") == district)


def active_stations(sph: DataFrame, sm: DataFrame, start: str, end: str) -> DataFrame:
    """Mapped stops per district with any passenger in the range."""
    seen = sph.filter(
        F.col("record_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & ((F.col("ride_passenger") > 0) | (F.col("alight_passenger") > 0))
    ).select("node_id")
    return (
        in_city(sm)
        .join(seen, "node_id", "left_semi")
        .groupBy(F.col("sgg_name").alias("district_name"))
        .agg(F.count(F.lit(1)).alias("active_stations"))
    )


def time_slices(shp: DataFrame) -> DataFrame:
    """Night, weekday rush and weekend totals in one pass: a row feeds every slice it is in."""
    from headway.functions.calendar import EVENING_RUSH, MORNING_RUSH, NIGHT_HOURS

    hour = F.col("hour")
    member = F.array_compact(
        F.array(
            F.when(hour.isin(NIGHT_HOURS), "night"),
            F.when(hour.isin(MORNING_RUSH + EVENING_RUSH) & (F.col("day_type") == "weekday"), "rush"),
            F.when(F.col("day_type") == "weekend", "weekend"),
        )
    )
    return (
        shp.select(F.explode(member).alias("slice"), "total_ride", "total_alight")
        .groupBy("slice")
        .agg(F.sum("total_ride").alias("total_ride"), F.sum("total_alight").alias("total_alight"))
    )


def min_max_scaled(df: DataFrame, value: str, name: str) -> DataFrame:
    span = one_row(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")), "lo", "hi")
    lo, hi = span.getField("lo"), span.getField("hi")
    return df.withColumn(name, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0))


def share_of_max(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Value over the maximum of its group; the callers' groups hold at most 24 hours."""
    from pyspark.sql import Window

    top = F.max(value).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when(top > 0, F.col(value) / top).otherwise(0.0))
