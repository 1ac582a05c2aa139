"""Shared pieces of the operators: stored tables, checked broadcasts, positions, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.operators.graph import connected_components
from headway.session import scratch

BROADCAST_ROWS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the stored table ``df`` has at most ``rows`` rows.

    A larger table stays unhinted; the join then shuffles both sides. Results are the same.
    """
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text (null id: 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, line and page breaks."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def positions(df: DataFrame, groups: list[str], order: list[str], name: str, label: str) -> DataFrame:
    """Gapless positions from 0 inside each group, in the order of ``order``.

    A range sort by group and order puts blocks into partitions and the sorted rows are stored with
    their block and place, so nothing moves if a task is repeated. A group that spans blocks adds the
    rows of its earlier blocks. As the blocks are sorted by group, the table of block starts has at
    most blocks + groups rows; it is broadcast only after its size is checked.
    """
    tagged = stored(df.sort(*groups, *order).withColumn("_mid", F.monotonically_increasing_id()), label)
    tagged = tagged.withColumn("_block", F.shiftright("_mid", 33)).withColumn(
        "_place", F.col("_mid") - F.shiftleft("_block", 33)
    )
    starts = tagged.groupBy("_block", *groups).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        starts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first"),
        f"{label}-starts",
    )
    other = starts.select("_shift", F.col("_block").alias("_b"), *[F.col(g).alias(f"_g_{g}") for g in groups])
    on = F.col("_block") == F.col("_b")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (
        tagged.join(small(other), on)
        .withColumn(name, (F.col("_place") + F.col("_shift")).cast("long"))
        .drop("_mid", "_block", "_place", "_shift", "_b", *[f"_g_{g}" for g in groups])
    )


def bounded_sample(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """The ``limit`` rows with the smallest hash of ``key``: the same ones on each run."""
    order = F.xxhash64(F.col(key).cast("string"))
    return rows.withColumn("_h", order).orderBy("_h", key).limit(limit).drop("_h")


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Texts of at most ``limit`` labelled ids: ``labels`` (doc_id, y) met with ``docs``; stored.

    The ids with the smallest hash are taken, one label each (the largest, if an id has several), so
    the broadcast side has at most ``limit`` rows and no text is shuffled.
    """
    ids = labels.filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = bounded_sample(ids, limit)
    return stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "sample")


def same_id_links(rows: DataFrame, reps: DataFrame, key: list[str]) -> DataFrame:
    """Links (src, dst) between the representatives of all keys that one doc_id has.

    ``rows`` are (doc_id, *key), ``reps`` are (*key, rep). Few ids repeat with another key; only their
    rows meet ``reps``.
    """
    value = F.struct(*key)
    twice = rows.groupBy("doc_id").agg(F.min(value).alias("_a"), F.max(value).alias("_b")).filter("_a <> _b")
    twice = stored(twice.select(F.col("doc_id").alias("_id")), "repeated-ids")
    nodes = rows.join(twice, F.col("doc_id") == F.col("_id"), "left_semi").join(reps, key).select("doc_id", "rep").distinct()
    nodes = stored(nodes, "repeated-nodes")
    least = nodes.groupBy("doc_id").agg(F.min("rep").alias("src"))
    return nodes.join(least, "doc_id").select("src", F.col("rep").alias("dst"))


def with_components(reps: DataFrame, links: DataFrame) -> DataFrame:
    """``reps`` with the smallest ``rep`` that ``links`` (src, dst; stored, one direction) reach as ``component``."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = both.select(F.col("src").alias("node_id")).distinct()
    found = stored(connected_components(nodes, both), "components").withColumnRenamed("node_id", "rep")
    return reps.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
