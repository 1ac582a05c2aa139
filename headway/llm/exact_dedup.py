"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import fresh, small, stored, text_or_empty

DIGEST = "sha2_digest"


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass(frozen=True)
class DigestIndex:
    """Digests of all texts seen so far, in a table bucketed and sorted by digest.

    ``location`` is a folder that all executors share. The number of buckets lies beside the table, in
    ``<location>.buckets``; whoever opens the table again may leave ``buckets`` out, and another
    number is refused, as rows would be looked for in the wrong buckets. ``ingest`` aggregates a batch to one row
    per digest, drops the known ones by a sort-merge anti-join that reads the index without a
    shuffle (bucketed by the join key), and appends the rest. A batch that is ingested again after
    a failure finds its digests known and appends nothing.
    """

    spark: SparkSession
    name: str
    location: str
    buckets: int | None = None

    def open(self) -> DigestIndex:
        """Create the table, or open the one at ``location`` with its own number of buckets."""
        spark, note = self.spark, f"{self.location}.buckets"
        path = spark._jvm.org.apache.hadoop.fs.Path(note)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.parquet(note).first()["buckets"]
        else:
            held = self.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(held).cast("int").alias("buckets")).coalesce(1).write.parquet(note)
        if self.buckets not in (None, held):
            raise ValueError(f"the index at {self.location} has {held} buckets, not {self.buckets}")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {held} BUCKETS LOCATION '{self.location}'"
        )
        known = spark.sql(f"DESCRIBE EXTENDED {self.name}").filter("col_name = 'Num Buckets'").first()
        if int(known["data_type"]) != held:
            raise ValueError(f"table {self.name} is known with {known['data_type']} buckets, its files have {held}")
        return DigestIndex(spark, self.name, self.location, held)

    def close(self) -> None:
        """Take the table out of the catalogue; its files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows (digest, keep_id) of a batch whose digest the index lacks."""
        known = self.read().select("digest").hint("merge")
        return batch.join(known, "digest", "left_anti")

    def ingest(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """Add ``docs`` and return one row per document: which row of its text stays.

        Columns: ``key``, keep_id, group_size (rows of this batch with the text), kept, text_sha256.
        A text that the index knows keeps the row indexed before; else the largest ``key`` of the
        batch stays. Null texts count as empty. Rows that repeat both key and text are copies of
        which one is kept; rows with a null key are never preferred to others, and among such rows
        alone one stays. An empty batch gives no rows. Other columns of ``docs`` play no part.
        """
        ids = docs.select(F.col(key).cast("long").alias("_key"), digest(text_or_empty(text)).alias("digest"))
        same = ids.groupBy("digest", "_key").agg(F.count(F.lit(1)).alias("_n"))
        same = stored(same, "digests")
        groups = stored(same.groupBy("digest").agg(F.max("_key").alias("keep_id"), F.sum("_n").alias("group_size")), "digest-groups")
        new = self.unseen(groups.select("digest", "keep_id"))
        new.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        # Read by path: a scan without bucketing, so that a group of copies with a third of all rows
        # meets its one index row through an exchange that adaptive execution splits.
        held = self.spark.read.schema("digest binary, keep_id bigint").parquet(self.location)
        stays = stored(
            groups.select("digest", "group_size", F.col("keep_id").alias("_own")).join(held, "digest"), "digest-stays"
        )
        out = same.join(stays, "digest").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        first = (F.col("_copy") == 1) & F.col("_key").eqNullSafe(F.col("keep_id"))
        return out.select(
            F.col("_key").alias(key),
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            first.alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def kept_rows(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``result`` (doc_id, text_sha256, kept) keeps, with all their columns.

    A row is known by its id and its text, so other texts of an id stay, and so do those without id
    that ``result`` keeps. Rows that repeat both id and text are left once. Text travels only if more
    rows go than ``small`` lets be broadcast. Columns of ``docs`` may have any names.
    """
    known = result.groupBy(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("gone"))
    known = stored(known.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).filter("NOT kept OR rows > 1"), "dedup-drop")
    mark = fresh(docs, "digest")
    rows = docs.withColumn(mark, digest(text_or_empty()))
    on = F.col("d.doc_id").eqNullSafe(F.col("known.id")) & (F.col(f"d.{mark}") == F.col("known.gone"))
    single = rows.alias("d").join(small(known).alias("known"), on, "left_anti")
    again = rows.alias("d").join(small(known.filter("kept")).alias("known"), on, "left_semi").dropDuplicates(["doc_id", mark])
    return single.unionByName(again).drop(mark)
