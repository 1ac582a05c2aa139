"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import small, stored, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
#: Words of a block. Quotas are whole blocks, so a source misses its target by about a block.
BLOCK = 32
SHARDS = 16
SEED = "mix-1"
#: Multipliers of the block shuffle: the first one that does not divide the number of blocks is used.
STRIDES = (1_000_003, 998_244_353, 2_147_483_647)


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: int = 2) -> DataFrame:
    """Target words of each source: ``sizes`` (source, source_size, ...) plus weight and target.

    Sources take the weights in turn by code point, null last. They share ``share`` times all words;
    a target stops at ``limit`` times its source's size, and what is above goes to the others by
    weight. The sources are sorted by the level at which they are full; the first one that stays
    below its limit gives the level of all others. Windows without a key see one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    full = F.col("source_size") * limit
    before = Window.orderBy("_full_at", "_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(full).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    leveled = (
        sizes.withColumn("weight", weight)
        .withColumn("_key", source_key(F.col("source")))
        .withColumn("_full_at", full / F.col("weight"))
        .withColumn("_level", level)
    )
    found = F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "_key", "_level"))).over(everything)
    target = F.least(F.col("weight") * F.coalesce(found["_level"], F.lit(0.0)), full.cast("double"))
    return leveled.withColumn("target", target).drop("_key", "_full_at", "_level")


def quotas(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """Blocks of each source in each output shard: (source, shard, quota, seats, blocks).

    A seat k of a source has the quotient target / (2k + 1); a house of n seats goes to the n highest
    quotients, at most twice the source's blocks for one source. Shard j gets what the house of the
    first j + 1 shards has beyond the house of the first j; houses only grow, so quotas are never
    negative. Rounding target x n / total gives all seats but at most half as many as there are
    sources; only those few are then chosen by quotient. Ties go to the earlier source. Every table
    here has one row per source, shard and open seat.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    house = Window.partitionBy("shard")
    wide = sources.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn(
        "_total", F.sum("target").over(everything)
    )
    wide = (
        wide.withColumn("_seats", F.when(F.col("_total") > 0, F.greatest(F.lit(1), F.round(F.col("_total") / block))).otherwise(0).cast("long"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumn("_house", F.floor(F.col("_seats") * (F.col("shard") + 1) / shards))
        .withColumn(
            "_rounded",
            F.when(
                F.col("_total") > 0,
                F.least(F.floor(F.col("target") * F.col("_house") / F.col("_total") + 0.5), F.col("blocks") * 2),
            ).otherwise(0),
        )
        .withColumn("_open", F.col("_house") - F.sum("_rounded").over(house))
    )
    key = source_key(F.col("source"))
    more = F.when(F.col("_open") > 0, F.least(F.col("_rounded") + F.col("_open"), F.col("blocks") * 2) - 1)
    fewer = F.greatest(F.col("_rounded") + F.col("_open"), F.lit(0))
    seat = F.explode(
        F.when(F.col("_open") > 0, F.when(more >= F.col("_rounded"), F.sequence("_rounded", more)))
        .when((F.col("_open") < 0) & (F.col("_rounded") > fewer), F.sequence(fewer, F.col("_rounded") - 1))
    )
    changed = wide.select("shard", key.alias("_key"), "target", "_open", seat.alias("_seat"))
    quotient = F.col("target") / (F.col("_seat") * 2 + 1)
    best = Window.partitionBy("shard").orderBy(F.signum("_open") * -quotient, F.signum("_open") * F.when(F.col("_key") == "n", 1).otherwise(0), "_key")
    changed = (
        changed.withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") <= F.abs("_open"))
        .groupBy(F.col("shard").alias("_s"), F.col("_key").alias("_k"))
        .agg(F.sum(F.signum("_open")).cast("long").alias("_change"))
    )
    seats = wide.join(changed, (F.col("shard") == F.col("_s")) & (key == F.col("_k")), "left").withColumn(
        "seats", (F.col("_rounded") + F.coalesce("_change", F.lit(0))).cast("long")
    )
    last = Window.partitionBy(key).orderBy("shard")
    quota = F.col("seats") - F.coalesce(F.lag("seats").over(last), F.lit(0))
    return seats.select("source", "shard", quota.alias("quota"), "seats", F.col("blocks").cast("long").alias("blocks"))


def chosen(block: Column, blocks: Column, picks: Column, seed: str = SEED) -> Column:
    """Whether a block is among ``picks`` of ``blocks`` blocks: a seeded bijection of the block numbers."""
    shift = sum(map(ord, seed)) * 7919
    stride = F.lit(STRIDES[-1])
    for s in reversed(STRIDES[:-1]):
        stride = F.when(blocks % s != 0, F.lit(s)).otherwise(stride)
    return F.pmod(block * (stride % blocks) + shift, blocks) < picks


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: int = 2, block: int = BLOCK, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Words that a mix takes from each document.

    Each source's documents are laid out in a seeded order and cut into blocks of ``block`` words.
    The apportioned seats of a source go over its blocks: whole passes first, then a seeded choice of
    blocks. Returns doc_id, source, size, source_size, target, taken (words in chosen blocks, repeats
    counted, at most ``limit`` times size), text_hash and copies (how often a user takes the whole
    document: the words of the seats go over the documents in the seeded order, whole passes first, and
    the last pass ends at the document boundary nearest to them, so a source misses its seats by at
    most half a document). Null texts and texts of white space have size 0 and take nothing;
    null sources are one source, after all others. Rows that repeat a doc_id are laid out one after
    the other. An empty table gives no rows; other columns play no part. No group is held in one task:
    a source is cut into about sqrt(n) ranges of its seeded order, whose totals give their offsets.
    """
    ident = F.col("doc_id").cast("long")
    order = F.md5(F.concat(F.lit(seed), F.coalesce(ident.cast("string"), F.lit(""))))
    rows = stored(
        docs.select(
            ident.alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(text_or_empty()).alias("size"),
            F.xxhash64(text_or_empty()).alias("text_hash"),
            order.alias("_order"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    sources = stored(targets(stored(sizes, "mix-sizes"), weights, share, limit), "mix-sources")
    seats = quotas(sources, block, shards).filter(F.col("shard") == shards - 1).select("source", "seats", "blocks")
    plan = (
        sources.withColumn("_key", source_key(F.col("source")))
        .join(seats.select(source_key(F.col("source")).alias("_key"), "seats", "blocks"), "_key")
        .select("_key", "source_size", "target", "seats", "blocks", F.ceil(F.sqrt("_docs")).alias("_cells"))
    )
    plan = stored(plan, "mix-plan")
    head = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    laid = rows.withColumn("_key", source_key(F.col("source"))).join(small(plan), "_key")
    laid = laid.withColumn("_cell", F.floor(head * F.col("_cells") / 2**32))
    cells = laid.groupBy("_key", "_cell").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(
        cells.select(
            F.col("_key").alias("_k"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_base")
        ),
        "mix-cells",
    )
    inside = Window.partitionBy("_key", "_cell").orderBy("_order", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.join(small(cells), (F.col("_key") == F.col("_k")) & (F.col("_cell") == F.col("_c"))).withColumn(
        "_at", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    passes = F.when(F.col("blocks") > 0, F.floor(F.col("seats") / F.col("blocks"))).otherwise(0)
    picks = F.col("seats") - F.col("_passes") * F.col("blocks")
    end = F.col("_at") + F.col("size")
    first = F.floor(F.col("_at") / block)

    def overlap(total: Column, b: Column) -> Column:
        words = F.least(end, (b + 1) * block) - F.greatest(F.col("_at"), b * block)
        return total + F.when(chosen(b, F.col("blocks"), F.col("_picks"), seed), words).otherwise(0)

    part = F.aggregate(F.sequence(first, F.floor((end - 1) / block)), F.lit(0).cast("long"), overlap)
    out = laid.withColumn("_passes", passes).withColumn("_picks", picks)
    taken = F.when(F.col("size") > 0, F.col("_passes") * F.col("size") + part).otherwise(0)
    quota = F.least(F.col("seats") * block, F.col("source_size") * limit)
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0)
    more = F.when(F.col("_at") * 2 + F.col("size") <= (quota - whole * F.col("source_size")) * 2, 1).otherwise(0)
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        "text_hash",
        F.when(F.col("size") > 0, whole + more).otherwise(0).cast("long").alias("copies"),
    )


def mixed_rows(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as ``result`` (of ``mix``) takes them whole.

    Rows that share doc_id, source and text take their copies together. Only where the last pass of a
    source ends between such rows do some get one more than others; those few groups are numbered.
    Columns may have any names.
    """
    names = docs.columns
    docs = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    keys = ["doc_id", "source", "text_hash"]
    times = result.groupBy(*keys).agg(
        F.min("copies").alias("_copies"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("_more")
    )
    times = stored(times.filter("_copies + _more > 0"), "mix-times")
    times = times.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_copies", "_more")
    rows = docs.withColumn("_hash", F.xxhash64(text_or_empty()))
    on = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("_k_doc_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("_k_source"))
        & (F.col("_hash") == F.col("_k_text_hash"))
    )
    taken = rows.join(times.filter("_more = 0"), on)
    uneven = times.filter("_more > 0")
    if not uneven.isEmpty():
        group = Window.partitionBy("_k_doc_id", "_k_source", "_k_text_hash").orderBy(F.xxhash64(F.to_json("row")))
        split = rows.join(small(uneven), on).withColumn("_extra", F.when(F.row_number().over(group) <= F.col("_more"), 1).otherwise(0))
        split = split.withColumn("_copies", F.col("_copies") + F.col("_extra")).drop("_extra").filter("_copies > 0")
        taken = taken.unionByName(split)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*[F.col("row")[n].alias(n) for n in names])


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s),
v AS (SELECT *, source_size * 2 / weight AS full_at, coalesce('s' || source, 'n') AS k FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(source_size * 2) OVER (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM v),
t AS (SELECT *, least(weight * coalesce((SELECT level FROM l WHERE level <= full_at ORDER BY full_at, k LIMIT 1), 0), source_size * 2) AS target FROM l),
r AS (SELECT *, CAST(ceil(source_size / {BLOCK}) AS BIGINT) AS blocks, sum(target) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM t),
h AS (SELECT *, CASE WHEN total > 0 THEN greatest(1, CAST(round(total / {BLOCK}) AS BIGINT)) ELSE 0 END AS house FROM r),
q AS (SELECT *, CASE WHEN total > 0 THEN CAST(least(floor(target * house / total + 0.5), blocks * 2) AS BIGINT) ELSE 0 END AS rounded FROM h),
g AS (SELECT *, house - sum(rounded) OVER () AS open FROM q),
seat AS (
  SELECT k, open, unnest(CASE WHEN open > 0 THEN range(rounded, CAST(least(rounded + open, blocks * 2) AS BIGINT))
                              ELSE range(CAST(greatest(rounded + open, 0) AS BIGINT), rounded) END) AS n, target FROM g),
pick AS (SELECT k, sign(open) AS step FROM seat
  QUALIFY row_number() OVER (ORDER BY sign(open) * -(target / (2 * n + 1)), sign(open) * (k = 'n')::INT, k) <= abs(open)),
p AS (SELECT g.k, source_size, target, blocks, rounded + coalesce((SELECT sum(step) FROM pick WHERE pick.k = g.k), 0) AS seats FROM g),
a AS (
  SELECT doc_id, size, source_size, target, CAST(blocks AS BIGINT) AS blocks,
    CASE WHEN blocks > 0 THEN CAST(floor(seats / blocks) AS BIGINT) ELSE 0 END AS passes, CAST(seats AS BIGINT) AS seats,
    CAST(coalesce(sum(size) OVER (PARTITION BY k ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM d JOIN p ON coalesce('s' || d.source, 'n') = p.k),
b AS (SELECT *, seats - passes * blocks AS picks,
    CASE WHEN blocks % {STRIDES[0]} != 0 THEN {STRIDES[0]} WHEN blocks % {STRIDES[1]} != 0 THEN {STRIDES[1]} ELSE {STRIDES[2]} END AS stride FROM a)
SELECT doc_id, size, source_size, target,
  CAST(passes * size + coalesce(list_sum(list_transform(
    range(place // {BLOCK}, CASE WHEN size > 0 THEN (place + size - 1) // {BLOCK} + 1 ELSE place // {BLOCK} END),
    lambda x: CASE WHEN (x * (stride % blocks) + {sum(map(ord, SEED)) * 7919}) % blocks < picks
         THEN least(place + size, (x + 1) * {BLOCK}) - greatest(place, x * {BLOCK}) ELSE 0 END)), 0) AS BIGINT) AS taken
FROM b
"""
