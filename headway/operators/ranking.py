"""Global positions without a global window."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.session import freeze

#: Parts of a range that are counted at a time.
BUCKETS = 1024


def dense_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """Positions 0..N-1 in the given order, computed by all partitions in parallel.

    A range sort puts ordered blocks into partitions; the sorted rows are checkpointed so that
    ids cannot move if an executor is lost; each block then adds the size of the blocks before
    it. The offsets table has one row per partition, which bounds the broadcast.
    """
    block_bits = 33
    tagged = freeze(df.sort(*order).withColumn("_mid", F.monotonically_increasing_id()))
    block = F.shiftright("_mid", block_bits)
    sizes = tagged.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_mid") - F.shiftleft(block, block_bits)
    return (
        tagged.withColumn("_block", block)
        .join(F.broadcast(offsets), "_block")
        .withColumn(name, F.col("_offset") + inside)
        .drop("_block", "_offset", "_mid")
    )


def order_statistics(df: DataFrame, value: str, ranks: Callable[[int], list[int]]) -> tuple[int, dict[int, int]]:
    """Number of non-null whole numbers of ``value``, and those at the sorted positions ``ranks(n)`` (from 0).

    Each pass counts the values of the ranges that hold a rank in BUCKETS parts, map-side, and goes on
    with the part that the rank falls in; a range of 2^40 numbers takes four passes. Nothing is sorted,
    and at most ranks x BUCKETS counts come to the driver.
    """
    held = df.select(F.col(value).cast("long").alias("v")).filter("v IS NOT NULL")
    low, high, n = held.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    open_ = {r: (low, high, r) for r in ranks(n)} if n else {}
    while any(lo < hi for lo, hi, _ in open_.values()):
        spans = sorted({(lo, hi) for lo, hi, _ in open_.values() if lo < hi})
        place, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (lo, hi) in enumerate(spans):  # ranges are disjoint
            inside = F.col("v").between(lo, hi)
            place = F.when(inside, F.lit(i)).otherwise(place)
            bucket = F.when(inside, F.expr(f"(v - ({lo}L)) div {_step(lo, hi)}L")).otherwise(bucket)
        counts = held.select(place.alias("span"), bucket.alias("bucket")).filter("span IS NOT NULL").groupBy("span", "bucket").count().collect()
        table: dict[int, list[tuple[int, int]]] = {}
        for row in counts:
            table.setdefault(row["span"], []).append((row["bucket"], row["count"]))
        for rank, (lo, hi, left) in open_.items():
            if lo < hi:
                step = _step(lo, hi)
                for b, count in sorted(table[spans.index((lo, hi))]):
                    if left < count:
                        open_[rank] = (lo + b * step, min(hi, lo + (b + 1) * step - 1), left)
                        break
                    left -= count
    return n, {r: lo for r, (lo, _, _) in open_.items()}


def _step(low: int, high: int) -> int:
    return (high - low) // BUCKETS + 1


def exclusive_quartiles(df: DataFrame, value: str, prefix: str = "q") -> DataFrame:
    """Quartiles of whole numbers by the exclusive rule, position p(n+1) with linear interpolation, cut to integers."""

    def cut(n: int, i: int) -> tuple[int, int]:
        at = max(min(i * (n + 1) // 4, n - 1), 1)
        return at, i * (n + 1) - at * 4

    def wanted(n: int) -> list[int]:
        return [0] if n == 1 else sorted({p for i in (1, 2, 3) for p in (cut(n, i)[0] - 1, cut(n, i)[0])})

    n, found = order_statistics(df, value, wanted)
    row: list[int | None] = [None] * 3
    if n == 1:
        row = [found[0]] * 3
    elif n:
        row = [int((found[at - 1] * (4 - w) + found[at] * w) / 4) for at, w in (cut(n, i) for i in (1, 2, 3))]
    return df.sparkSession.range(1).select(*[F.lit(q).cast("long").alias(f"{prefix}{i}") for i, q in enumerate(row, 1)])


def continuous_percentile(df: DataFrame, value: str, p: float) -> Column:
    """Exact interpolated percentile of whole numbers at position p(n-1), as a literal; null without values."""
    ends = lambda n: sorted({math.floor((n - 1) * p), math.ceil((n - 1) * p)})
    n, found = order_statistics(df, value, ends)
    if not n:
        return F.lit(None).cast("double")
    low, high = found[ends(n)[0]], found[ends(n)[-1]]
    return F.lit(low + (high - low) * ((n - 1) * p - math.floor((n - 1) * p)))
