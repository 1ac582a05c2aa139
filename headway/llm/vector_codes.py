"""Product codes of vectors: codebooks by rounds of assignment, nearest entries by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import stored
from headway.llm.topk import scaled

PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256
#: Scaled components are at most this far from zero, so that squared distances fit into a long.
LARGEST = 1 << 26
#: Vectors that a task searches at a time.
ROWS = 4_096


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of ``book`` for each of ``points``, ties to the lower index.

    Entries are sorted by component sum. A point starts where its own sum falls and looks at entries
    right and left of it in turn. By Cauchy-Schwarz a squared distance is at least the squared gap of
    the sums over the dimension, so a side is done once that strictly exceeds the best distance: an
    entry that ties and has a lower index is still seen. All points move at once.
    """
    total = book.sum(1)
    order = np.argsort(total, kind="stable")
    sums, entries = total[order], book[order]
    own, width = points.sum(1), points.shape[1]
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.full(len(points), len(book))
    right = np.searchsorted(sums, own)
    left = right - 1
    open_ = [np.flatnonzero(right < len(sums)), np.flatnonzero(left >= 0)]
    while len(open_[0]) or len(open_[1]):
        for side, (place, step) in enumerate(((right, 1), (left, -1))):
            rows = open_[side]
            gap = (own[rows] - sums[place[rows]]).astype(float)
            rows = rows[gap * gap <= best[rows].astype(float) * (width * (1 + 1e-12))]  # exact below 10^12, else a look too many
            j = place[rows]
            d = ((points[rows] - entries[j]) ** 2).sum(1)
            nearer = (d < best[rows]) | ((d == best[rows]) & (order[j] < index[rows]))
            best[rows[nearer]], index[rows[nearer]] = d[nearer], order[j[nearer]]
            place[rows] += step
            open_[side] = rows[(place[rows] >= 0) & (place[rows] < len(sums))]
    return index, best


@dataclass(frozen=True)
class Codebooks:
    """Entries (parts, entries, width) of whole numbers; at most 64 entries of a vector's length."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (rows, parts) and squared distance (rows, parts) of the nearest entries."""
        cut = vectors.reshape(len(vectors), len(self.entries), -1)
        found = [nearest(np.ascontiguousarray(cut[:, p]), book) for p, book in enumerate(self.entries)]
        return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            yield batch.slice(start, ROWS)


def first_books(vectors: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the ``entries`` vectors with the smallest ids; None without a vector that can be cut."""
    rows = vectors.filter("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).collect()
    if not rows or not rows[0].v or len(rows[0].v) % parts:
        return None
    book = np.array([r.v for r in rows if len(r.v) == len(rows[0].v)], np.int64)
    return Codebooks(book.reshape(len(book), parts, -1).transpose(1, 0, 2).copy())


def improved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, entries become floors of their parts' means.

    Tasks send sums and counts of at most parts x entries rows for each batch; their totals, as many
    rows at most, come to the driver. Entries without parts stay.
    """
    parts, entries, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width), np.int64)
        count = np.zeros(parts * entries, np.int64)
        for batch in batches_of(batches):
            v = matrix(batch.column(0), parts * width)
            slot = books.assign(v)[0] + np.arange(parts) * entries
            count += np.bincount(slot.ravel(), minlength=len(count))
            np.add.at(total, slot.ravel(), v.reshape(-1, width))
        used = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), pa.array(total[used].ravel()))
        yield pa.record_batch([pa.array(used), pa.array(count[used]), sums], ["slot", "n", "total"])

    found = vectors.select("v").mapInArrow(sums, "slot bigint, n bigint, total array<bigint>")
    means = found.groupBy("slot").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    )
    new = books.entries.reshape(parts * entries, width).copy()
    for slot, n, *total in means.collect():
        new[slot] = [t // n for t in total]
    return Codebooks(new.reshape(parts, entries, width))


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of ``vectors`` (vec_id, label, v).

    ``v`` holds whole numbers (``topk.scaled``); rows whose ``v`` is null are dropped, and so are
    vectors with another length than that of the smallest vec_id, with a component beyond 2^26 (their
    squared distances might not fit), and, if the length is no multiple of ``parts``, all. Null vec_ids
    are coded but begin no codebook; of equal vec_ids the smaller vector comes first. Rows that repeat
    count each time. label_error adds up the rows of an equal label, nulls together. An empty table
    gives no rows; other columns of ``vectors`` play no part.
    """
    fits = ~F.exists("v", lambda x: F.abs(x) > LARGEST)
    kept = stored(vectors.filter(F.col("v").isNotNull() & fits).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "v"), "vector-parts")
    books = first_books(kept, parts, entries)
    if books is None:
        kept, books = kept.limit(0), Codebooks(np.zeros((parts, 0, 1), np.int64))
    kept = kept.filter(F.size("v") == books.entries.shape[0] * books.entries.shape[2])
    if books.entries.size:
        for _ in range(rounds):
            books = improved(kept, books)
    width = books.entries.shape[0] * books.entries.shape[2]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            index, distance = books.assign(matrix(batch.column(2), width))
            text = ["".join([f"{i:02x}" for i in row]) for row in index.tolist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text), pa.array(distance.sum(1))], ["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    coded = stored(kept.mapInArrow(codes, f"vec_id bigint, label {label}, code string, error bigint"), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256")
    )


def vectors_of(embeddings: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(vec_id, label, v) of a table of embeddings; components become floor(factor * x)."""
    return embeddings.select("vec_id", "label", scaled(F.col("embedding"), factor).alias("v"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows in SQL, every part against every entry."""
    assign = """
d{r} AS (
  SELECT x.id, x.p, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS d
  FROM part x JOIN book{r} b ON x.p = b.p),
a{r} AS (SELECT id, p, e, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY id, p ORDER BY d, e) = 1)"""
    update = """
s{r} AS (
  SELECT a.p, a.e, i, sum(x.v[i]) AS t, count(*) AS n
  FROM a{r} a JOIN part x ON x.id = a.id AND x.p = a.p, unnest(range(1, len(x.v) + 1)) AS u(i) GROUP BY a.p, a.e, i),
m{r} AS (SELECT p, e, list(CAST(floor(t / n) AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY p, e),
book{next} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)"""
    steps = []
    for r in range(rounds):
        steps += [assign.format(r=r), update.format(r=r, next=r + 1)]
    steps.append(assign.format(r=rounds))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (
  SELECT id, p, list_slice(v, CAST(p * (len(v) // {parts}) + 1 AS BIGINT), CAST((p + 1) * (len(v) // {parts}) AS BIGINT)) AS v
  FROM kept, unnest(range({parts})) AS u(p)),
book0 AS (SELECT p, id - 1 AS e, v FROM part WHERE id <= {entries}),{",".join(steps)},
code AS (
  SELECT id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY id),
hash AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.h AS codebooks_sha256
FROM kept k JOIN code c ON c.id = k.id CROSS JOIN hash h
"""


ORACLE = _sql()
