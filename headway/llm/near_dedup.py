"""Near duplicates by SetSketch registers: banded, judged by joint likelihood, verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm import exact_dedup
from headway.llm.common import same_id_links, small, stored, text_or_empty, with_components
from headway.llm.tokens import U, as_array, hashes, mix, owners, pieces

WORDS, PERCENT = 5, 80
#: Registers are bands x rows. A pair of similarity s shares no band with chance (1 - s^rows)^bands:
#: 3e-6 at 0.80, 7e-9 at 0.85.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base of the exponential spacing, rate, largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: A pair is verified unless the likelihood of the bound is below the best one by this much.
DOUBT = 8.0
#: Documents and shingles of one block of a family; larger families meet in pairs of blocks.
BLOCK, BLOCK_SHINGLES = 128, 1_000_000
#: Bytes of text whose shingles are laid out at a time.
PIECE = 1 << 18


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the first of each (n + 1 bounds).

    Words are lower-cased (A-Z); a text with fewer words is one shingle of all of them; without words
    the set is empty.
    """
    found, bounds = hashes(texts)
    n = np.diff(bounds)
    row = owners(bounds)
    left = bounds[1:][row] - np.arange(len(found))  # words from here to the end of the text
    total = np.zeros(len(found), U)
    place = np.arange(len(found))
    for k in range(words):
        inside = left > k
        part = np.zeros(len(found), U)
        part[inside] = found[place[inside] + k]
        total = np.where(inside, mix(total * U(0x9E3779B97F4A7C15) + part + U(k + 1)), total)
    starts = (left >= words) | ((place == bounds[:-1][row]) & (n[row] < words))
    value, of = total[starts], row[starts]
    order = np.argsort(value, kind="stable")
    of = of[order]
    kind = np.uint16 if len(texts) < 1 << 16 else np.int64
    second = np.argsort(of.astype(kind), kind="stable")
    value, of = value[order][second], of[second]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[keep], of[keep]
    return value, np.searchsorted(of, np.arange(len(texts) + 1))


def registers(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch register values of each set (sets, REGISTERS).

    Each element is the seed of a Poisson process whose points fall on random registers; a register
    keeps the smallest point of all elements. An element stops once its next point can't lower any
    register of its set, so a set of n elements costs about n + m log m points. Minima of a union are
    the smaller ones, so sketches merge; values are minima on a logarithmic scale, cut to 16 bits.
    """
    sets = len(bounds) - 1
    least = np.full(sets * REGISTERS, np.inf)
    of = owners(bounds)
    at = np.arange(len(value))
    reached = np.zeros(len(value))
    step, done = 1, 0
    while len(at):
        turn = (np.arange(done, done + step, dtype=np.uint64) + U(1)) * U(0xD1B54A32D192ED03)
        seed = mix(value[at][:, None] + turn[None, :])
        gap = -np.log(((seed >> U(32)).astype(np.float64) + 0.5) / 2**32) / REGISTERS
        x = reached[at][:, None] + np.cumsum(gap, axis=1)
        slot = (((seed & U(0xFFFFFFFF)) * U(REGISTERS)) >> U(32)).astype(np.int64)
        np.minimum.at(least, (of[at][:, None] * REGISTERS + slot).ravel(), x.ravel())
        reached[at] = x[:, -1]
        bar = least.reshape(sets, REGISTERS).max(1)
        at = at[reached[at] < bar[of[at]]]
        done += step
        step = min(64, max(1, done // 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(np.nan_to_num(level, neginf=0), 0, TOP).astype(np.uint16).reshape(sets, REGISTERS)


def set_keys(value: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Two hashes of each set, equal for equal sets; 0 for empty ones."""
    n = np.diff(bounds)
    key = [np.append(np.cumsum(mix(value ^ U(salt))), U(0)) for salt in (0x51, 0xA7)]
    key = [np.where(n > 0, k[bounds[1:] - 1] - np.where(bounds[:-1] > 0, k[bounds[:-1] - 1], U(0)), U(0)) for k in key]
    return [pa.array(k.view(np.int64)) for k in key]


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (size of the shingle set), key (equal for equal sets), bands, sketch and digest of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(as_array(batch.column(1)), PIECE):
                value, bounds = shingles(texts, words)
                n = np.diff(bounds)
                got = registers(value, bounds)
                band = np.zeros((len(texts), BANDS), U)
                parts = got.reshape(len(texts), BANDS, ROWS).astype(U)
                for r in range(ROWS):
                    band = mix(band * U(0x9E3779B97F4A7C15) + parts[:, :, r] + U(1))
                band = mix(band + np.arange(BANDS, dtype=np.uint64) * U(0xA24BAED4963EE407))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array(n),
                        *set_keys(value, bounds),
                        pa.array([b if k else [] for b, k in zip(band.view(np.int64), n, strict=True)], pa.list_(pa.int64())),
                        pa.array([r.tobytes() for r in got], pa.binary()),
                        batch.column(2).slice(start, len(texts)),
                    ],
                    ["doc_id", "n", "key1", "key2", "bands", "sketch", "digest"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), exact_dedup.digest(text_or_empty()).alias("digest"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, key1 bigint, key2 bigint, bands array<bigint>, sketch binary, digest binary")


def likely(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, bound: float) -> np.ndarray:
    """Pairs (a row, b row) whose similarity may reach ``bound``, by the joint likelihood of both sketches.

    The counts of registers where a is larger, b is larger, or both are equal have known chances given
    both sizes and the similarity; the best similarity is found by ternary search.
    """
    more = (a[:, None, :] > b[None, :, :]).sum(2)
    same = (a[:, None, :] == b[None, :, :]).sum(2)
    out = same >= bound * REGISTERS
    i, j = np.nonzero(~out & (same >= (bound - 0.35) * REGISTERS))
    if not len(i):
        return out
    u = na[i] / (na[i] + nb[j])
    v = 1 - u
    plus, equal = more[i, j].astype(float), same[i, j].astype(float)
    minus = REGISTERS - plus - equal
    chance = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9)

    def value(s: np.ndarray) -> np.ndarray:
        p, q = chance(u - v * s), chance(v - u * s)
        return plus * np.log(p) + minus * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-9))

    top = np.minimum(u / v, v / u)
    low, high = np.zeros_like(top), top.copy()
    for _ in range(24):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        up = value(x) < value(y)
        low, high = np.where(up, x, low), np.where(up, high, y)
    best = (low + high) / 2
    out[i, j] = (best >= bound) | ((value(best) - value(np.minimum(bound, top)) <= DOUBT) & (top >= bound - 1e-9))
    return out


def _sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two blocks that meet (the same ones, if a block meets itself)."""
    own = rows["own"].to_numpy()
    every = np.arange(len(rows))
    if rows["low"].iloc[0] == rows["high"].iloc[0]:
        return every, every
    return every[own == rows["low"].iloc[0]], every[own == rows["high"].iloc[0]]


def overlap(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of incidence columns, over shingles that two sets have."""
    everything = np.concatenate(sets) if sets else np.zeros(0, U)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, many = np.unique(everything, return_inverse=True, return_counts=True)
    shared = many > 1
    new = np.cumsum(shared) - 1
    use = shared[code]
    row, col = row[use], new[code[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)))
    width = 1 << 14
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [a, a + width])
        table = np.zeros((len(sets), width), np.float32)
        table[row[lo:hi], col[lo:hi] - a] = 1
        out += table @ table.T
    return np.rint(out).astype(np.int64)


def forest(link: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges (smallest id, other id) of the connected sets of a link matrix."""
    label = np.arange(len(ids))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    label = rank.copy()
    while True:
        best = np.where(link, label[None, :], len(ids)).min(1, initial=len(ids))
        new = np.minimum(label, best)
        if (new == label).all():
            break
        label = new
    by_rank = np.sort(ids)
    return [(int(by_rank[a]), int(i)) for a, i in zip(label, ids, strict=True) if by_rank[a] != i]


KEY = ["key1", "key2", "n"]


def linked_sets(every: DataFrame, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct shingle sets (key1, key2, n, rep, node) of the rows ``every`` of ``sketch``, and links (src, dst) of their nodes.

    ``rep`` is the smallest doc_id with the set; ``node`` is a number of the set's own, as one doc_id may
    occur with several texts.
    """
    bound = percent / 100
    real = every.filter("n > 0 AND doc_id IS NOT NULL")
    same = real.groupBy(*KEY).agg(F.min("doc_id").alias("rep"))
    same = stored(same.withColumn("node", F.monotonically_increasing_id()), "near-reps")
    heads = real.join(same.select(*KEY, F.col("rep").alias("doc_id"), "node"), [*KEY, "doc_id"])
    heads = stored(heads.select(F.col("node").alias("doc_id"), "n", "bands", "sketch").dropDuplicates(["doc_id"]), "near-heads")

    members = heads.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("_last"))
    buckets = stored(buckets.filter("lead < _last").drop("_last"), "near-buckets")
    pairs = stored(members.join(buckets, "bucket").groupBy("doc_id", "lead").agg(F.lit(1).alias("_")).drop("_"), "near-leads")
    first = pairs.groupBy("doc_id").agg(F.min("lead").alias("top")).select(F.col("doc_id").alias("lead"), "top")
    joined = pairs.join(stored(first, "near-tops"), "lead").select("doc_id", F.col("top").alias("family")).distinct()
    joined = stored(joined.join(heads.select("doc_id", "n", "sketch"), "doc_id"), "near-families")

    sizes = joined.groupBy("family").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_s")).filter("_n > 1")
    blocks = F.ceil(F.greatest(F.col("_n") / BLOCK, F.col("_s") / BLOCK_SHINGLES)).cast("int")
    sizes = stored(sizes.select(F.col("family").alias("_f"), blocks.alias("_b")), "near-sizes")
    met = joined.join(sizes, F.col("family") == F.col("_f"))
    met = met.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("_b")).cast("int"))
    met = met.withColumn("_other", F.explode(F.expr("sequence(0, _b - 1)")))
    met = met.select("family", "doc_id", "n", "sketch", "own", F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"))

    def promising(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        a, b = _sides(rows)
        k = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(len(rows), REGISTERS)
        n = rows["n"].to_numpy().astype(float)
        hit = np.zeros(len(rows), bool)
        for i in range(0, len(a), 32):  # keeps the compared registers small
            part = a[i : i + 32]
            near = likely(k[part], n[part], k[b], n[b], bound)
            near &= part[:, None] != b[None, :]
            hit[part] |= near.any(1)
            hit[b] |= near.any(0)
        return rows.loc[hit, ["family", "low", "high", "own", "doc_id"]]

    cell = ["family", "low", "high"]
    hopeful = stored(met.groupBy(*cell).applyInPandas(promising, "family bigint, low int, high int, own int, doc_id bigint"), "near-hopeful")
    wanted = hopeful.select(F.col("doc_id").alias("node")).distinct().join(same, "node")
    wanted = stored(wanted.select("node", "key1", "key2", F.col("rep").alias("_id")), "near-wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(as_array(batch.column(1)), PIECE):
                value, at = shingles(texts, words)
                yield pa.record_batch(
                    [batch.column(0).slice(start, len(texts)), *set_keys(value, at), pa.array([value[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())],
                    ["_id", "key1", "key2", "shingles"],
                )

    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full = full.join(small(wanted.select("_id").distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    full = full.mapInArrow(sets, "_id bigint, key1 bigint, key2 bigint, shingles binary").join(wanted, ["_id", "key1", "key2"])
    full = stored(full.select(F.col("node").alias("doc_id"), "shingles").dropDuplicates(["doc_id"]), "near-sets")

    def verified(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        a, b = _sides(rows)
        values = [np.frombuffer(x, U) for x in rows["shingles"]]
        n = np.array([len(x) for x in values])
        both = overlap(values)
        link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        mask = np.zeros_like(link)
        mask[np.ix_(a, b)] = True
        link &= mask | mask.T
        edges = forest(link, rows["doc_id"].to_numpy())
        return pd.DataFrame(edges, columns=["src", "dst"]).astype("int64")

    links = hopeful.join(full, "doc_id").groupBy(*cell).applyInPandas(verified, "src bigint, dst bigint")
    return same, stored(links.distinct(), "near-links")


def named(same: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct sets (key1, key2, n) with ``group``, the smallest node that links reach, and ``component``, the smallest rep there."""
    found = with_components(same.select(*KEY, F.col("rep").alias("doc"), F.col("node").alias("rep")), links)
    found = stored(found, "near-nodes")
    least = found.groupBy("component").agg(F.min("doc").alias("_c"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return found.join(least, "component", "left").select(*KEY, F.col("component").alias("group"), F.coalesce("_c", "doc").alias("component"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked;
    component_id is the smallest doc_id that links reach, and that document is kept. Equal sets collapse
    to one representative first. Representatives that share a band value are a family (named after the
    smallest one, and merged with that one's own family); no pairs are emitted: families meet in blocks
    of bounded size inside tasks, where the joint likelihood of the sketches finds who may have a
    partner, and for those the full sets are compared and a forest of links goes on. Links are lost only
    if a pair shares no band. Null, empty and blank texts have empty sets and no links, so such a row is
    its own component; rows with a null doc_id aren't linked and are kept; rows that repeat a doc_id
    with words are one node, whose texts link on. An
    empty table gives no rows; other columns play no part.
    """
    every = stored(sketch(docs, words), "sketches")
    same, links = linked_sets(every, docs, words, percent)
    real = every.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", *KEY)
    more = same_id_links(real, same.select(*KEY, F.col("node").alias("rep")), KEY)
    links = stored(links.unionByName(more).filter("src <> dst").distinct(), "near-all-links")
    final = stored(named(same, links).select("key1", "key2", F.col("component").alias("_c")), "near-final")
    out = every.select("doc_id", "n", "key1", "key2").join(final, ["key1", "key2"], "left")
    out = out.withColumn("_c", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("_c")).otherwise(F.col("doc_id")))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("_c").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("_c")).alias("kept"),
    )


def kept_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` of each group of near copies, with all its columns.

    Groups are made of texts, not of ids: where an id occurs with several texts, those that nothing
    resembles stay. Of a group the row with the smallest doc_id stays, ties to the smaller SHA-256 of the
    text. Rows that repeat id and text are left once; rows without an id or without words aren't
    compared. An empty table gives no rows; columns may have any names.
    """
    every = stored(sketch(docs, words), "sketches")
    final = named(*linked_sets(every, docs, words, percent))
    rows = every.filter("n > 0 AND doc_id IS NOT NULL").join(stored(final, "near-final"), KEY)
    first = stored(rows.groupBy("group").agg(F.min(F.struct("doc_id", "digest")).alias("_first")), "near-first")
    judged = rows.join(first, "group").select("doc_id", "digest", (F.struct("doc_id", "digest") == F.col("_first")).alias("kept"))
    lone = every.filter("n = 0 OR doc_id IS NULL").select("doc_id", "digest", F.lit(True).alias("kept"))
    result = judged.unionByName(lone).select("doc_id", F.hex("digest").alias("text_sha256"), "kept")
    return exact_dedup.kept_rows(docs, result)
