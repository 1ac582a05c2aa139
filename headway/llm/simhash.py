"""SimHash near duplicates: XXH64 fingerprints, shards by agreeing parts, a BK-tree per shard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import same_id_links, stored, with_components
from headway.llm.tokens import as_array, pieces

WORDS, RADIUS, SEED = 3, 2, 42
#: A fingerprint is cut into this many parts of 16 bits; radius 2 leaves at least two of four untouched.
PARTS = 4
#: A shard with more fingerprints is cut again.
SHARD = 4_096
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
SPACE = b" \t\n\r\x0b\x0c"


def word_lists(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) words of a text, in lists of about ``piece`` bytes, cut at white space."""
    at = 0
    while len(data) - at > piece:
        end = max(data.rfind(bytes([s]), at + 1, at + piece) for s in SPACE)
        if end < 0:  # one word longer than a piece
            end = min((e for s in SPACE if (e := data.find(bytes([s]), at + 1)) >= 0), default=len(data))
        yield data[at:end].lower().split()
        at = end
    yield data[at:].lower().split()


def shingle_hashes(data: bytes, words: int = WORDS, piece: int = PIECE) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, repeats included, in bounded pieces."""
    kept: list[bytes] = []
    whole = True
    for found in word_lists(data, piece):
        kept += found
        if len(kept) < words:
            continue
        whole = False
        line = b" ".join(kept)
        ends = np.cumsum(np.fromiter(map(len, kept), np.int64, len(kept)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(kept) - words + 1]
        hashed = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
        yield np.array(hashed, np.uint64)
        kept = kept[len(kept) - words + 1 :] if words > 1 else []
    if whole and kept:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], np.uint64)


def majority(values: list[np.ndarray]) -> int:
    """Bits that are set in more than half of the hashes."""
    count, total = np.zeros(64, np.int64), 0
    for h in values:
        total += len(h)
        lanes = h.view(np.uint8).reshape(-1, 8)
        if len(h) < 256:
            count += np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:  # how often each byte value occurs in each lane says how often each bit is set
            for lane in range(8):
                count[8 * lane : 8 * lane + 8] += np.bincount(lanes[:, lane], minlength=256) @ BITS
    return sum(1 << b for b in np.flatnonzero(2 * count > total).tolist())


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and the 64-bit fingerprint (as a signed long) of every document; no words give zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(as_array(batch.column(1)), PIECE):
                found = [majority(list(shingle_hashes(t.as_buffer().to_pybytes(), words))) for t in texts]
                yield pa.record_batch(
                    [batch.column(0).slice(start, len(texts)), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


class BKTree:
    """Fingerprints whose children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, radius: int) -> list[int]:
        """Nodes within ``radius`` of ``value``, which then becomes a node itself.

        From a node at distance d only edges d - radius to d + radius can lead to a hit. The edge d
        is among them, so the descent to the new node's place is part of the search.
        """
        hits: list[int] = []
        new = len(self.values)
        todo, place = ([0] if new else []), 0
        values, children = self.values, self.children
        while todo:
            node = todo.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                hits.append(node)
            edges = children[node]
            if node == place:
                if d in edges:
                    place = edges[d]
                else:
                    edges[d] = new
                    place = -1
            if len(edges) <= 2 * radius:
                todo += [child for edge, child in edges.items() if -radius <= edge - d <= radius and child != new]
            else:
                todo += [edges[edge] for edge in range(d - radius, d + radius + 1) if edge in edges and edges[edge] != new]
        values.append(value)
        children.append({})
        return hits


def shard_links(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (src, dst) inside each shard of rows (shard, fp) that come sorted by shard and fp.

    One tree is held at a time. A forest of links goes on, so a shard of n gives fewer than n rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, root = None, BKTree(), []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            src, dst = [], []
            for shard, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    now, tree, root = shard, BKTree(), []
                new = len(root)
                root.append(new)
                for node in tree.add(fp & 0xFFFFFFFFFFFFFFFF, radius):
                    other = top(node)
                    if other != top(new):
                        root[other] = top(new)
                        value = tree.values[node]
                        src.append(value - (1 << 64) if value >> 63 else value)
                        dst.append(fp)
            yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _bits(at: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))


def shards(values: DataFrame, limit: int = SHARD) -> DataFrame:
    """(shard, fp) rows such that two of the distinct ``values`` (fp) within two bits meet in a shard.

    Two differing bits touch at most two of four parts of 16 bits, so a pair agrees in two parts: a
    fingerprint goes to the six shards named by two of its parts. Shards of one are left out. A shard
    of more than ``limit`` is cut again in the same way by two of the four bytes that are still open;
    then 16 bits are open and a shard has at most 65,536 fingerprints, whatever the data.
    """
    pairs = [(a, b) for a in range(PARTS) for b in range(a + 1, PARTS)]
    first = [
        F.lit(7 * i << 48) + F.shiftleft(F.shiftleft(_bits(16 * a, 16), 16) + _bits(16 * b, 16), 16)
        for i, (a, b) in enumerate(pairs)
    ]
    rows = values.select("fp", F.posexplode(F.array(*first)).alias("pair", "shard"))
    sizes = stored(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "simhash-shards")
    rows = rows.join(sizes, "shard")
    again = F.lit(None)
    for i, (a, b) in enumerate(pairs):
        free = [16 * p + byte for p in range(PARTS) if p not in (a, b) for byte in (0, 8)]
        second = [
            F.col("shard") + F.lit(k + 1 << 48) + F.shiftleft(_bits(free[c], 8), 8) + _bits(free[d], 8) for k, (c, d) in enumerate(pairs)
        ]
        again = F.when(F.col("pair") == i, F.array(*second)).otherwise(again)
    return rows.select(F.explode(F.when(F.col("_n") > limit, again).otherwise(F.array("shard"))).alias("shard"), "fp")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, limit: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    smallest doc_id that links reach. Equal fingerprints collapse to one node first. Shards are
    streamed, sorted, through tasks that hold one BK-tree of at most 65,536 nodes at a time and send
    on a forest of links. Null, empty and blank texts have fingerprint zero and are linked like any
    other; rows with a null doc_id get a fingerprint, but component null, and link nothing; rows that
    repeat a doc_id are one node of the graph. An empty table gives no rows; other columns of ``docs``
    play no part. ``radius`` is 2 at most, as the shards are made for two bits.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    every = stored(fingerprints(docs, words), "simhash")
    known = every.filter("doc_id IS NOT NULL")
    reps = stored(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    cut = shards(reps.select("fp"), limit).repartition("shard").sortWithinPartitions("shard", "fp")
    found = stored(cut.mapInArrow(shard_links(radius), "src bigint, dst bigint"), "simhash-links").distinct()
    ends = [reps.select(F.col("fp").alias(end), F.col("rep").alias(f"{end}_rep")) for end in ("src", "dst")]
    found = found.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_rep").alias("src"), F.col("dst_rep").alias("dst"))
    links = stored(found.unionByName(same_id_links(known, reps, ["fp"])).filter("src <> dst").distinct(), "simhash-edges")
    final = stored(with_components(reps, links), "simhash-final")
    out = every.join(final, "fp", "left")
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
