"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import positions, stored
from headway.llm.tokens import as_array, pieces

CAPACITY = 2048
END = 0
#: Words whose ids are laid out at a time; a longer text is laid out alone.
WORDS_AT_ONCE = 1 << 18
#: Ranks that one row of the expanded plan covers before it becomes single slots.
RUN = 4096
#: Words of plain Latin letters with closing marks: encoded once per batch, letters apart from marks.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
MARKS = ".,!?;:|"


class WordEncoder:
    """Token ids of whole texts from a tokenizer file whose words are split at white space.

    Each different word of a batch goes to the tokenizer once. Words of plain letters are sent in the
    byte alphabet of the vocabulary, already split, which spares the tokenizer its normaliser; all
    others are sent as they are. Results equal encoding the whole text.
    """

    def __init__(self, path: str) -> None:
        # Spark runs a task per core; threads of the tokenizer would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.split = Tokenizer.from_file(path)
        self.split.normalizer = None
        self.split.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.final = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.final[i] = token.endswith("</w>")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.table[32] = " "

    def plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case letter words, one after the other, and the number of each word's ids."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lines = [" ".join(words[i : i + 500]).encode().decode("latin-1").translate(self.table) for i in range(0, len(words), 500)]
        # An encoding holds far more than its ids, so only some lines are encoded at a time.
        parts = (self.split.encode_batch_fast(lines[i : i + 16], add_special_tokens=False) for i in range(0, len(lines), 16))
        ids = np.concatenate([np.array(e.ids, np.uint32) for part in parts for e in part])
        ends = np.flatnonzero(self.final[ids]) + 1
        return ids, np.diff(ends, prepend=0)

    def any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        got = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Ids of a run of texts one after the other and the first of each (n + 1 bounds), with the run's first text."""
        lists = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        words = pc.dictionary_encode(lists.flatten())
        del lists
        code, kinds = words.indices.to_numpy(), words.dictionary
        core = pc.utf8_rtrim(kinds, characters=MARKS)
        easy = pc.match_substring_regex(core, PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        core = core.filter(pa.array(easy))
        simple = pc.dictionary_encode(pc.utf8_lower(core))
        whole = kinds.filter(pa.array(easy))
        marks = pc.binary_length(whole).to_numpy() - pc.binary_length(core).to_numpy()
        marked = np.flatnonzero(marks)
        tail = [w[-n:] for w, n in zip(whole.take(pa.array(marked)).to_pylist(), marks[marked].tolist(), strict=True)]  # marks are one byte each
        tail_kinds = sorted(set(tail))
        hard = kinds.filter(pa.array(~easy)).to_pylist()
        coded = [self.plain(simple.dictionary.to_pylist()), self.any(tail_kinds), self.any(hard)]
        pool = np.concatenate([ids for ids, _ in coded])
        count = np.concatenate([n for _, n in coded]).astype(np.int32)
        start = (np.cumsum(count) - count).astype(np.int32)
        # Each kind of word is one or two runs of the pool: its letters or all of it, then its marks.
        first = np.zeros((len(kinds), 2), np.int32)
        many = np.zeros((len(kinds), 2), np.int32)
        head = simple.indices.to_numpy()
        first[easy, 0], many[easy, 0] = start[head], count[head]
        place = {t: len(coded[0][1]) + i for i, t in enumerate(tail_kinds)}
        at = np.array([place[t] for t in tail], np.int64)
        marked = np.flatnonzero(easy)[marked]
        first[marked, 1], many[marked, 1] = start[at], count[at]
        others = np.arange(len(hard)) + len(coded[0][1]) + len(tail_kinds)
        first[~easy, 0], many[~easy, 0] = start[others], count[others]
        block = bounds[:-1] // WORDS_AT_ONCE
        for a in [0, *(np.flatnonzero(np.diff(block)) + 1).tolist()] if len(block) else []:
            b = int(np.searchsorted(block, block[a], "right"))
            mine = code[bounds[a] : bounds[b]]
            runs, lengths = first[mine].ravel(), many[mine].ravel()
            after = np.concatenate([[0], np.cumsum(lengths)])
            ids = pool[np.repeat(runs - after[:-1], lengths) + np.arange(after[-1])]
            yield a, ids, after[(bounds[a : b + 1] - bounds[a]) * 2]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this Python worker, which later tasks use again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _pieces_of(keys: list, ids: np.ndarray, bounds: np.ndarray, capacity: int, with_ids: bool) -> pa.RecordBatch:
    rows: list[tuple] = []
    lists = []
    for i, key in enumerate(keys):
        mine = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(END)).astype("<u4")
        for k, a in enumerate(range(0, len(mine), capacity)):
            part = mine[a : a + capacity]
            rows.append((key, k, a, len(part), zlib.crc32(part.tobytes())))
            if with_ids:
                lists.append(part.astype(np.int32))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    out = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        out, names = [*out, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
    return pa.record_batch(out, names)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids).

    A document's ids are those of its whole text and one end id; a null or empty text has the end id
    alone. Only documents that are longer are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for begin, texts in pieces(as_array(batch.column(1)), 1 << 22):
                keys = batch.column(0).slice(begin, len(texts)).to_pylist()
                for base, ids, bounds in encoder.encode(texts):
                    yield _pieces_of(keys[base : base + len(bounds) - 1], ids, bounds, capacity, with_ids)
                pa.default_memory_pool().release_unused()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, items, first sequence, items per sequence, offset).

    Lengths go from long to short. Sequences with the same fill are one group; a length goes to the
    groups with the least room that still fits it, each sequence taking as many as it can, and what is
    left opens new sequences. The work depends on the number of different lengths alone.
    """
    room: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence, number
    out, fresh = [], 0

    def put(left: int, first: int, number: int) -> None:
        if left and number:
            if left not in groups:
                insort(room, left)
                groups[left] = []
            groups[left].append((first, number))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        count, rank = histogram[length], 0
        at = bisect_left(room, length)
        later: list[tuple[int, int, int]] = []
        while rank < count and at < len(room):
            left = room[at]
            each = left // length
            while groups[left] and rank < count:
                first, number = groups[left].pop()
                full = min(number, (count - rank) // each)
                if full:
                    out.append((length, rank, full * each, first, each, capacity - left))
                    later.append((left - each * length, first, full))
                    rank += full * each
                rest = count - rank
                if full < number and rest:  # fewer than ``each`` items are left
                    out.append((length, rank, rest, first + full, rest, capacity - left))
                    later.append((left - rest * length, first + full, 1))
                    rank, full = count, full + 1
                if full < number:
                    groups[left].append((first + full, number - full))
            if groups[left]:
                break
            del groups[left]
            room.pop(at)
        each = capacity // length
        full, rest = divmod(count - rank, each)
        if full:
            out.append((length, rank, full * each, fresh, each, 0))
            later.append((capacity - each * length, fresh, full))
            rank, fresh = rank + full * each, fresh + full
        if rest:
            out.append((length, rank, rest, fresh, rest, 0))
            later.append((capacity - rest * length, fresh, 1))
            fresh += 1
        for item in later:
            put(*item)
    return out


def slots(spark: SparkSession, runs: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """One row per planned slot (length, rank, sequence_id, offset), expanded in two bounded steps.

    An Arrow table becomes rows without Python workers; Spark takes what becomes of it for small, so the
    slots are hinted to be merged.
    """
    names = ["length", "rank0", "items", "first", "each", "base"]
    rows = spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in zip(*runs, strict=True)], names))
    rows = rows.withColumn("_part", F.explode(F.expr("sequence(0L, (items - 1) div %d)" % RUN)))
    rows = rows.repartition("length", "rank0", "_part")
    rows = rows.withColumn("_i", F.explode(F.expr("sequence(_part * %d, least(items, (_part + 1) * %d) - 1)" % (RUN, RUN))))
    return rows.select(
        "length",
        (F.col("rank0") + F.col("_i")).alias("rank"),
        F.expr("first + _i div each").alias("sequence_id"),
        F.expr("base + _i % each * length").alias("offset"),
    ).hint("merge")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (length and keys, stored) with sequence_id and offset.

    The histogram of lengths, at most ``capacity`` rows, is planned on the driver; pieces get their
    rank within their length by a distributed sort and take the slot with that length and rank by an
    equi-join. Ties and repeated rows take different slots.
    """
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    if not counts:
        return parts.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    ranked = positions(parts, ["length"], ["doc_id", "piece"], "rank", "pack-ranks")
    return ranked.join(slots(parts.sparkSession, plan(counts, capacity)), ["length", "rank"]).drop("rank")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each piece with its sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty, which is one end id. A document that appears twice is packed twice; a null id
    is kept. An empty table gives no rows; other columns play no part.
    """
    parts = stored(cut(docs, path, capacity), "pieces")
    return pack(parts, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
