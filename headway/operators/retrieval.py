"""Vector search and re-ranking."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.text_rules import strip
from headway.operators.joins import best_per_group, one_row

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1024  # queries of one piece
DOC_ROWS = 20_000  # documents of one piece
CELLS = 16  # pivots of the vector space: more of them skip more, but each vector is compared with each
SLACK = 1e-6  # radians by which a bound is widened, far above rounding
FOUND = "query_id long, doc_id long, similarity double"
TEXT_ROWS = 49_152  # documents of one piece of the keyword search
QUESTION_ROWS = 524_288  # questions of one block of it
ASKED_ROWS = 16_384  # questions that a task holds at once
LEAST = 6  # rare words that two texts must share before their frequent ones are looked up
FREQUENT = 4096  # words of a piece that are kept as bits
STEP = 64  # places between two marks in the list of a frequent word
LOOKUPS = 1_000_000  # about so many words are looked up at once
EVEN = 1e-6  # scores that differ by less are left to Spark
BATCH = 100_000  # pairs that a task holds before they leave it
PAIRS = "query_id long, doc_id long, common int, asked int, held int, boost double"
PAIR_FIELDS = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("common", pa.int32()), ("asked", pa.int32()), ("held", pa.int32()), ("boost", pa.float64())])
# fixed values: boosts and weights of the ranking
DOMAIN_TERMS = ["drt", "수요응답", "교통", "대중교통", "모빌리티", "교통체계"]
TYPE_BOOST = {"title": 0.2, "section": 0.15, "paragraph": 0.0, "list": 0.05, "table": 0.1, "figure": 0.05}
FRESHNESS = [("2025", 0.9), ("2024", 0.8), ("2023", 0.6)]
WEIGHTS = {"relevance": 0.4, "semantic": 0.3, "importance": 0.2, "freshness": 0.1}


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label, summed element-wise in a mergeable aggregate."""
    spread = vectors.select(label, F.posexplode(vector).alias("pos", "x"))
    means = spread.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return ordered.select(label, F.col("v.x").alias("centroid"))


def similar_top_k(
    documents: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.7, block: int = BLOCK, rows: int = DOC_ROWS, cells: int = CELLS
) -> DataFrame:
    """Exact best ``k`` documents per query with cosine at least ``threshold``; no job runs before an action.

    ``documents`` has (doc_id, vector), ``queries`` has (query_id, vector). Every vector belongs to the
    nearest of ``cells`` pivots, which are documents. The angle between two vectors is at least the angle
    between their pivots less both cells' radii, so a query cell meets only document cells that can reach
    the threshold. Cells are cut into pieces of about ``rows`` documents and ``block`` queries; a pair of
    pieces is one group, where queries too far from all documents of the piece are left out and k rows per
    query are kept. Small query cells share a piece, so a few queries move each document at most once.
    Only tables of at most ``cells`` rows (with at most ``cells`` entries each) are broadcast. Vectors
    that are null, zero or not finite, or hold a null, find nothing and are not found.
    """
    docs, asked = _usable(documents.select("doc_id", "vector")), _usable(queries.select("query_id", "vector"))
    pivots = _pivots(docs, cells)
    docs, asked = _in_cells(docs, pivots), _in_cells(asked, pivots)
    doc_cells = _cells(docs).withColumn("parts", F.ceil(F.col("n") / rows))
    query_cells = _cells(asked)
    before = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))  # at most ``cells`` rows
    query_cells = query_cells.withColumn("before", F.coalesce(before, F.lit(0)))
    pairs = _near_cells(doc_cells, query_cells, pivots, threshold)

    spans = F.collect_list(F.struct(F.floor(F.col("before") / block).alias("a"), F.floor((F.col("before") + F.col("asked") - 1) / block).alias("z")))
    met = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["z"]))))
    d = docs.join(F.broadcast(pairs.groupBy("cell", "parts").agg(spans.alias("spans"))), "cell").select(
        "doc_id", "vector", "cell", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"), F.explode(met).alias("piece")
    )
    targets = pairs.groupBy(F.col("query_cell").alias("cell"), "before", "asked").agg(F.collect_list(F.struct("cell", "parts")).alias("targets"))
    piece = F.floor((F.col("before") + F.pmod(F.xxhash64("query_id"), "asked")) / block)
    q = asked.join(F.broadcast(targets), "cell").select("query_id", F.col("vector").alias("target"), piece.alias("piece"), F.explode("targets").alias("t"))
    q = q.select("query_id", "target", "piece", F.col("t.cell").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("t.parts") - 1)).alias("part"))

    def search(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return _best(found, wanted, k, threshold)

    key = ["cell", "part", "piece"]
    best = d.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(search, FOUND)
    return best_per_group(best, ["query_id"], k, F.desc("similarity"), F.asc("doc_id"), rank="rank")


def _norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def _usable(frame: DataFrame) -> DataFrame:
    n = _norm(F.col("vector"))
    return frame.filter((n > 0) & (n < float("inf")))


def _pivots(docs: DataFrame, cells: int) -> Column:
    """Unit vectors of the documents with the smallest hashes, as one array (scalar subquery)."""
    norm = _norm(F.col("vector"))
    drawn = docs.select(F.xxhash64("doc_id").alias("h"), "doc_id", "vector", norm.alias("norm")).orderBy("h", "doc_id", "vector").limit(cells)
    ordered = F.sort_array(F.collect_list(F.struct("h", "doc_id", "vector", "norm")))
    return drawn.agg(F.transform(ordered, lambda r: F.transform(r["vector"], lambda x: x / r["norm"])).alias("pivots")).scalar()


def _in_cells(frame: DataFrame, pivots: Column) -> DataFrame:
    """Nearest pivot of each vector, from 0, and the cosine to it."""
    near = F.array_max(F.transform("pivots", lambda p, i: F.struct(_dot(p, F.col("vector")).alias("dot"), (-i).alias("i"))))
    found = frame.withColumn("pivots", pivots).withColumn("near", near).drop("pivots")
    return found.select("*", (-F.col("near.i")).alias("cell"), (F.col("near.dot") / _norm(F.col("vector"))).alias("cos")).drop("near")


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _cells(frame: DataFrame) -> DataFrame:
    return frame.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), _angle(F.min("cos")).alias("radius"))


def _near_cells(doc_cells: DataFrame, query_cells: DataFrame, pivots: Column, threshold: float) -> DataFrame:
    """Pairs of cells that may hold a pair of vectors at the threshold: at most cells x cells rows."""
    asked = query_cells.agg(F.collect_list(F.struct(F.col("cell").alias("query_cell"), F.col("n").alias("asked"), F.col("radius").alias("reach"), "before"))).scalar()
    pairs = doc_cells.withColumns({"q": F.explode(asked), "pivots": pivots}).select("cell", "parts", "radius", "q.*", "pivots")
    apart = _angle(_dot(F.element_at("pivots", F.col("cell") + 1), F.element_at("pivots", F.col("query_cell") + 1)))
    return pairs.filter(apart - F.col("radius") - F.col("reach") <= _widest(threshold)).drop("pivots", "radius", "reach")


def _widest(threshold: float) -> float:
    return float(np.arccos(np.clip(threshold, -1.0, 1.0))) + SLACK


def _best(found: pd.DataFrame, wanted: pd.DataFrame, k: int, threshold: float) -> pd.DataFrame:
    """Best k of a piece of documents for every query of a piece."""
    best = []
    if len(found) and len(wanted):
        docs, doc_ids, targets = _unit(found["vector"]), found["doc_id"].to_numpy(), _unit(wanted["target"])
        middle = docs.sum(axis=0)
        if np.linalg.norm(middle) > 0:
            middle /= np.linalg.norm(middle)
            spread, away = (np.arccos(np.clip(m @ middle, -1.0, 1.0)) for m in (docs, targets))
            near = (away >= spread.min() - _widest(threshold)) & (away <= spread.max() + _widest(threshold))
            wanted, targets = wanted[near], targets[near]
        for query_id, row in zip(wanted["query_id"].to_numpy(), targets @ docs.T):
            hit = np.flatnonzero(row >= threshold)
            best += [(query_id, doc_ids[i], row[i]) for i in hit[np.lexsort((doc_ids[hit], -row[hit]))][:k]]
    return pd.DataFrame(best, columns=["query_id", "doc_id", "similarity"])


def _unit(vectors) -> np.ndarray:
    matrix = np.array([list(v) for v in vectors], dtype="float64")
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(strip(text)), r"\s+"), lambda w: w != ""))


def keyword_jaccard(query: Column, document: Column, terms: list[str] = DOMAIN_TERMS) -> Column:
    """Word overlap plus 0.1 per domain term in the document, at most 1; 0 without query words."""
    return _jaccard(words(query), words(document), F.lower(document), terms)


def _jaccard(q: Column, d: Column, low: Column, terms: list[str]) -> Column:
    both = F.size(F.array_intersect(q, d))
    return F.when(F.size(q) == 0, 0.0).otherwise(overlap_score(both, F.size(q), F.size(d), _boost(low, terms)))


def overlap_score(common: Column, asked: Column, held: Column, boost: Column) -> Column:
    """The same score from counted words: ``common`` ones, those ``asked`` and those ``held`` by the document."""
    return F.least(F.lit(1.0), common / (asked + held - common) + boost)


def term_boost(document: Column, terms: list[str] = DOMAIN_TERMS) -> Column:
    return _boost(F.lower(document), terms)


def _boost(low: Column, terms: list[str]) -> Column:
    return reduce(add, [low.contains(t).cast("int") for t in terms]) * 0.1


def keyword_candidates(questions: DataFrame, documents: DataFrame, percent: int = 10) -> DataFrame:
    """(query_id, doc_id) of all pairs whose word sets overlap in at least ``percent`` of their union."""
    return keyword_overlaps(questions, documents, percent).select("query_id", "doc_id")


def keyword_overlaps(
    questions: DataFrame, documents: DataFrame, percent: int = 10, rows: int = TEXT_ROWS, block: int = QUESTION_ROWS, best: int | None = None
) -> DataFrame:
    """All pairs whose word sets overlap in at least ``percent`` of their union, with the counted words.

    ``questions`` has (query_id, query), ``documents`` (doc_id, text) and optionally boost. A pair is
    (query_id, doc_id, common, asked, held, boost): common words, words of either side. Documents are cut into
    pieces of about ``rows``, questions into blocks of about ``block``; a piece meets a block as one group, its
    documents first: they are indexed, and the questions stream past the index, so no pair below the share ever
    becomes a row. Documents whose number of words fits no question don't move. The number of pairs to
    compare grows with questions times documents; memory is bounded by a piece, and what
    moves by documents times blocks plus questions times pieces. Texts without words pair with nothing.

    With ``best``, a pair is left out if ``best`` other pairs of its question have a higher score in ``rerank``, where the
    documents' column bonus (``rank_bonus``) is what the score has besides the words. All pairs are counted for that.
    """
    boost, bonus = (F.col(c).cast("double") if c in documents.columns else F.lit(0.0) for c in ("boost", "bonus"))
    asked = questions.select("query_id", words(F.col("query")).alias("_w"))
    asked = asked.select("query_id", F.size("_w").alias("n"), F.array_join("_w", " ").alias("words"))
    known = documents.select("doc_id", boost.alias("boost"), bonus.alias("bonus"), words(F.col("text")).alias("_w"))
    known = known.select("doc_id", "boost", "bonus", F.size("_w").alias("n"), F.array_join("_w", " ").alias("words"))
    span = one_row(questions.select(F.size(words(F.col("query"))).alias("n")).filter("n > 0").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("all")), "lo", "hi", "all")
    blocks = F.greatest(F.lit(1), F.ceil(span.getField("all") / block)).cast("int")
    pieces = F.greatest(F.lit(1), F.ceil(one_row(documents.agg(F.count(F.lit(1)).alias("all")), "all").getField("all") / rows)).cast("int")
    fits = (F.col("n") * 100 >= span.getField("lo") * percent) & (span.getField("hi") * 100 >= F.col("n") * percent)

    # outer, with a filter behind it: else Spark tests the array below the projections and makes the words twice
    def dealt(side: DataFrame, wanted: Column, own: Column, others: Column, *names: str) -> DataFrame:
        met = F.when(wanted, F.sequence(F.lit(0), others - 1))
        out = side.select("*", own.cast("int").alias("_own"), F.explode_outer(met).alias("_met")).filter("_met IS NOT NULL")
        return out.select(F.col("_own").alias(names[0]), F.col("_met").alias(names[1]), *names[2:], "n", "words")

    d = dealt(known, (F.col("n") > 0) & fits, F.pmod(F.xxhash64("doc_id"), pieces), blocks, "piece", "block", "doc_id", "boost", "bonus")
    q = dealt(asked, F.col("n") > 0, F.pmod(F.xxhash64("query_id"), blocks), pieces, "block", "piece", "query_id")
    sides = d.select("piece", "block", F.lit(False).alias("asks"), F.col("doc_id").alias("id"), "boost", "bonus", "n", "words").unionByName(
        q.select("piece", "block", F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.lit(0.0).alias("boost"), F.lit(0.0).alias("bonus"), "n", "words")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _overlaps(batches, percent, best)

    kinds = {f.name: f.dataType.simpleString() for frame in (questions, documents) for f in frame.schema.fields}
    sides = sides.repartition("piece", "block").sortWithinPartitions("piece", "block", "asks")  # the groups keep this order
    pairs = sides.groupBy("piece", "block").applyInArrow(meet, PAIRS)
    ids = [F.col(c).cast(kinds[c]).alias(c) for c in ("query_id", "doc_id")]
    return pairs.select(*ids, "common", "asked", "held", "boost")


def _overlaps(batches: Iterator[pa.RecordBatch], percent: int, best: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of one piece and one block, in batches of about ``BATCH`` rows; the documents come first."""
    builder, index = _Builder(), None
    waiting: list[pa.RecordBatch] = []
    ready, size, begun = [], 0, False
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            known = batch.filter(pc.invert(batch["asks"]))
            if len(known):
                if begun:
                    raise ValueError("a document follows the questions of its group")
                builder.add(known)
            asked = batch.filter(batch["asks"])
            if len(asked):
                waiting.append(asked)
                begun = True
            if sum(map(len, waiting)) < ASKED_ROWS:
                continue
        if not waiting or not (index or builder.parts):
            waiting = []
            continue
        index = index or builder.built(percent, best)
        for found in index.search(pa.Table.from_batches(waiting)):
            ready.append(found)
            size += len(found)
            if size >= BATCH:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready, size = [], 0
        waiting = []
    if ready:
        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()


class _Builder:
    """Words of a piece's documents as numbers, batch by batch, so the texts need not stay."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.vocabulary: list[pa.Array] = []

    def add(self, known: pa.RecordBatch) -> None:
        terms = pc.split_pattern(known["words"], " ").flatten().dictionary_encode()
        self.vocabulary.append(terms.dictionary)
        self.parts.append((known["id"], known["n"].to_numpy(), terms.indices.to_numpy(), known["boost"].to_numpy(), known["bonus"].to_numpy()))

    def built(self, percent: int, best: int | None) -> _Index:
        whole = pa.concat_arrays(self.vocabulary).dictionary_encode()
        numbers, at, terms = whole.indices.to_numpy(), 0, []
        for own, part in zip(self.vocabulary, self.parts):
            terms.append(numbers[at : at + len(own)][part[2]])
            at += len(own)
        self.vocabulary = []
        ids, (held, boosts, bonuses) = pa.concat_arrays([p[0] for p in self.parts]), (np.concatenate([p[k] for p in self.parts]) for k in (1, 3, 4))
        self.parts = []
        return _Index(percent, best, whole.dictionary, np.concatenate(terms), ids, held, boosts, bonuses)


class _Index:
    """Documents by number of words, and for each word the places of the documents that hold it.

    A question of n words and a document of m share enough if they have t = ceil((n + m) share / (1 + share)) words
    in common. At least ``LEAST`` of them (or all t) are among the n - t + ``LEAST`` words of the question that fewest
    documents hold. So only these are counted for the document: from the list of a frequent word, the documents up to a
    length are taken. The question's other words are looked up for the few documents that had enough of the first ones.
    """

    def __init__(
        self, percent: int, best: int | None, vocabulary: pa.Array, terms: np.ndarray, ids: pa.Array, held: np.ndarray, boosts: np.ndarray, bonuses: np.ndarray
    ) -> None:
        order = np.argsort(held, kind="stable")
        place = np.empty(len(held), dtype="int64")
        place[order] = np.arange(len(held))
        self.percent, self.best, self.vocabulary = percent, best, vocabulary
        self.ids, self.held, self.boosts = ids.take(pa.array(order)), held[order].astype("int64"), boosts[order]
        self.bonuses = bonuses[order]
        lists = terms.astype("int64") * len(held) + np.repeat(place, held)
        lists.sort()
        lists %= len(held)
        self.places = lists.astype("int32")
        counts = np.bincount(terms, minlength=len(vocabulary))
        # a word that no document holds, the last one, has an empty list
        self.counts, self.starts = np.append(counts, 0), np.concatenate([[0], np.cumsum(counts), [len(lists)]])
        frequent = np.argsort(-counts, kind="stable")[:FREQUENT]
        self.row = np.full(len(vocabulary) + 1, -1)
        self.row[frequent] = np.arange(len(frequent))
        # for each frequent word, the documents that hold it as bits, and how many lie before each ``STEP``-th place
        self.bits = np.zeros((len(frequent), -(-len(held) // 8)), dtype="uint8")
        self.before = np.zeros((len(frequent), -(-len(held) // STEP) + 1), dtype="int32")
        marks = np.arange(self.before.shape[1]) * STEP
        for i, w in enumerate(frequent):
            own = self.places[self.starts[w] : self.starts[w + 1]]
            has = np.zeros(len(held), dtype="bool")
            has[own] = True
            self.bits[i] = np.packbits(has, bitorder="little")
            self.before[i] = np.searchsorted(own, marks)

    def search(self, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        """Pairs of these questions, in batches."""
        p, asked = self.percent, asked.sort_by("n").combine_chunks()
        ids, n = asked["id"].combine_chunks(), asked["n"].to_numpy().astype("int64")
        first = np.cumsum(n) - n
        words = pc.index_in(pc.split_pattern(asked["words"].combine_chunks(), " ").flatten(), value_set=self.vocabulary)
        words = pc.fill_null(words, len(self.vocabulary)).to_numpy().astype("int64")
        owner = np.repeat(np.arange(len(n)), n)
        words = words[np.lexsort((words, self.counts[words], owner))]
        # each word by rank is counted for the documents before a place: a frequent one up to a length, a rare one for all
        within = np.minimum(n[owner], n[owner] - (np.arange(len(words)) - first[owner]) + LEAST - 1)
        steps = -(-np.searchsorted(self.held, self._longest(within, n[owner]), side="right") // STEP)
        row, starts = self.row[words], self.starts[words]
        upto = np.where(row < 0, len(self.held), steps * STEP)
        ends = np.where(row < 0, self.starts[words + 1], starts + self.before[row, steps])
        listed = ends > starts
        filled = np.concatenate([[0], np.cumsum(listed)])[np.append(first, len(words))].tolist()
        starts, ends = starts[listed], ends[listed]
        del owner, within, steps, row, listed
        lows = np.searchsorted(self.held, -(-n * p // 100)).tolist()
        highs = np.searchsorted(self.held, self._longest(n, n), side="right").tolist()
        counts = np.zeros(len(self.held), dtype="uint8" if len(n) and n[-1] < 256 else "int32")
        one, found, size, last = counts.dtype.type(1), [], 0, -1
        for i, (x, y, low, high) in enumerate(zip(filled, filled[1:], lows, highs)):
            if x == y or low >= high:
                continue
            if n[i] != last:
                last, fits = n[i], counts[low:high]
                enough = np.minimum(self._needed(last, self.held[low:high]), LEAST).astype(counts.dtype)
            np.add.at(counts, np.concatenate([self.places[a:b] for a, b in zip(starts[x:y].tolist(), ends[x:y].tolist())]), one)
            hit = (fits >= enough).nonzero()[0]
            if len(hit):
                found.append((i, hit + low, fits[hit]))
                size += len(hit) * int(last)
            counts.fill(0)
            if size >= LOOKUPS:
                yield self._checked(ids, n, first, words, upto, found)
                found, size = [], 0
        if found:
            yield self._checked(ids, n, first, words, upto, found)

    def _needed(self, n, m):
        return np.maximum(1, -(-(n + m) * self.percent // (100 + self.percent)))

    def _longest(self, common, n):
        """Words of the longest document that a question of n words needs no more than so many common ones for."""
        return common * (100 + self.percent) // self.percent - n if self.percent else np.full_like(n, 1 << 62)

    def _checked(self, ids: pa.Array, n: np.ndarray, first: np.ndarray, words: np.ndarray, upto: np.ndarray, found: list[tuple]) -> pa.RecordBatch:
        """The words not counted yet are added to the counts; pairs that have enough."""
        question = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
        place, common = (np.concatenate([f[k] for f in found]).astype("int64") for k in (1, 2))
        needed = self._needed(n[question], self.held[place])
        others = np.maximum(needed - LEAST, 0)
        pair = np.repeat(np.arange(len(place)), others)
        at = np.repeat((first + n - 1)[question] + np.cumsum(others) - others, others) - np.arange(len(pair))
        where = place[pair]
        held = self.bits[self.row[words[at]], where >> 3] >> (where & 7).astype("uint8") & 1 > 0
        common += np.bincount(pair[held & (where >= upto[at])], minlength=len(place))
        hit = np.flatnonzero(common >= needed)
        question, place, common = question[hit], place[hit], common[hit]
        if self.best is not None:
            hit = self._best(question, place, common, n[question])
            question, place, common = question[hit], place[hit], common[hit]
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(question)),
                self.ids.take(pa.array(place)),
                pa.array(common, pa.int32()),
                pa.array(n[question], pa.int32()),
                pa.array(self.held[place], pa.int32()),
                pa.array(self.boosts[place], pa.float64()),
            ],
            schema=PAIR_FIELDS,
        )

    def _best(self, question: np.ndarray, place: np.ndarray, common: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Pairs that may be among a question's best: the scores of Spark decide, these only leave out what is clearly lower."""
        semantic = np.minimum(1.0, common / (asked + self.held[place] - common) + self.boosts[place])
        score = np.minimum(1.0, semantic * (WEIGHTS["relevance"] + WEIGHTS["semantic"]) + self.bonuses[place])
        order = np.lexsort((-score, question))
        new = np.append(True, question[order][1:] != question[order][:-1])[: len(order)]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(order))
        least = score[order][np.minimum(begin + self.best, end) - 1]
        return np.sort(order[~(score[order] < np.repeat(least - EVEN, end - begin))])


def rank_bonus(importance: Column, chunk_type: Column, level: Column, loaded_at: Column) -> Column:
    """What a document adds to the score of each of its pairs in ``rerank``."""
    return importance_boost(importance, chunk_type, level) * WEIGHTS["importance"] + freshness(loaded_at) * WEIGHTS["freshness"]


def importance_boost(importance: Column, chunk_type: Column, level: Column) -> Column:
    table = F.create_map(*[x for k, v in TYPE_BOOST.items() for x in (F.lit(k), F.lit(v))])
    kind = F.coalesce(F.try_element_at(table, chunk_type), F.lit(0.0))
    depth = F.greatest(F.lit(0.0), (4 - F.coalesce(level, F.lit(4))) * 0.05)
    return F.least(F.lit(1.0), F.coalesce(importance, F.lit(0.5)) + kind + depth)


def freshness(loaded_at: Column) -> Column:
    out = F
    for year, value in FRESHNESS:
        out = out.when(loaded_at.contains(year), value)
    return out.otherwise(0.4)


def rerank(candidates: DataFrame, k: int = 10, terms: list[str] = DOMAIN_TERMS) -> DataFrame:
    """Best ``k`` candidates per query by the weighted scores.

    ``candidates`` has query_id, query, doc_id, text, importance_score, chunk_type,
    structure_level, loaded_at and optionally relevance_score; without it relevance equals the
    keyword score. With a semantic_score (of ``overlap_score``) the texts are not needed.
    """
    prepared = candidates
    if "semantic_score" not in candidates.columns:
        prepared = candidates.withColumns({"_q": words(F.col("query")), "_d": words(F.col("text")), "_low": F.lower("text")})
        prepared = prepared.withColumn("semantic_score", _jaccard(F.col("_q"), F.col("_d"), F.col("_low"), terms)).drop("_q", "_d", "_low")
    scored = prepared.withColumns(
        {
            "boosted_importance": importance_boost(F.col("importance_score"), F.col("chunk_type"), F.col("structure_level")),
            "freshness_score": freshness(F.col("loaded_at")),
        }
    )
    if "relevance_score" not in candidates.columns:
        scored = scored.withColumn("relevance_score", F.col("semantic_score"))
    final = (
        F.col("relevance_score") * WEIGHTS["relevance"]
        + F.col("semantic_score") * WEIGHTS["semantic"]
        + F.col("boosted_importance") * WEIGHTS["importance"]
        + F.col("freshness_score") * WEIGHTS["freshness"]
    )
    scored = scored.withColumn("rerank_score", F.round(F.least(F.lit(1.0), final), 9)).withColumn("reason", rerank_reason())
    return best_per_group(scored, ["query_id"], k, F.desc("rerank_score"), F.asc("doc_id"))


def rerank_reason() -> Column:
    relevance, importance = F.col("relevance_score"), F.col("boosted_importance")
    return F.concat_ws(
        ", ",
        F.when(relevance >= 0.8, "높은 관련성").when(relevance >= 0.6, "보통 관련성").otherwise("낮은 관련성"),
        F.when(importance >= 0.7, "중요 섹션").when(importance >= 0.5, "일반 섹션"),
        F.when(F.col("semantic_score") >= 0.7, "높은 의미 유사성"),
        F.when(F.col("freshness_score") >= 0.8, "최신 문서"),
    )


def format_context(ranked: DataFrame) -> DataFrame:
    """One numbered context text per query from its at most k ranked chunks."""
    score = F.when(F.col("rerank_score") > 0, F.concat(F.lit(" (관련도: "), F.format_string("%.2f", F.round("rerank_score", 2)), F.lit(")")))
    section = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(" "), "section_title"))
    part = F.concat(
        F.lit("[문서 "), F.col("rank").cast("string"), F.lit("]"), F.coalesce(section, F.lit("")), F.coalesce(score, F.lit("")), F.lit("\n"), strip(F.col("text"))
    )
    return ranked.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("part")))), lambda s: s["part"]), "\n\n---\n\n").alias("context")
    )
