"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import crc_of_id, labelled_sample
from headway.llm.tokens import RUNS, U, as_array, mix, owners, pieces, stem_hashes

#: Tokens are hashed to this many bits; the model is two arrays of that size, whatever the corpus.
BITS = 22
#: Labelled documents that the fit uses at most.
SAMPLE = 20_000
#: Mass of the Dirichlet prior as a share of all counts; it is shaped like both classes together.
PRIOR = 0.05
#: A word in fewer documents of the sample takes the log-odds of its stem, its first characters.
LEAST, STEM = 5, 4
#: Standard errors by which log-odds shrink towards 0, and the cost of each word in a passage.
ERRORS, DRIFT = 2.5, 0.25
#: Passages with more chance hits than this per document aren't reported.
E_VALUE = 0.05
THRESHOLD = 0.7
CAP = 60.0
#: Bytes of text that are laid out at a time: each takes about 60 bytes of arrays while words are hashed.
PIECE = 1 << 18


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word, bucket of its stem, and the first word of each row."""
    found, begun, bounds = stem_hashes(texts, STEM, RUNS)
    stem = mix(begun + U(1))
    return (found >> U(64 - BITS)).astype(np.int64), (stem >> U(64 - BITS)).astype(np.int64), bounds


def segments(weights: list[float], places: list[int], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a row of words, in linear time.

    ``places`` are the words of positive weight, ``weights`` their weights; every other word weighs
    ``-drift``. Each segment keeps a link to the nearest earlier one that starts at a lower total.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    total, at = 0.0, 0
    for place, weight in zip(places, weights, strict=True):
        before = total - drift * (place - at)
        total, at = before + weight, place + 1
        a, l = place, before
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= l:
                j = link[j]
            if j < 0 or high[j] >= total:
                break
            a, l = first[j], low[j]
            keep, j = j, link[j]
            del first[keep:], last[keep:], low[keep:], high[keep:], link[keep:]
        first.append(a), last.append(place), low.append(l), high.append(total), link.append(j)
    return [(a, b, h - l) for a, b, l, h in zip(first, last, low, high, strict=True)]


@dataclass
class ToxicityModel:
    """Whether a bucket has enough words, the buckets that speak for toxicity (ascending, then one beyond all)
    with their weights, decay and scale of chance scores, and the curve from evidence to score.

    Every other bucket weighs ``-DRIFT``. Each task gets the model, so it holds no array of all weights.
    """

    known: np.ndarray
    hot: np.ndarray
    weights: np.ndarray
    decay: float
    scale: float
    slope: float = 1.0
    shift: float = 0.0

    def word_weights(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        word, stem, bounds = buckets(texts)
        of = np.where(self.known[word], word, stem)
        at = np.searchsorted(self.hot, of)
        return np.where(self.hot[at] == of, self.weights[at], np.float32(-DRIFT)), bounds

    def passages(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float, float]]]]:
        """Number of words and significant passages (first word, last word, score, e-value) of each text."""
        w, bounds = self.word_weights(texts)
        hits = np.flatnonzero(w > 0)
        at = np.searchsorted(hits, bounds)
        # Words that speak against toxicity count like neutral ones, so gaps need no scan.
        for i in range(len(texts)):
            n = int(bounds[i + 1] - bounds[i])
            mine = hits[at[i] : at[i + 1]]
            out = []
            if len(mine):
                for a, b, s in segments(w[mine].tolist(), (mine - bounds[i]).tolist(), DRIFT):
                    e = self.scale * n * float(np.exp(-self.decay * s))
                    if e <= E_VALUE:
                        out.append((a, b, s, e))
            yield n, out

    def best_scores(self, texts: pa.Array) -> Iterator[tuple[int, float]]:
        """Number of words and best segment score of each text."""
        w, bounds = self.word_weights(texts)
        hits = np.flatnonzero(w > 0)
        at = np.searchsorted(hits, bounds)
        for i in range(len(texts)):
            mine = hits[at[i] : at[i + 1]]
            best = max((s for _, _, s in segments(w[mine].tolist(), (mine - bounds[i]).tolist(), DRIFT)), default=0.0) if len(mine) else 0.0
            yield int(bounds[i + 1] - bounds[i]), best

    def evidence(self, passages: list[tuple[int, int, float, float]]) -> float:
        """Sum over passages of -ln(e-value), bounded."""
        return min(CAP, float(sum(-np.log(max(p[3], 1e-300)) for p in passages)))

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -700, 700))))


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log-odds of each bucket and its share of clean words, under the Dirichlet prior."""
    a = (toxic + clean + 0.01) * PRIOR
    t, c = toxic + a, clean + a
    delta = np.log(t / (t.sum() - t)) - np.log(c / (c.sum() - c))
    error = np.sqrt(1 / t + 1 / c)
    return np.sign(delta) * np.maximum(np.abs(delta) - ERRORS * error, 0), c / c.sum()


def chance_decay(weights: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(decay x weight)] = 1 over clean words."""
    if not (weights > 0).any():
        return 1.0
    low, high = 1e-3, 1.0
    f = lambda x: float((share * np.exp(x * weights)).sum()) - 1
    while f(high) < 0 and high < 200:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return high


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (text, y) of each kind that hold a bucket, as a word or a stem, and at bucket -1 all of them."""
    total = np.zeros(2 << BITS, np.int32)  # a task counts the documents of a bounded sample
    docs = np.zeros(2, np.int64)
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for start, texts in pieces(as_array(batch.column(0)), PIECE):
            y = labels[start : start + len(texts)]
            word, stem, bounds = buckets(texts)
            row = owners(bounds) << BITS
            once = np.unique(np.concatenate([row | word, row | stem]))
            at, n = np.unique(y[once >> BITS] << BITS | once & ((1 << BITS) - 1), return_counts=True)
            total[at] += n.astype(np.int32)
            docs += np.bincount(y, minlength=2)
    clean, toxic = total.reshape(2, 1 << BITS)
    seen = np.flatnonzero((clean != 0) | (toxic != 0))
    counts = [pa.array(x[seen].astype(np.int64)) for x in (toxic, clean)]
    yield pa.record_batch([pa.array(seen), *counts], ["bucket", "toxic", "clean"])
    yield pa.record_batch([pa.array([-1]), pa.array(docs[1:]), pa.array(docs[:1])], ["bucket", "toxic", "clean"])


def fit(sample: DataFrame) -> ToxicityModel:
    """Fit on a stored sample (text, y: 0 or 1): counts, then chance scores, then the curve, each from the tasks.

    What reaches the driver is bounded by the number of buckets, not by the sample. Words and
    stems count once a document; those of fewer than ``LEAST`` documents are left at the neutral weight. Without labels of both kinds the model finds nothing and scores 0.
    """

    schema = "bucket bigint, toxic bigint, clean bigint"
    rows = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(count, schema)
    rows = rows.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = rows.filter(f"bucket < 0 OR toxic + clean >= {LEAST}").toArrow()
    at = rows.column("bucket").to_numpy()
    toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    real = at >= 0
    toxic[at[real]] = rows.column("toxic").to_numpy()[real]
    clean[at[real]] = rows.column("clean").to_numpy()[real]
    docs = [int(rows.column(k).to_numpy()[~real].sum()) for k in ("clean", "toxic")]
    if not min(docs) or not toxic.sum() or not clean.sum():
        return ToxicityModel(np.zeros(1 << BITS, bool), np.array([1 << BITS]), np.array([-DRIFT], np.float32), 1.0, 1.0, 0.0, -700.0)
    odds, share = log_odds(toxic, clean)
    weights = np.where(odds > 0, odds, 0) - DRIFT
    hot = np.flatnonzero(odds > 0)
    model = ToxicityModel(
        toxic + clean >= LEAST,
        np.append(hot, 1 << BITS),
        np.append(weights[hot], -DRIFT).astype(np.float32),
        chance_decay(weights, share),
        1.0,
    )

    def clean_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = mass = 0.0
        for batch in batches:
            for _, texts in pieces(as_array(batch.column(0)), PIECE):
                for words, found in model.best_scores(texts):
                    n += 1
                    mass += words * float(np.exp(-model.decay * found))
        yield pa.record_batch([pa.array([n]), pa.array([mass])], ["n", "mass"])

    got = sample.filter("y = 0").select("text").mapInArrow(clean_scores, "n double, mass double")
    got = got.agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).first()
    model.scale = float(got["n"]) / max(float(got["mass"]), 1.0)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, int(CAP) * 4 + 1), np.int64)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, texts in pieces(as_array(batch.column(0)), PIECE):
                for i, (_, found) in enumerate(model.passages(texts)):
                    total[labels[start + i], round(model.evidence(found) * 4)] += 1
        k, x = np.nonzero(total)
        yield pa.record_batch([pa.array(k), pa.array(x), pa.array(total[k, x])], ["y", "x", "n"])

    rows = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(evidence, "y bigint, x bigint, n bigint")
    rows = rows.groupBy("y", "x").agg(F.sum("n").alias("n")).toArrow()
    x, y, n = (rows.column(k).to_numpy().astype(float) for k in ("x", "y", "n"))
    model.slope, model.shift = logistic(x / 4, y, n)
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of P(1 | x) from counts, with targets drawn in by one case of each kind."""
    ones, zeros = n[y == 1].sum(), n[y == 0].sum()
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.array([0.0, np.log((ones + 1) / (zeros + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (n * (t - p)) - 1e-6 * beta
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-6
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and passages (words first..last, score, e_value) of every document.

    Null and empty texts have no passage and get the score of no evidence. Ties and repeated rows are
    scored alike, each row by itself; an empty table gives no rows; other columns play no part.
    """
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(as_array(batch.column(1)), PIECE):
                found = [p for _, p in model.passages(texts)]
                scores = [model.score(model.evidence(p)) for p in found]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array(scores, pa.float64()),
                        pa.array([int(s >= threshold) for s in scores], pa.int32()),
                        pa.array([[dict(zip(("first", "last", "score", "e_value"), x, strict=True)) for x in p] for p in found], kind),
                    ],
                    ["doc_id", "score", "predicted", "passages"],
                )

    schema = "doc_id bigint, score double, predicted int, passages array<struct<first:bigint,last:bigint,score:double,e_value:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``limit`` labelled documents outside the held-out third."""
    known = labels.filter(crc_of_id() % 3 != 1).select("doc_id", F.col("toxic").cast("int").alias("y"))
    return fit(labelled_sample(docs, known.filter("y IN (0, 1)"), limit))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``; no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(as_array(batch.column(at)), PIECE):
                keep = [model.score(model.evidence(p)) < threshold for _, p in model.passages(texts)]
                yield batch.slice(start, len(texts)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
