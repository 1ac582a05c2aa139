"""Quality by logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import crc_of_id, labelled_sample
from headway.llm.tokens import RUNS, U, as_array, hashes, mix, owners, pieces

BITS = 20
#: Labelled documents that the fit uses at most, and how often it goes over them.
SAMPLE, PASSES = 8_000, 3
RATE, SMOOTH, L1, L2 = 0.1, 1.0, 2.0, 1.0
THRESHOLD = 0.3
_REPEAT = U(0xD6E8FEB86659FD93)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: bucket and value log(1 + count) of each n-gram, and the first of each row.

    Words are runs of letters and digits or of other signs, lower-cased. A two-gram of a word and
    itself counts as one feature, whatever the word.
    """
    found, bounds = hashes(texts, RUNS)
    row = owners(bounds)
    pair = (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    a, b = found[:-1][pair], found[1:][pair]
    two = np.where(a == b, _REPEAT, mix(a * U(0x9E3779B97F4A7C15) + b))
    keys = np.concatenate([row << BITS | (found >> U(64 - BITS)).astype(np.int64), row[1:][pair] << BITS | (two >> U(64 - BITS)).astype(np.int64)])
    keys, count = np.unique(keys, return_counts=True)
    at = np.searchsorted(keys, np.arange(len(bounds)) << BITS)
    return keys & ((1 << BITS) - 1), np.log1p(count), at


class Leader:
    """Follow-the-regularised-leader for logistic loss, one learning rate per weight; slot 0 of size 2**BITS + 1 last is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pull = np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= pull, 0.0, -(z - np.sign(z) * pull) / ((SMOOTH + np.sqrt(n)) / RATE + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / RATE * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> np.ndarray:
    """Weights (the last one is the bias) from at most ``limit`` labelled documents outside the held-out fifth.

    The updates follow one another, so one task goes over the bounded sample, in order of a hash of
    the id; only non-zero weights come back, at most 2**BITS.
    """
    known = labels.filter(crc_of_id() % 5 != 0).select("doc_id", F.col("quality").cast("int").alias("y"))
    sample = labelled_sample(docs, known.filter("y IN (0, 1)"), limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for start, texts in pieces(as_array(batch.column(1))):
                f, x, at = features(texts)
                for i in range(len(texts)):
                    # copies, so that the arrays of the slice can go
                    rows.append((ids[start + i], labels[start + i], f[at[i] : at[i + 1]].astype(np.int32), x[at[i] : at[i + 1]].astype(np.float32)))
        rows.sort(key=lambda r: (mix(np.array([r[0]]).astype(np.uint64))[0], r[1], len(r[2])))
        leader = Leader()
        for _ in range(PASSES):
            for _, y, f, x in rows:
                leader.learn(f, x.astype(np.float64), y)
        w = leader.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at), pa.array(w[at])], ["bucket", "weight"])

    got = sample.select(F.col("doc_id").cast("long"), "text", "y").coalesce(1).mapInArrow(run, "bucket bigint, weight double").toArrow()
    weights = np.zeros((1 << BITS) + 1)
    weights[got.column("bucket").to_numpy()] = got.column("weight").to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (chance of label 1) and predicted of every document, by one sparse dot product each.

    Null and empty texts have no features and get the score of the bias. Rows are scored one by one,
    so repeated rows agree; an empty table gives no rows; other columns play no part. The weights are
    an array of fixed size, which every task gets.
    """
    body = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(as_array(batch.column(1))):
                f, x, at = features(texts)
                total = np.zeros(len(f) + 1)
                np.cumsum(body[f] * x, out=total[1:])
                raw = total[at[1:]] - total[at[:-1]] + float(body[-1])
                p = 1 / (1 + np.exp(-np.clip(raw, -700, 700)))
                yield pa.record_batch(
                    [batch.column(0).slice(start, len(texts)), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
