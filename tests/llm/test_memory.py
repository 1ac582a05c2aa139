"""What Python workers of the pipeline hold: bounded by a piece of text and a few buckets, not by all weights or a whole batch."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from headway.llm import packing, toxicity
from headway.llm.common import table

MB = 1 << 20


@pytest.fixture(scope="module")
def model(spark):
    folder = "/root/testdata/sf0.01"
    return toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"))


@pytest.fixture(scope="module")
def texts():
    """About 8 MB of words."""
    words = np.random.default_rng(5).integers(0, 20_000, (4000, 300))
    return pa.array([" ".join(f"w{x:05d}" for x in row) for row in words.tolist()])


def peak(run):
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / MB


def test_toxicity_model_is_small(model):
    """Every task gets the model; most buckets weigh the same."""
    assert len(pickle.dumps(model)) < 5 * MB
    words = pa.array(["the and " * 20, ""], pa.large_string())
    word, stem, _ = toxicity.buckets(words)
    w, bounds = model.word_weights(words)
    full = np.full(1 << toxicity.BITS, -toxicity.DRIFT, np.float32)
    full[model.hot[:-1]] = model.weights[:-1]
    assert w.dtype == np.float32 and (w == np.where(model.known[word], full[word], full[stem])).all() and bounds[-1] == len(w) == 40


def test_toxicity_scores_by_pieces(model, texts):
    run = toxicity.score.__globals__
    assert peak(lambda: [list(model.passages(x)) for _, x in run["pieces"](run["as_array"](texts), run["PIECE"])]) < 40


def test_toxicity_counts_by_pieces(texts):
    labels = np.arange(len(texts)) % 2
    batches = [pa.record_batch([texts, pa.array(labels)], ["text", "y"])]
    assert peak(lambda: list(toxicity.count(iter(batches)))) < 90
    counts, docs = toxicity.count(iter(batches))
    assert docs.to_pydict() == {"bucket": [-1], "toxic": [2000], "clean": [2000]}
    want = {}
    for text, y in zip(texts.to_pylist(), labels.tolist(), strict=True):
        word, stem, _ = toxicity.buckets(pa.array([text], pa.large_string()))
        for b in {*word.tolist(), *stem.tolist()}:
            want.setdefault(b, [0, 0])[y] += 1
    assert {b: [c, t] for b, t, c in zip(*(counts.column(k).to_pylist() for k in ("bucket", "toxic", "clean")), strict=True)} == want


def test_slots_need_no_python(spark):
    """The plan's rows reach the executors without a Python worker, and are still not broadcast."""
    slots = packing.slots(spark, packing.plan({2048: 3, 1500: 5, 500: 9, 20: 40}))
    parts = spark.range(100).selectExpr("cast(500 as bigint) as length", "id as rank")
    plan = parts.join(slots, ["length", "rank"])._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert slots.count() == 57
