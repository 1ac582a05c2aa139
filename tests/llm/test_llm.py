"""Operators for training data: SQL, brute force, round trips, held-out accuracy, odd rows and empty tables."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers

from headway.llm import exact_dedup, langid, lm_trie, mixture, near_dedup, packing, quality, sharding, topk, toxicity
from headway.llm.queries import ORACLES, QUERIES
from headway.llm.tokens import as_array, hashes
from headway.session import scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def documents(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(d[0] for d in cursor.description)
    mine = df.select(*names).collect()
    theirs = [dict(zip([d[0] for d in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    assert sorted(map(str, (tuple(r) for r in mine))) == sorted(str(tuple(r[n] for n in names)) for r in theirs)


def test_word_hashes_follow_words():
    texts = ["The the THE", "", "a\tb\x0bc", "é É"]
    found, bounds = hashes(as_array(pa.array(texts)))
    assert np.diff(bounds).tolist() == [3, 0, 3, 2]
    assert len(set(found[:3].tolist())) == 1 and len(set(found.tolist())) == 6


def test_digest_index_over_batches(spark, odd, none):
    path = scratch(spark, "index")
    index = exact_dedup.DigestIndex(spark, "batches", path, 4).open()
    first = index.ingest(odd).collect()
    assert len(first) == odd.count()
    kept = [(r.doc_id, r.keep_id) for r in first if r.kept]
    assert (2, 2) in kept and sum(r.kept for r in first if r.doc_id == 2) == 1
    assert [r.keep_id for r in first if r.doc_id in (4, 5)] == [5, 5]
    assert sum(r.kept for r in first if r.doc_id is None) == 1
    size = index.read().count()
    again = index.ingest(odd).collect()
    assert index.read().count() == size and {r.keep_id for r in again} == {r.keep_id for r in first}
    new = spark.createDataFrame([(99, "hi"), (98, "fresh"), (97, "fresh")], "doc_id bigint, text string")
    later = {r.doc_id: (r.keep_id, r.kept) for r in index.ingest(new).collect()}
    assert later == {99: (9, False), 98: (98, True), 97: (98, False)}
    again = exact_dedup.DigestIndex(spark, "reopened", path).open()
    assert again.buckets == 4 and again.read().count() == index.read().count()
    with pytest.raises(ValueError):  # rows would be looked for in other buckets
        exact_dedup.DigestIndex(spark, "reopened_otherwise", path, 8).open()
    again.close()
    assert not spark.catalog.tableExists("reopened")
    assert exact_dedup.DigestIndex(spark, "reopened", path).open().ingest(new).filter("kept").select("doc_id").collect() == [(98,)]
    assert index.ingest(none).count() == 0
    plan = index.unseen(index.read())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_exact_kept_rows(spark, odd):
    index = exact_dedup.DigestIndex(spark, "kept_rows", scratch(spark, "index"), 4).open()
    kept = exact_dedup.kept_rows(odd, index.ingest(odd))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 5, 6, 7, 8, 9, 10]


def test_mixture_odd_rows_and_quotas(spark, odd, none):
    rows = mixture.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixture.mix(none).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixture.mix(odd.repartition(5)).collect()))
    sources = mixture.targets(spark.createDataFrame([("a", 9_000), ("b", 40_000), ("c", 700), (None, 3_000)], "source string, source_size bigint"))
    got = mixture.quotas(sources, 32, 8).collect()
    assert all(r.quota >= 0 for r in got)
    total = {r.source: r.seats for r in got if r.shard == 7}
    want = {r.source: r.target for r in sources.collect()}
    assert all(abs(total[s] * 32 - want[s]) <= 48 for s in total)
    for shard in range(8):  # the highest quotients, one by one
        house = sum(r.seats for r in got if r.shard == shard)
        seats = Counter()
        blocks = {r.source: r.blocks for r in got}
        for _ in range(house):
            seats[max((s for s in want if seats[s] < 2 * blocks[s]), key=lambda s: (want[s] / (2 * seats[s] + 1), s is not None))] += 1
        assert all(abs(seats[r.source] - r.seats) == 0 for r in got if r.shard == shard)


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(odd, PATH).collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in odd.collect()}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + 2048], "<u4")
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.start == 2048 * r.piece
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == list(itertools.accumulate([n for _, n in sorted(s)], initial=0))[:-1]
        assert sum(n for _, n in s) <= 2048
    assert packing.pack_documents(none, PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, 60, 400).tolist(), reverse=True)
    rooms = []
    for n in lengths:
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(60 - n)
    runs = packing.plan(dict(Counter(lengths)), 60)
    used, placed = Counter(), Counter()
    for length, _, items, first, each, base in runs:
        for i in range(items):
            assert base + i % each * length + length <= 60
            used[first + i // each] += length
            placed[length] += 1
    assert placed == Counter(lengths) and len(used) == len(rooms) and max(used.values()) <= 60


def test_difference_balances():
    rng = np.random.default_rng(3)
    loads = np.zeros((500, 4), np.int64)
    loads[:, 0] = rng.integers(1, 1000, 500)
    target = sharding.difference(loads)
    assert all(sorted(t) == [0, 1, 2, 3] for t in target.tolist())
    totals = np.bincount(target[:, 0], weights=loads[:, 0], minlength=4)
    assert np.ptp(totals) <= 3
    assert sharding.difference(np.zeros((0, 4), np.int64)).shape == (0, 4)


def test_sharding(spark, odd, none):
    docs = documents(spark)
    for frame, fan in ((docs, 16), (docs, 16_384), (odd, 4)):
        rows = sharding.shard_documents(frame, 16, fan).collect()
        assert len(rows) == frame.count()
        for s in range(16):
            mine = sorted(r.slot for r in rows if r.shard == s)
            assert mine == list(range(len(mine)))
        held = defaultdict(set)
        for r in rows:
            held[r.text_crc32, r.size].add(r.shard)
        assert all(len(x) == 1 for x in held.values())
    assert sharding.shard_documents(none).count() == 0


@pytest.mark.parametrize("words_, percent", [(3, 85), (5, 80)])
def test_near_duplicates_brute_force(spark, words_, percent):
    docs = documents(spark, "sf0.01").limit(600)
    sets = {}
    for r in docs.collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + words_]) for i in range(len(w) - words_ + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    for r in near_dedup.near_duplicates(docs, words_, percent).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_near_duplicates_odd_rows(spark, odd, none):
    rows = near_dedup.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (14, 1) and got[2] == (14, 1) and got[3] == (15, 1) and got[9] == (1, 9) and got[10] == (1, 9)
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (0, 6) and all(r.kept for r in rows if r.doc_id is None)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_hot_family(spark):
    """More near copies than a block holds, each linked to some others only."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for p in rng.integers(0, 120, int(rng.integers(0, 6))):
            w[p] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(118)} for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * (n := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == label


def test_sketches_merge():
    texts = as_array(pa.array(["a b c d e f", "d e f g h i", "a b c d e f g h i"]))
    parts = [near_dedup.registers(np.unique(hashes(texts.slice(i, 1))[0]), np.array([0, n])) for i, n in ((0, 6), (1, 6), (2, 9))]
    assert (np.maximum(parts[0], parts[1]) == parts[2]).all()


def test_elias_fano_finds():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.arange(50, dtype=np.uint64), np.unique(rng.integers(0, 2**62, 3000, dtype=np.uint64)), np.append(np.arange(20_000, dtype=np.uint64), np.uint64(1 << 50))):
        sequence = lm_trie.EliasFano.build(values)
        asked = np.concatenate([values, rng.integers(0, 2**62, 200, dtype=np.uint64)])
        place = {int(v): i for i, v in enumerate(values)}
        assert sequence.find(asked).tolist() == [place.get(int(a), -1) for a in asked]


def test_language_model_brute_force(spark, odd, none):
    for frame in (documents(spark).limit(60), odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: [*words(r.text), "\n"] for r in frame.collect()}
        train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
        one, two = Counter(), Counter()
        for i in train:
            one.update(texts[i])
            two.update(zip(["\t", *texts[i]], texts[i], strict=False))
        n, v = one.total(), len(one)
        got = lm_trie.score(frame, "crc32(cast(doc_id as string)) % 7 != 2", chunk=20_000, shard=30_000).collect()
        assert len(got) == len(texts)
        for r in got:
            t = texts[r.doc_id]
            base = [(one[w] + 1) / (n + v + 1) for w in t]
            full = [(two[a, w] + lm_trie.PULL * b) / ((len(train) if a == "\t" else one[a]) + lm_trie.PULL) for a, w, b in zip(["\t", *t], t, base, strict=False)]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(one[w] > 0 for w in t), n)
            assert math.isclose(r.base_score, sum(map(math.log10, base)), abs_tol=1e-6)
            assert math.isclose(r.score, sum(map(math.log10, full)), abs_tol=2e-4 * len(t))
    assert lm_trie.score(none, "true").count() == 0


def test_top_k_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [-1.0, 0.5]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, [3.0])]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "vec_id bigint, e array<float>").select("vec_id", topk.scaled(F.col("e")).alias("v"))
    got = [tuple(r) for r in topk.top_k(frame, frame.filter("vec_id % 100 = 0"), 2, 1, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5 * 1024**2), (0, 2, 2, 5 * 1024**2)]
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(20, 64)) * 300, rng.normal(size=(300, 64)) * 300
    for parts in topk.LEVELS:
        (mq, dq), (mx, dx) = topk.statistics(q, parts), topk.statistics(x, parts)
        assert (mq @ mx.T + dq @ dx.T >= q @ x.T - 1e-6).all()
    q, x = q.astype(np.int64), x.astype(np.int64)
    got = topk.best(q, np.arange(20), x, np.arange(300), 5)
    for i in range(20):
        want = sorted(((-int(q[i] @ x[j]), j) for j in range(300) if j != i))[:5]
        assert [(i, j, -s) for s, j in want] == [g for g in got if g[0] == i]


def test_segments_are_all_maximal():
    """Against the recursive definition: the best segment, then the same left and right of it."""
    rng = np.random.default_rng(4)

    def recursive(w, at):
        best = None
        for a in range(len(w)):
            for b in range(a, len(w)):
                s = sum(w[a : b + 1])
                if s > 1e-9 and (best is None or s > best[0] + 1e-9):
                    best = (s, a, b)
        if best is None:
            return []
        s, a, b = best
        return [*recursive(w[:a], at), (at + a, at + b), *recursive(w[b + 1 :], at + b + 1)]

    for _ in range(60):
        w = [float(rng.choice([2.5, 1.25, 3.75])) if rng.random() < 0.35 else -0.6 for _ in range(14)]
        places = [i for i, x in enumerate(w) if x > 0]
        got = toxicity.segments([w[i] for i in places], places, 0.6)
        assert [(a, b) for a, b, _ in got] == recursive(w, 0)


@pytest.mark.parametrize("name, label, least", [("op7_quality", "quality", 0.9), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, folder)
    assert got.count() == 1000
    known = got.filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r[label] for r in known]) >= least
    assert all(0 <= r.score <= 1 for r in known)


def test_language_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op5_language_id"](spark, folder).filter("held_out").join(documents(spark, "sf0.01"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.97


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (7, 1, 0), (8, 0, 1)], "doc_id bigint, quality int, toxic int")
    for docs in (odd, none):
        for score in (
            toxicity.score(odd, toxicity.train(docs, labels)),
            quality.score(odd, quality.train(docs, labels)),
            langid.identify(odd, langid.train(docs)),
        ):
            assert score.count() == odd.count() and score.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
        assert {r.lang_pred for r in langid.identify(odd, langid.train(docs)).filter("doc_id IN (4, 5, 6)").collect()} == {"und"}
        assert toxicity.drop_toxic(docs, toxicity.train(odd, labels)).columns == docs.columns


def test_mixed_rows_meet_targets(spark):
    """Whole documents, a few of them very long, and rows that repeat: each source is as near its seats as whole documents can be."""
    rng = np.random.default_rng(7)
    sizes = {"a": rng.integers(20, 60, 60), "b": rng.integers(3_000, 9_000, 5), "c": rng.integers(1, 4_000, 40), None: rng.integers(200, 300, 30)}
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(n)), s) for i, (s, n) in enumerate((s, n) for s in sizes for n in sizes[s])]
    rows += [(500, "one two three", "a"), (500, "two one three", "a"), *[(None, "same row", "d")] * 41, (600, " ", "d"), (601, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    result = mixture.mix(docs)
    wanted = {r.source: r.target for r in result.collect()}
    got, longest = Counter(), Counter()
    for r in mixture.mixed_rows(docs, result).collect():
        got[r.source] += len(words(r.text))
    for _, text, source in rows:
        longest[source] = max(longest[source], len(words(text)))
    # a seat is a block, and at most one and a half blocks are lost in rounding seats
    assert all(abs(got[s] - wanted[s]) <= longest[s] / 2 + 1.5 * mixture.BLOCK for s in wanted)
    assert not any(r.text == " " or r.text is None for r in mixture.mixed_rows(docs, result).collect())


def test_language_draw_of_many(spark):
    """A language with more documents than 2**23, where draw times rows no longer fits a long."""
    from pyspark.sql import functions as F

    ids = spark.range(100_000).select(F.col("id").alias("_id"), F.lit("en").alias("_lang"))
    many = spark.createDataFrame([("en", 1 << 26)], "_l string, _n bigint")
    share = langid.drawn(ids, many, 1 << 23).count() / 100_000
    assert abs(share - 1 / 8) < 0.01


def test_heavy_contexts_are_spread(spark):
    """Many short texts and a frequent word: no shard gets much more than its part."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(f"w{i} the z{i} the",) for i in range(4_000)], "text string")
    for train in ("true", "false"):
        rows = docs.withColumn("train", F.expr(train))
        size, _, _, _, heavy = lm_trie.statistics(rows, 2_000)
        shards = -(-size // 2_000)
        g = lm_trie.grams(as_array(pa.array([r.text for r in docs.collect()])))
        for word in (lm_trie.START, hashes(as_array(pa.array(["the"])))[0][0]):
            held = np.bincount(lm_trie.gram_shard(g.context, g.follower, heavy, shards)[g.context == word], minlength=shards)
            assert held.max() <= 3 * len(g.context) / shards
        load = np.bincount(lm_trie.gram_shard(g.context, g.follower, heavy, shards), minlength=shards)
        assert load.max() <= 3 * load.mean()
