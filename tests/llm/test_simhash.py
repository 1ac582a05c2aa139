"""SimHash near duplicates against plain hashing and all pairs."""

import itertools
import random
import re

import pytest
import xxhash

from headway.llm import simhash
from headway.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashed = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def components(prints, same=()):
    """Smallest id that links of at most two bits, or of ``same`` pairs, reach."""
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 or (a, b) in same:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in prints}


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = components(prints)
    got = QUERIES["op13_simhash"](spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    assert len(got) == len(texts)


def test_odd_rows(spark, odd, none):
    rows = odd.collect()
    got = simhash.near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.fingerprint) for r in got) == sorted((r.doc_id or 0, f"{fingerprint(r.text):016x}") for r in rows)
    want = components({r.doc_id: fingerprint(r.text) for r in rows if r.doc_id is not None})
    assert {r.doc_id: r.component_id for r in got} == want | {None: None}
    assert want[4] == want[5] == want[6] == 4
    assert simhash.near_duplicates(none).count() == 0


def test_repeated_ids_are_one_node(spark):
    frame = spark.createDataFrame([(3, "a b c d"), (5, "a b c d"), (5, "x y z"), (7, "X Y z"), (9, "other words here")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]


@pytest.mark.parametrize("text", ["a b  c\td\n" * 40, "one", "", " ", "x" * 300 + " " + "y" * 500 + " z w", "É Ab\x0bc\x0c d" * 9])
def test_pieces_give_the_same_hashes(text):
    whole = [h for part in simhash.shingle_hashes(text.encode()) for h in part.tolist()]
    for piece in (1, 7, 64):
        assert [h for part in simhash.shingle_hashes(text.encode(), piece=piece) for h in part.tolist()] == whole
    assert simhash.majority(list(simhash.shingle_hashes(text.encode()))) == fingerprint(text)


def near_values(rng, roots, copies):
    values = [rng.getrandbits(64) for _ in range(roots)]
    for v in list(values):
        for _ in range(copies):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    values = list(dict.fromkeys(values))
    rng.shuffle(values)
    return values


@pytest.mark.parametrize("seed", range(8))
def test_tree_finds_all_within_the_radius(seed):
    rng = random.Random(seed)
    values = near_values(rng, 40, 6)
    for radius in (0, 1, 2):
        tree = simhash.BKTree()
        for i, v in enumerate(values):
            assert sorted(tree.add(v, radius)) == [j for j in range(i) if (values[j] ^ v).bit_count() <= radius]
        assert all((tree.values[n] ^ tree.values[c]).bit_count() == d for n, edges in enumerate(tree.children) for d, c in edges.items())


@pytest.mark.parametrize("limit", [1, 4, 4_096])
def test_shards_lose_no_pair(spark, limit):
    """Also where each shard is cut again: pairs within two bits meet, and shards keep to their bound."""
    rng = random.Random(limit)
    values = near_values(rng, 60, 8)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = simhash.shards(spark.createDataFrame([(v,) for v in signed], "fp bigint"), limit).collect()
    held = {}
    for r in rows:
        held.setdefault(r.shard, set()).add(r.fp)
    met = {frozenset(p) for s in held.values() for p in itertools.combinations(s, 2)}
    near = {frozenset((a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert near and near <= met
    assert len(rows) <= 36 * len(values)
    with pytest.raises(ValueError):
        simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"), radius=3)
