"""Vector codes against SQL and a search of every entry."""

import hashlib
import math

import numpy as np
import pytest

from headway.llm import vector_codes
from headway.llm.queries import QUERIES


@pytest.mark.parametrize("width, spread", [(1, 3), (4, 2), (4, 400), (7, 40), (64, 100)])
def test_nearest_is_the_lowest_of_the_nearest(width, spread):
    """Small spreads give many ties, within a book also equal entries."""
    rng = np.random.default_rng(width * spread)
    book, points = rng.integers(-spread, spread, (64, width)), rng.integers(-spread, spread, (500, width))
    every = ((points[:, None, :] - book[None]) ** 2).sum(2)
    index, best = vector_codes.nearest(points, book)
    assert (index == every.argmin(1)).all() and (best == every.min(1)).all()


def test_largest_numbers_do_not_overflow():
    top = vector_codes.LARGEST
    book = np.array([[top] * 256, [-top] * 256, [top - 1] * 256])
    index, best = vector_codes.nearest(np.array([[-top] * 256, [top] * 256, [0] * 256]), book)
    assert index.tolist() == [1, 0, 2] and best.tolist() == [0, 0, 256 * (top - 1) ** 2]


def coded(rows, parts, entries, rounds):
    """The contract, number by number; ``rows`` are (vec_id, label, whole numbers) in order of vec_id."""
    width = len(rows[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            d = [[sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)) for e in books[p]] for p in range(parts)]
            out.append([(min(x), x.index(min(x))) for x in d])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == e]
                if mine:
                    books[p][e] = [math.floor(sum(x) / len(mine)) for x in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in assign()]
    total = {}
    for (_, label, _), e in zip(rows, errors, strict=True):
        total[label] = total.get(label, 0) + e
    return [(i, "".join(f"{e:02x}" for _, e in f), err, total[label], digest) for (i, label, _), f, err in zip(rows, assign(), errors, strict=True)]


def test_against_every_entry(spark):
    """Null labels, repeated rows and ids, few distinct vectors (unused entries), extra columns."""
    rng = np.random.default_rng(9)
    rows = [(i, [None, 1, 2][i % 3], rng.integers(-4, 5, 8).tolist()) for i in range(40)]
    rows += [rows[7], rows[7], (50, 1, rows[3][2])]
    rows.sort(key=lambda r: (r[0], r[2]))
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id bigint, label int, v array<bigint>, code string, error int")
    got = vector_codes.compress(frame.repartition(5), parts=4, entries=10, rounds=2).collect()
    assert sorted(map(tuple, got)) == sorted(coded(rows, 4, 10, 2))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 1, [0.5, -0.001]), (2, None, None), (3, 1, [None, 1.0]), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]), (None, None, [0.5, 0.25]), (6, 2, [1.0]), (7, 2, [1e30, 1.0]), (8, None, [0.25, 0.25]), (9, 3, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    got = {r.vec_id: r for r in vector_codes.compress(vector_codes.vectors_of(frame), parts=2).collect()}
    assert set(got) == {1, None, 8}
    assert got[1].code == "0000" and got[8].code == "0101" and got[None].code == "0001" and got[None].label_error == got[None].error == 0
    assert got[1].codebooks_sha256 == hashlib.sha256(b"128,64,-1,64").hexdigest()
    for empty in (frame.limit(0), frame.filter("vec_id = 9"), frame.filter("vec_id = 2")):
        assert vector_codes.compress(vector_codes.vectors_of(empty), parts=2).count() == 0
    assert QUERIES["op12_vector_codes"](spark, "/root/testdata/sf0.001").count() == 500
