"""Exact top-k by inner product with multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import stored

#: Segments of the coarse, middle and fine summary.
LEVELS = (1, 4, 16)
#: Queries and candidates of a block; a task meets one block of each.
QUERIES, CANDIDATES = 512, 4_096


def scaled(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component, null unless all components are finite numbers."""
    values = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(False)), F.transform(values, lambda x: F.floor(x * factor)))


def statistics(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Root of length times mean, and root of length times deviation, of each segment of each row."""
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    size = np.diff(cuts).astype(float)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    mean = total / size
    spread = np.sqrt(np.maximum(square / size - mean * mean, 0))
    return mean * np.sqrt(size), spread * np.sqrt(size)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query, ties to the smaller id.

    Within a segment the product is at most length x (mean x mean + deviation x deviation): that is the
    largest product, as it is the least distance, which the segment statistics allow. The k candidates
    with the highest fine bounds are scored first; their k-th score is what any other bound must reach,
    coarse bounds first. Survivors are scored exactly. Numbers that a double can't hold exactly
    are scored with integers.
    """
    if not len(rows) or not len(queries):
        return []
    if not queries.shape[1]:
        return [(int(q), int(i), 0) for q in query_ids for i in np.sort(row_ids[row_ids != q])[:k]]
    q, x = queries.astype(float), rows.astype(float)
    limit = np.sqrt((q * q).sum(1).max()) * np.sqrt((x * x).sum(1).max())
    exact = limit < 2**52
    bounds = []
    for parts in LEVELS:
        (mq, dq), (mx, dx) = statistics(q, parts), statistics(x, parts)
        bounds.append((mq, dq, mx, dx))
    out = []
    mq, dq, mx, dx = bounds[-1]
    slack = 1e-9 * limit + 1e-6
    fine = mq @ mx.T + dq @ dx.T
    coarse = [b[0] @ b[2].T + b[1] @ b[3].T for b in bounds[:-1]]
    for i, own in enumerate(query_ids):
        use = np.flatnonzero(row_ids != own)
        if not len(use):
            continue
        score = (lambda at: (x[at] @ q[i]).astype(np.int64)) if exact else (lambda at: rows[at] @ queries[i])  # noqa: B023
        top = fine[i, use]
        if len(use) > k:
            lead = use[np.argpartition(-top, k - 1)[:k]]
            floor = score(lead).min() - slack
            for bound in (*coarse, fine):
                use = use[bound[i, use] >= floor]
        got = score(use)
        order = np.lexsort((row_ids[use], -got))[:k]
        out += [(int(own), int(row_ids[use[j]]), int(got[j])) for j in order]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERIES, block: int = CANDIDATES) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, v) with the highest inner product with each of ``queries`` (vec_id, v).

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller vec_id; rows with the
    query's own id take no part, nor do rows with a null id or vector, nor vectors of another length
    than the query's. Fewer candidates give fewer rows; empty tables none. Queries and candidates are
    dealt by hash into blocks of bounded size, each candidate block meets each query block in a task
    of its own, and k rows per query and block go on. The work is queries x rows; bounds only spare
    exact scores, as no index is promised.
    """
    good = stored(vectors.filter("vec_id IS NOT NULL AND v IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "v"), "vectors")
    ask = stored(queries.filter("vec_id IS NOT NULL AND v IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "v"), "queries")
    n_ask, n_rows = max(1, -(-ask.count() // query_block)), max(1, -(-good.count() // block))
    key = F.xxhash64("vec_id")
    left = ask.withColumn("qb", F.pmod(key, F.lit(n_ask))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    right = good.withColumn("cb", F.pmod(key, F.lit(n_rows))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_ask - 1))))
    cells = [F.col("qb").cast("long").alias("qb"), F.col("cb").cast("long").alias("cb"), F.size("v").alias("dim")]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            a = a.drop_duplicates("vec_id")  # rows that repeat a query ask once
            shape = (-1, int(a["dim"].iloc[0]))
            out = best(
                np.array(a["v"].tolist(), np.int64).reshape(len(a), shape[1]), a["vec_id"].to_numpy(),
                np.array(b["v"].tolist(), np.int64).reshape(len(b), shape[1]), b["vec_id"].to_numpy(), k,
            )
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    pairs = (
        left.select(*cells, "vec_id", "v").groupBy("qb", "cb", "dim")
        .cogroup(right.select(*cells, "vec_id", "v").groupBy("qb", "cb", "dim"))
        .applyInPandas(meet, "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
