"""Stop graphs as edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.numbers import ratio_or_zero
from headway.operators.joins import top_n
from headway.operators.ranking import dense_index
from headway.operators.spatial import band_self_join, range_radius_join
from headway.session import freeze


def stop_index(stops: DataFrame) -> DataFrame:
    return dense_index(stops, "stop_id", name="node_idx")


def adjacency_distance(stops: DataFrame, km: float) -> DataFrame:
    return range_radius_join(stops, km)


def adjacency_route(route_stops: DataFrame, stops: DataFrame, width: int = 2) -> DataFrame:
    """Route neighbours among the given stops."""
    known = stops.select("node_id")
    return (
        band_self_join(route_stops, width)
        .join(known.withColumnRenamed("node_id", "src"), "src", "left_semi")
        .join(known.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        .select("src", "dst")
    )


def value_counts_top(usage: DataFrame, n: int = 50) -> DataFrame:
    """Rows of the n stops with the most rows."""
    top = top_n(usage.groupBy("stop_id").agg(F.count(F.lit(1)).alias("n")), n, F.desc("n"), F.asc("stop_id"))
    return usage.join(top.select("stop_id"), "stop_id", "left_semi")


def adjacency_complete(usage: DataFrame, n: int = 50) -> DataFrame:
    """All directed pairs of the n most used stops; n bounds the list attached to each row."""
    top = top_n(usage.groupBy("stop_id").agg(F.count(F.lit(1)).alias("n")), n, F.desc("n"), F.asc("stop_id"))
    everyone = top.agg(F.collect_list("stop_id").alias("ids")).scalar()
    return top.select(F.col("stop_id").alias("src"), F.explode(everyone).alias("dst")).filter("src <> dst")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected edges, mean degree and density of a symmetric edge list."""
    n = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return edges.agg(F.count(F.lit(1)).alias("m")).select(
        (F.col("m") / 2).alias("edges"),
        ratio_or_zero(F.col("m"), n).alias("mean_degree"),
        ratio_or_zero(F.col("m"), n * n).alias("density"),
    )


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Smallest node id of the component of every node (``node_id``, ``component``).

    Parents move towards the smallest id by hooking onto neighbours' grandparents and by
    shortcutting, so long chains need a logarithmic number of rounds. Each round is two joins
    and two mergeable minima (hubs shrink map-side); its result goes to reliable storage, which
    keeps the plan short and survives executor loss. Edges must be symmetric.
    """
    state = freeze(nodes.select("node_id", F.col("node_id").alias("f"), F.col("node_id").alias("g")))
    links = freeze(edges.select("src", "dst"))
    for _ in range(rounds):
        seen = (
            links.join(state.select(F.col("node_id").alias("dst"), "g"), "dst")
            .groupBy(F.col("src").alias("node_id"))
            .agg(F.min("g").alias("m"))
        )
        known = state.join(seen, "node_id", "left")
        offers = known.select("node_id", F.least("f", "g", F.coalesce("m", "f")).alias("f")).unionByName(
            known.filter("m IS NOT NULL").select(F.col("f").alias("node_id"), F.col("m").alias("f"))
        )
        parents = offers.groupBy("node_id").agg(F.min("f").alias("f"))
        grand = parents.select(F.col("node_id").alias("f"), F.col("f").alias("g_new"))
        moved = freeze(
            parents.join(grand, "f").join(state.select("node_id", F.col("g").alias("g_old")), "node_id")
        )
        changed = moved.filter("g_new <> g_old").limit(1).count()
        state = moved.select("node_id", "f", F.col("g_new").alias("g"))
        if not changed:
            return state.select("node_id", F.col("g").alias("component"))
    raise RuntimeError("components did not settle")


def _degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    count = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("d"))
    return nodes.select("node_id").join(count, "node_id", "left").select("node_id", F.coalesce("d", F.lit(0)).alias("d"))


def normalized_laplacian_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries of I − D^-1/2 A D^-1/2; an isolated node counts as degree 1."""
    deg = _degrees(nodes, edges).withColumn("d", F.greatest("d", F.lit(1)))
    ends = lambda c, n: deg.select(F.col("node_id").alias(c), F.col("d").alias(n))
    off = edges.join(ends("src", "d1"), "src").join(ends("dst", "d2"), "dst").select(
        "src", "dst", (-1 / F.sqrt(F.col("d1") * F.col("d2"))).alias("weight")
    )
    return off.unionByName(nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1.0).alias("weight")))


def laplacian_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries of D − A."""
    off = edges.select("src", "dst", F.lit(-1.0).alias("weight"))
    diagonal = _degrees(nodes, edges).select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.col("d").cast("double").alias("weight"))
    return off.unionByName(diagonal)
