"""Spatial joins by cells instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions import geo

KM_PER_DEGREE = 111.0  # below the true 111.19, so cells are never too small


def _cell(x: Column, size) -> Column:
    return F.floor(x / size).cast("long")


def spatial_within(stops: DataFrame, boundaries: DataFrame, cell: float = 0.02) -> DataFrame:
    """First boundary code of each active stop strictly inside a boundary.

    Boundaries are listed under every cell of their bounding box; a stop meets only boundaries
    of its own cell, then the polygon test decides. A stop in several boundaries keeps the
    smallest code through a mergeable aggregate.
    """
    vertices = F.flatten(F.flatten("polygons"))
    boxed = boundaries.select(
        "*",
        *[
            pick(F.transform(vertices, get)).alias(n)
            for n, pick, get in (
                ("_x0", F.array_min, lambda v: v["lon"]),
                ("_x1", F.array_max, lambda v: v["lon"]),
                ("_y0", F.array_min, lambda v: v["lat"]),
                ("_y1", F.array_max, lambda v: v["lat"]),
            )
        ],
    )
    celled = boxed.withColumn("_cx", F.explode(F.sequence(_cell(F.col("_x0"), cell), _cell(F.col("_x1"), cell)))).withColumn(
        "_cy", F.explode(F.sequence(_cell(F.col("_y0"), cell), _cell(F.col("_y1"), cell)))
    )
    points = stops.filter("is_active AND longitude IS NOT NULL AND latitude IS NOT NULL").select(
        "node_id", "longitude", "latitude", _cell(F.col("longitude"), cell).alias("_cx"), _cell(F.col("latitude"), cell).alias("_cy")
    )
    x, y = F.col("longitude"), F.col("latitude")
    hits = points.join(celled, ["_cx", "_cy"]).filter(geo.strictly_within(x, y, F.col("polygons")))
    return hits.groupBy("node_id").agg(F.min_by(F.struct("adm_cd", "adm_nm", "sggnm"), "adm_cd").alias("b")).select("node_id", "b.*")


def range_radius_join(stops: DataFrame, km: float) -> DataFrame:
    """Directed stop pairs at most ``km`` apart, without self pairs.

    Cells are at least ``km`` wide, so partners lie in the 3 × 3 cells around a stop. The width in
    longitude follows the largest latitude in the data.
    """
    lat_size = km / KM_PER_DEGREE
    top = stops.agg(F.max(F.abs(F.col("latitude"))).alias("m")).scalar()
    lon_size = km / (KM_PER_DEGREE * F.cos(F.radians(F.least(top + lat_size, F.lit(89.0)))))
    base = stops.select(
        "node_id", "longitude", "latitude", _cell(F.col("latitude"), lat_size).alias("_cy"), _cell(F.col("longitude"), lon_size).alias("_cx")
    )
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(_cx + i AS _cx, _cy + j AS _cy))))"))
    left = base.select(F.col("node_id").alias("src"), F.col("longitude").alias("_x1"), F.col("latitude").alias("_y1"), around.alias("_n")).select(
        "src", "_x1", "_y1", "_n._cx", "_n._cy"
    )
    right = base.select(F.col("node_id").alias("dst"), F.col("longitude").alias("_x2"), F.col("latitude").alias("_y2"), "_cx", "_cy")
    near = geo.great_circle_km(F.col("_y1"), F.col("_x1"), F.col("_y2"), F.col("_x2"))
    return (
        left.join(right, ["_cx", "_cy"])
        .filter(F.col("src") != F.col("dst"))
        .withColumn("dist_km", near)
        .filter(F.col("dist_km") <= km)
        .select("src", "dst", "dist_km")
    )


def band_self_join(route_stops: DataFrame, width: int = 2) -> DataFrame:
    """Stops at most ``width`` positions apart on a route, in both directions.

    Each row is listed under the neighbouring positions, which makes an equi-join on
    (route, position); a long route never meets itself as a whole.
    """
    near = F.explode(F.sequence(F.col("stop_sequence") - width, F.col("stop_sequence") + width))
    left = route_stops.select("route_id", F.col("stop_id").alias("src"), near.alias("stop_sequence"))
    right = route_stops.select("route_id", F.col("stop_id").alias("dst"), "stop_sequence")
    return left.join(right, ["route_id", "stop_sequence"]).filter("src <> dst").select("src", "dst").distinct()


def outer_rings(boundaries: DataFrame) -> DataFrame:
    """Exterior ring of every polygon, all polygons of a district kept."""
    return boundaries.select(
        "adm_cd", F.col("sggnm").alias("district_name"), F.posexplode(F.transform("polygons", lambda p: p[0])).alias("polygon_idx", "ring")
    )


def default_box() -> Column:
    """Closed ring used when a district has no boundary (fixed values)."""
    corners = [(126.9, 37.5), (127.1, 37.5), (127.1, 37.6), (126.9, 37.6), (126.9, 37.5)]
    return F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in corners])


def boundary_outer_ring(districts: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Rings of the asked districts; those without a boundary get the default box."""
    return districts.join(outer_rings(boundaries), "district_name", "left").withColumn("ring", F.coalesce("ring", default_box()))


def ring_segments(rings: DataFrame) -> DataFrame:
    """Undirected segments of rings, smaller end first."""
    edges = F.zip_with(
        F.slice("ring", F.lit(1), F.size("ring") - 1),
        F.slice("ring", F.lit(2), F.size("ring") - 1),
        lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")),
    )
    return rings.select(F.explode(edges).alias("e")).select("e.a", "e.b")


def city_boundary_union(boundaries: DataFrame) -> DataFrame:
    """Outline of the union of adjoining areas: segments that belong to one ring only."""
    return (
        ring_segments(outer_rings(boundaries))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 1")
        .select("a", "b")
    )
