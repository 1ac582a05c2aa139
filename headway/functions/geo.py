"""Distance and point columns on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Rounded to 2 places; 0 when any coordinate is missing or zero."""
    usable = (lat1 != 0) & (lon1 != 0) & (lat2 != 0) & (lon2 != 0)
    return F.when(usable, F.round(great_circle_km(lat1, lon1, lat2, lon2), 2)).otherwise(0.0)


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere (an ellipsoid differs by up to about 0.5 %)."""
    return great_circle_km(lat1, lon1, lat2, lon2) * 1000


def make_point(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd ray cast of a point against one closed ring of ``{lon, lat}`` vertices."""
    edges = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )

    def crosses(edge: Column) -> Column:
        a, b = edge.getField("a"), edge.getField("b")
        straddles = (a.getField("lat") > lat) != (b.getField("lat") > lat)
        at = (b.getField("lon") - a.getField("lon")) * (lat - a.getField("lat")) / (
            b.getField("lat") - a.getField("lat")
        ) + a.getField("lon")
        return straddles & (lon < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def in_multipolygon(lon: Column, lat: Column, polygons: Column) -> Column:
    """Inside any polygon: odd number of its rings around the point (holes flip the parity)."""
    def inside(polygon: Column) -> Column:
        hits = F.size(F.filter(polygon, lambda ring: in_ring(lon, lat, ring)))
        return hits % 2 == 1

    return F.exists(polygons, inside)


def on_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """The point lies on an edge of the ring."""
    edges = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )

    def touches(edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        cross = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        between = lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(
            F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"])
        )
        return (cross == 0) & between

    return F.exists(edges, touches)


def strictly_within(lon: Column, lat: Column, polygons: Column) -> Column:
    """Inside the multipolygon and not on its boundary."""
    edge = F.exists(F.flatten(polygons), lambda ring: on_ring(lon, lat, ring))
    return in_multipolygon(lon, lat, polygons) & ~edge
