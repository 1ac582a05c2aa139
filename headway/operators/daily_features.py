"""Daily (route, stop, hour) features of the three models.

All dates are built at once. Windows run over one (date, route, stop), at most 24 rows; the
section mean is one aggregate per (date, route, hour) joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.calendar import is_tourism_hour, vulnerable_band

KEY = ["record_date", "route_id", "node_id"]
# fixed values: area weights by place category for the three models, and the default
POI_WEIGHTS = {
    "commute": {"인구밀집지역": 1.0, "발달상권": 0.8, "관광특구": 0.6, "고궁·문화유산": 0.4, "공원": 0.2},
    "tourism": {"관광특구": 1.0, "고궁·문화유산": 0.9, "발달상권": 0.8, "공원": 0.7},
    "vulnerable": {"인구밀집지역": 0.9, "공원": 0.8, "고궁·문화유산": 0.7, "발달상권": 0.6, "관광특구": 0.5},
}
POI_DEFAULT = 0.1


def _day():
    return Window.partitionBy(*KEY)


def with_section_mean(sph: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds the mean section load of the route at that hour and whether the route has sections."""
    load = sections.groupBy("record_date", "route_id", "hour").agg(F.avg("passenger_count").alias("section_mean"))
    routes = sections.select("record_date", "route_id").distinct().withColumn("has_sections", F.lit(True))
    return (
        sph.withColumn("passengers", F.col("ride_passenger") + F.col("alight_passenger"))
        .join(load, ["record_date", "route_id", "hour"], "left")
        .join(routes, ["record_date", "route_id"], "left")
    )


def _over(value: str, whole: Column) -> Column:
    return F.when(whole > 0, F.col(value) / whole).otherwise(0.0)


def _of_max(value: str) -> Column:
    return _over(value, F.max(value).over(_day()))


def _load() -> Column:
    return F.coalesce(F.col("section_mean"), F.lit(0.0)) / 1000.0


def _scored(df: DataFrame, parts: dict[str, Column], weights: dict[str, float], name: str) -> DataFrame:
    out = df.withColumns(parts)
    return out.withColumn(name, sum(F.col(c) * w for c, w in weights.items())).select(*KEY, "hour", *parts, name)


def daily_commute_features(sph: DataFrame, sections: DataFrame) -> DataFrame:
    parts = {
        "tc": _of_max("dispatch_count"),
        "pdr": _of_max("passengers"),
        "ru": _load(),
        "pcw": F.lit(0.5),
    }
    return _scored(with_section_mean(sph, sections), parts, {"tc": 0.3, "pdr": 0.4, "ru": 0.2, "pcw": 0.1}, "commute_drt_score")


def daily_tourism_features(sph: DataFrame, sections: DataFrame) -> DataFrame:
    """Hour factors are not capped here, unlike in the monthly model."""
    busy = is_tourism_hour(F.col("hour"))
    parts = {
        "tc": _of_max("dispatch_count") * F.when(busy, 1.2).otherwise(1.0),
        "tdr": _of_max("passengers") * F.when(busy, 1.1).otherwise(1.0),
        "ru": _load() * F.when(busy, 0.6).otherwise(0.4),
        "pcw": F.lit(0.7),
    }
    return _scored(with_section_mean(sph, sections), parts, {"tc": 0.25, "tdr": 0.35, "ru": 0.25, "pcw": 0.15}, "tourism_drt_score")


def daily_vulnerable_features(sph: DataFrame, sections: DataFrame) -> DataFrame:
    band = vulnerable_band(F.col("hour"))
    open_hours = band != "normal"
    in_band = lambda c: F.sum(F.when(open_hours, F.col(c)).otherwise(0)).over(_day())
    factor = F.when(band == "medical", 1.5).when(band == "welfare", 1.3).when(band == "evening", 1.2).otherwise(1.0)
    quiet = F.when(F.col("passengers") < 100, 1.4).otherwise(1.0)
    core = F.when(F.col("hour").isin(9, 14, 18), 1.2).otherwise(1.0)
    free = F.greatest(F.least(1.0 - _load(), F.lit(1.0)), F.lit(0.0))
    parts = {
        "var": _over("dispatch_count", in_band("dispatch_count")) * factor,
        "sed": _over("passengers", in_band("passengers")) * quiet * core,
        "mdi": F.when(F.col("has_sections"), free).otherwise(0.5) * F.when(open_hours, 0.3).otherwise(0.7),
        "avs": F.lit(0.7),
    }
    return _scored(with_section_mean(sph, sections), parts, {"var": 0.3, "sed": 0.25, "mdi": 0.25, "avs": 0.2}, "vulnerable_drt_score")


def poi_weights(places: DataFrame, category: str = "category") -> DataFrame:
    """Weights per model looked up in three constant maps (at most five entries each)."""
    def lookup(table: dict[str, float]) -> Column:
        m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
        return F.coalesce(F.try_element_at(m, F.col(category)), F.lit(POI_DEFAULT))

    return places.withColumns({f"{model}_weight": lookup(t) for model, t in POI_WEIGHTS.items()})
