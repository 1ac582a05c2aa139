"""Questions asked of the score tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import classes
from headway.functions.numbers import decimal_round
from headway.operators.joins import best_per_group, top_n
from headway.operators.scores import WEIGHTS

SCORE, HOUR = "total_drt_score", "hour_of_day"


def _early_best() -> Column:
    """Orders by score, then by the earlier hour."""
    return F.struct(SCORE, (-F.col(HOUR)).alias("later"))


def station_peaks(scores: DataFrame, stops: DataFrame) -> DataFrame:
    """Best score and its hour for every (district, stop) with a place in the stop table."""
    peaks = scores.groupBy("district_name", "station_id").agg(
        F.max(SCORE).alias("drt_score"), F.max_by("hour_of_day", _early_best()).alias("peak_hour")
    )
    names = stops.select(F.col("node_id").alias("station_id"), F.col("node_name").alias("station_name"), "latitude", "longitude")
    return peaks.join(names, "station_id")


def district_drt_scores(scores: DataFrame, stops: DataFrame, district: str) -> DataFrame:
    return station_peaks(scores.filter(F.col("district_name") == district), stops).orderBy(F.desc("drt_score"), "station_id")


def district_top(peaks: DataFrame, n: int = 5) -> DataFrame:
    return best_per_group(peaks, ["district_name"], n, F.desc("drt_score"), F.asc("station_id"))


def city_top_drt(peaks: DataFrame, districts: list[str], n: int = 10, per_district: int = 5) -> DataFrame:
    """Best of the districts' short lists."""
    lists = district_top(peaks.filter(F.col("district_name").isin(districts)), per_district)
    return top_n(lists, n, F.desc("drt_score"), F.asc("station_id"))


def station_drt_detail(scores: DataFrame, model: str, stations: list[str], hour: int | None = None) -> DataFrame:
    """24 rows per stop: hour score and parts, with peak, mean and current score attached."""
    w = Window.partitionBy("station_id")
    best = F.max(F.when(F.col(SCORE) > 0, _early_best())).over(w)
    return (
        scores.filter(F.col("station_id").isin(stations))
        .select(
            "station_id",
            "hour_of_day",
            "total_drt_score",
            *WEIGHTS[model],
            F.coalesce(best["total_drt_score"], F.lit(0.0)).alias("peak_score"),
            F.coalesce(-best["later"], F.lit(0)).alias("peak_hour"),
            F.avg(SCORE).over(w).alias("monthly_average"),
        )
        .withColumn("current_hour", F.lit(hour) if hour is not None else F.col("peak_hour"))
        .withColumn("current_score", F.max(F.when(F.col(HOUR) == F.col("current_hour"), F.col(SCORE))).over(w))
    )


def drt_model_statistics(scores: DataFrame) -> DataFrame:
    """One row: stops, mean of stop means, extremes, best and worst hour by mean."""
    stations = scores.groupBy("station_id").agg(F.avg(SCORE).alias("a"), F.max(SCORE).alias("x"), F.min(SCORE).alias("n"))
    by_hour = scores.groupBy("hour_of_day").agg(F.round(F.avg(SCORE), 8).alias("m"))
    hours = by_hour.agg(
        F.struct(
            F.max_by("hour_of_day", F.struct("m", -F.col(HOUR))).alias("peak"),
            F.min_by("hour_of_day", F.struct("m", HOUR)).alias("low"),
        )
    ).scalar()
    return stations.agg(
        F.count(F.lit(1)).alias("total_stations"),
        F.avg("a").alias("overall_avg_score"),
        F.max("x").alias("overall_max_score"),
        F.min("n").alias("overall_min_score"),
    ).withColumns({"peak_hour": hours["peak"], "lowest_hour": hours["low"]})


def with_model(tables: dict[str, DataFrame]) -> DataFrame:
    cols = ["station_id", "district_name", "hour_of_day", "total_drt_score"]
    return reduce(DataFrame.unionByName, [df.select(F.lit(m).alias("model"), *cols) for m, df in tables.items()])


def compare_drt_models(tables: dict[str, DataFrame], station: str) -> DataFrame:
    """Peak, its hour and the mean under every model; zeros for a model without the stop."""
    stats = (
        with_model(tables)
        .filter(F.col("station_id") == station)
        .groupBy("model")
        .agg(
            F.max(SCORE).alias("peak"),
            F.max_by("hour_of_day", _early_best()).alias("hour"),
            F.avg(SCORE).alias("mean"),
        )
        .filter(F.col("peak") > 0)
    )
    spark = stats.sparkSession
    models = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in tables])).alias("model"))
    return models.join(stats, "model", "left").select(
        F.lit(station).alias("station_id"),
        "model",
        F.coalesce("peak", F.lit(0.0)).alias("peak_score"),
        F.coalesce("hour", F.lit(0)).alias("peak_hour"),
        F.coalesce("mean", F.lit(0.0)).alias("avg_score"),
    )


def drt_score_filter(peaks: DataFrame, band: str | None = None, top: int | None = None, search: str | None = None, shown: int = 5) -> DataFrame:
    """Score band, then best n, or the first matches of a name or id search."""
    out = peaks
    if band is not None:
        out = out.filter(classes.score_band(F.col("drt_score")) == band)
    if search is not None:
        text = F.lower(F.lit(search))
        hit = F.lower("station_name").contains(text) | F.lower("station_id").contains(text)
        return top_n(out.filter(hit), shown, F.asc("station_id"))
    if top is not None:
        out = top_n(out, top, F.desc("drt_score"), F.asc("station_id"))
    return out


def drt_area_mean(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("district_name").agg(
        F.count(F.lit(1)).alias("stations"), F.round(F.avg("drt_score"), 1).alias("mean_score")
    )


def drt_suitability_class(tables: dict[str, DataFrame]) -> DataFrame:
    """Models ranked inside each district by their mean score, with a suitability label."""
    means = with_model(tables).groupBy("district_name", "model").agg(decimal_round(F.avg(SCORE), 4).alias("score"))
    ranked = best_per_group(means, ["district_name"], len(tables), F.desc("score"), F.asc("model"))
    return ranked.withColumns({"suitability": classes.suitability(F.col("score")), "colour": classes.score_colour(F.col("score"))})
