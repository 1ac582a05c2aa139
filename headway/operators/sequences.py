"""Feature rows, dense hourly grids and model sequences.

The hours of a stop are cut into blocks of a week or more. A block is one row with an ordered array
of its hours and of those that its sequences look back and ahead to, so sequences are slices, and
a stop with a long history is many blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import demand
from headway.functions.calendar import is_weekend
from headway.operators.joins import one_row
from headway.session import scratch
from headway.sources.tables import features_with_stops

HOUR_LEN, DAY_LEN, WEEK_LEN, WEEK_BACK, HORIZON = 6, 24, 24, 168, 24
#: Hours of a block, if no sequence looks back further, and hours of a task.
BLOCK, TASK_HOURS = 168, 100_000


def route_interval_join(usage: DataFrame, route_stats: DataFrame) -> DataFrame:
    """Usage with the mean intervals of its stop; stops without routes get defaults."""
    missing = F.lit(float(demand.NO_SERVICE))
    return usage.join(route_stats, "stop_id", "left").withColumns(
        {
            "weekday_interval": F.coalesce("avg_weekday_interval", missing),
            "saturday_interval": F.coalesce("avg_saturday_interval", missing),
            "sunday_interval": F.coalesce("avg_sunday_interval", missing),
            "route_count": F.coalesce("route_count", F.lit(1)),
        }
    )


def mstgcn_features(usage: DataFrame, route_stats: DataFrame) -> DataFrame:
    """Four inputs and the target per stop and hour."""
    rows = route_interval_join(usage, route_stats).withColumns(
        {"hour_of_day": F.hour("recorded_at"), "day_of_week": F.dayofweek("recorded_at") - 1}
    )
    rows = rows.withColumn(
        "applicable_interval",
        demand.applicable_interval(*[F.col(c) for c in ("weekday_interval", "saturday_interval", "sunday_interval", "day_of_week")]),
    ).withColumn("service_availability", demand.service_availability(F.col("is_operational"), F.col("is_in_service_hours")))
    return rows.select(
        "stop_id",
        "recorded_at",
        "boarding_count",
        demand.log_z_boarding(F.col("boarding_count")).alias("normalized_log_boarding_count"),
        "service_availability",
        demand.is_rest_day(F.col("is_weekend"), F.col("is_holiday")).alias("is_rest_day"),
        demand.log_z_interval(F.col("applicable_interval")).alias("normalized_interval"),
        "hour_of_day",
        "day_of_week",
        "is_weekend",
        "is_holiday",
        "applicable_interval",
        "route_count",
        demand.drt_probability(
            *[F.col(c) for c in ("boarding_count", "applicable_interval", "hour_of_day", "is_weekend", "is_holiday", "service_availability")]
        ).alias("drt_probability"),
    )


@dataclass(frozen=True)
class HourGrid:
    """Every stop x every hour from 0 to ``last``; absent values are 0.

    ``known`` holds the hours that have values (stop_id, t_idx, values), ``first`` is the time of hour 0.
    """

    known: DataFrame
    values: tuple[str, ...]
    first: str | None
    last: int
    stops: int

    def blocks(self, before: int = 0, after: int = 0) -> DataFrame:
        """stop_id, own range ``lo``..``hi``, ``start`` and an array of each value from ``start`` on.

        Arrays reach ``before`` hours back and ``after`` ahead of the own hours, as far as the grid goes.
        A known hour goes to the blocks that hold it, two or three; nothing else is shuffled. Tasks are
        counted by the hours to come, as a few known rows may stand for many.
        """
        size = max(BLOCK, before, after)
        top = self.last // size
        t = F.col("t_idx")
        first = F.greatest(F.floor((t - after) / size), F.lit(0))
        upto = F.least(F.floor((t + before) / size), F.lit(top))
        cells = self.known.select("stop_id", F.explode(F.sequence(first, upto)).alias("block"), F.struct("t_idx", *self.values).alias("cell"))
        every = self.known.select("stop_id").distinct().select("stop_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top).cast("long"))).alias("block"))
        every = every.withColumn("cell", F.lit(None).cast(cells.schema["cell"].dataType))
        tasks = max(1, -(-self.stops * (self.last + 1) // TASK_HOURS))
        held = cells.unionByName(every).repartition(tasks, "stop_id", "block").groupBy("stop_id", "block")
        held = held.agg(F.sort_array(F.collect_list("cell")).alias("s"))  # at most size + before + after cells
        lo = F.col("block") * size
        held = held.select(
            "stop_id", "s", lo.alias("lo"), F.least(lo + size - 1, F.lit(self.last)).alias("hi"),
            F.greatest(lo - before, F.lit(0)).alias("start"), F.least(lo + size - 1 + after, F.lit(self.last)).alias("end"),
        )
        return held.select("stop_id", "lo", "hi", "start", *[self._dense(v).alias(v) for v in self.values])

    @staticmethod
    def _dense(value: str) -> Column:
        zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
        following = lambda i: F.coalesce(F.get(F.col("s"), i)["t_idx"], F.col("end") + 1)
        filled = F.transform("s", lambda x, i: F.concat(F.array(x[value]), zeros(following(i + 1) - x["t_idx"] - 1)))
        return F.concat(zeros(following(F.lit(0)) - F.col("start")), F.flatten(filled))

    def spans(self, first: int = 0, ahead: int = 0) -> DataFrame:
        """stop_id and the first and last hour (lo, hi) of its ``sequences``, known without making them."""
        lo, hi = F.lit(first).cast("int").alias("lo"), F.lit(self.last - ahead).cast("int").alias("hi")
        return self.known.select("stop_id").distinct().select("stop_id", lo, hi).filter("lo <= hi")

    def at(self, t: Column) -> Column:
        return F.lit(self.first).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), t.cast("int"))

    def rows(self) -> DataFrame:
        """stop_id, t_idx, hour_at and the values, one row per stop and hour."""
        cells = self.blocks().select("stop_id", "lo", F.posexplode(F.arrays_zip(*self.values)).alias("pos", "cell"))
        t = (F.col("lo") + F.col("pos")).cast("int")
        return cells.select("stop_id", t.alias("t_idx"), self.at(t).alias("hour_at"), *[F.col("cell")[v].alias(v) for v in self.values])

    def sequences(self, columns: Callable[[Callable[[str, Column, int], Column], Column], dict[str, Column]], before: int, after: int, first: int = 0, ahead: int = 0) -> DataFrame:
        """stop_id, t_idx and ``columns(cut, t)`` of each hour t from ``first`` on that has ``ahead`` hours after it.

        ``cut(value, at, n)`` gives n values from hour ``at`` on.
        """
        def cut(value: str, at: Column, n: int) -> Column:
            return F.slice(F.col(value), (at - F.col("start") + 1).cast("int"), n)

        own = self.blocks(before, after).withColumns({"lo": F.greatest("lo", F.lit(first)), "hi": F.least("hi", F.lit(self.last - ahead))})
        made = F.transform(F.sequence("lo", "hi"), lambda t: F.struct(t.cast("int").alias("t_idx"), *[c.alias(n) for n, c in columns(cut, t).items()]))
        return own.filter("lo <= hi").select("stop_id", F.explode(made).alias("made")).select("stop_id", "made.*")


def hour_grid(rows: DataFrame, values: list[str], time: str = "recorded_at") -> HourGrid:
    """Grid between the first and last hour of ``rows``; repeated (stop, hour) rows are averaged.

    The averaged rows are written once; the span and the number of stops, one row, come from there to
    the driver. Without rows the grid is empty.
    """
    hour = F.date_trunc("hour", F.col(time)).cast("timestamp_ntz")
    spark = rows.sparkSession
    path = scratch(spark, "hour-grid")
    once = rows.groupBy("stop_id", hour.alias("hour_at")).agg(*[F.avg(v).alias(v) for v in values])
    once.filter("hour_at IS NOT NULL").write.parquet(path)
    once = spark.read.schema(once.schema).parquet(path)
    row = once.agg(
        F.min("hour_at").cast("string").alias("first"), F.timestamp_diff("HOUR", F.min("hour_at"), F.max("hour_at")).alias("last"),
        F.approx_count_distinct("stop_id").alias("stops"),
    ).first()
    first = F.lit(row["first"]).cast("timestamp_ntz")
    known = once.select("stop_id", F.timestamp_diff("HOUR", first, F.col("hour_at")).alias("t_idx"), *values)
    return HourGrid(known, tuple(values), row["first"], -1 if row["last"] is None else int(row["last"]), row["stops"])


def densify_time_grid(rows: DataFrame, values: list[str], time: str = "recorded_at") -> DataFrame:
    """Every stop x every hour between the first and last hour; absent values are 0."""
    return hour_grid(rows, values, time).rows()


def pivot_feature_matrix(grid: DataFrame, values: list[str]) -> DataFrame:
    """Long matrix entries (feature, stop, time, value)."""
    pairs = ", ".join(f"'{v}', cast({v} AS double)" for v in values)
    return grid.selectExpr("stop_id", "t_idx", f"stack({len(values)}, {pairs}) AS (feature, value)")


SCALES = {"hour": (HOUR_LEN, HOUR_LEN), "day": (DAY_LEN, DAY_LEN), "week": (WEEK_BACK, WEEK_LEN)}


def multi_scale_sequences(grid: HourGrid, inputs: list[str], target: str, names: tuple[str, ...] = tuple(SCALES)) -> DataFrame:
    """Arrays of the last 6 and 24 hours, the same 24 hours a week back, and the next 24 targets.

    With ``names``, only the input arrays of these scales are made; the rows are the same.
    """
    scales = {s: SCALES[s] for s in names}

    def columns(cut, t):
        arrays = {f"{v}_{s}": cut(v, t - back, n) for v in inputs for s, (back, n) in scales.items()}
        return {"hour_at": grid.at(t), **arrays, "y": cut(target, t, HORIZON)}

    return grid.sequences(columns, WEEK_BACK, HORIZON, first=WEEK_BACK, ahead=HORIZON - 1)


def feature_window(features: DataFrame, at: str, values: list[str], hours: int = 6, days: int = 24, weeks: int = 24) -> DataFrame:
    """Three time-ordered array sets before a moment, labelled by scale."""
    t = F.lit(at).cast("timestamp_ntz")
    step = lambda n, unit: F.expr(f"INTERVAL {n} {unit}")
    week = t - step(7, "DAY")
    spans = {"hour": (t - step(hours, "HOUR"), t), "day": (t - step(days, "HOUR"), t), "week": (week - step(weeks, "HOUR"), week)}
    parts = [
        _window_arrays(features, lo, hi, values).withColumn("scale_type", F.lit(name)) for name, (lo, hi) in spans.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def target_window(features: DataFrame, at: str, hours: int = 24) -> DataFrame:
    t = F.lit(at).cast("timestamp_ntz")
    return _window_arrays(features, t, t + F.expr(f"INTERVAL {hours} HOUR"), ["drt_probability"])


def _window_arrays(features: DataFrame, lo: Column, hi: Column, values: list[str]) -> DataFrame:
    rows = features.filter((F.col("recorded_at") >= lo) & (F.col("recorded_at") < hi))
    ordered = rows.groupBy("stop_id").agg(F.sort_array(F.collect_list(F.struct("recorded_at", *values))).alias("s"))
    return ordered.select("stop_id", *[F.col(f"s.{c}").alias(f"{c}_sequence") for c in ("recorded_at", *values)])


def periodic_samples(grid: HourGrid, value: str, hours: int = 6, days: int = 3, weeks: int = 2, horizon: int = 1) -> DataFrame:
    """Hour slice; points 24 h apart and 168 h apart, newest first, as far as they exist."""

    def columns(cut, t):
        points = lambda step, n: F.flatten(F.array(*[F.when(t >= step * k, cut(value, t - step * k, 1)).otherwise(F.array().cast("array<double>")) for k in range(1, n + 1)]))
        return {
            "hour_sample": F.when(t >= hours, cut(value, t - hours, hours)),
            "day_sample": points(24, days),
            "week_sample": points(168, weeks),
            "target": cut(value, t, horizon),
        }

    return grid.sequences(columns, max(hours, 24 * days, 168 * weeks), horizon, ahead=horizon - 1)


def strided_samples(grid: HourGrid, value: str, hours: int = 6, days: int = 3, weeks: int = 1, horizon: int = 1) -> DataFrame:
    """Day points oldest first and seven daily points per week; only where all points exist."""

    def columns(cut, t):
        point = lambda at: F.get(F.col(value), (at - F.col("start")).cast("int"))
        daily = lambda n: F.when(t >= 24 * n, F.array(*[point(t - 24 * d) for d in range(n, 0, -1)]))
        return {
            "hour_sample": F.when(t >= hours, cut(value, t - hours, hours)),
            "day_sample": daily(days),
            "week_sample": daily(7 * weeks),
            "target": cut(value, t, horizon),
        }

    return grid.sequences(columns, max(hours, 24 * days, 168 * weeks), horizon, ahead=horizon - 1)


def sliding_windows(grid: HourGrid, value: str, history: int = 6, horizon: int = 1) -> DataFrame:
    return grid.sequences(lambda cut, t: {"x": cut(value, t - history, history), "y": cut(value, t, horizon)}, history, horizon, first=history, ahead=horizon - 1)


def temporal_split(samples: DataFrame, train: float = 0.6, valid: float = 0.2, spans: DataFrame | None = None) -> DataFrame:
    """Ordered split of the anchor times: cut points are truncated shares of their number.

    ``spans`` (lo, hi) states the anchor times, if they are known; else the samples are made once more to find them.
    """
    ends = samples.agg(F.min("t_idx").alias("lo"), F.max("t_idx").alias("hi")) if spans is None else spans.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    span = one_row(ends, "lo", "hi")
    n = span["hi"] - span["lo"] + 1
    idx = F.col("t_idx") - span["lo"]
    first, second = F.floor(n * train), F.floor(n * (train + valid))
    return samples.withColumn("sample_idx", idx).withColumn(
        "split", F.when(idx < first, "train").when(idx < second, "val").otherwise("test")
    )


def train_zscore(split: DataFrame, value: str) -> DataFrame:
    """Scaled by mean and population deviation of the training rows only."""
    row = one_row(
        split.filter("split = 'train'").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")), "mean", "std"
    )
    return split.withColumn(f"{value}_z", (F.col(value) - row["mean"]) / row["std"])


def feature_stats(grid: DataFrame, values: list[str]) -> DataFrame:
    v = F.col("value")
    return pivot_feature_matrix(grid, values).groupBy("feature").agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )


def common_stops(rows: DataFrame, period: str) -> DataFrame:
    """Stops present in every period."""
    periods = rows.agg(F.countDistinct(period).alias("n")).scalar()
    return rows.groupBy("stop_id").agg(F.countDistinct(period).alias("n")).filter(F.col("n") == periods).select("stop_id")


def merge_monthly_sequences(parts: list[DataFrame], spans: list[DataFrame] | None = None) -> DataFrame:
    """Per-period sequences of the common stops, placed one after the other in time.

    ``spans`` has the first and last hour (stop_id, lo, hi) of each stop's sequences in each period, if they are
    known; else one pass over the sequences finds them. One row per stop and period is written.
    """
    mark = lambda frames: reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(frames)])
    marked = mark(parts)
    found = marked.groupBy("part", "stop_id").agg(F.min("t_idx").alias("lo"), F.max("t_idx").alias("hi")) if spans is None else mark(spans)
    path = scratch(marked.sparkSession, "sequence-spans")
    found.write.parquet(path)
    found = marked.sparkSession.read.schema(found.schema).parquet(path)
    common = common_stops(found, "part")
    sizes = found.join(common, "stop_id", "left_semi").groupBy("part").agg((F.max("hi") - F.min("lo") + 1).alias("n"), F.min("lo").alias("t0"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per period
    offsets = sizes.select("part", "t0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    kept = marked.join(common, "stop_id", "left_semi")
    return kept.join(F.broadcast(offsets), "part").withColumn("sample_idx", F.col("offset") + F.col("t_idx") - F.col("t0")).drop("t0", "offset")


def forecast_error(samples: DataFrame, predicted: str, actual: str, batch: int = 32, steps: int | None = None) -> DataFrame:
    """Mean of per-batch mean squared errors, and its root.

    Where all arrays have ``steps`` values, the squares are added without a fold; the order of adding is the same.
    """
    square = lambda p, a: (p - a) * (p - a)
    if steps is None:
        total = F.aggregate(F.zip_with(predicted, actual, square), F.lit(0.0), lambda s, x: s + x)
    else:
        total = reduce(lambda s, k: s + square(F.get(predicted, F.lit(k)), F.get(actual, F.lit(k))), range(steps), F.lit(0.0))
    losses = (
        samples.select(F.floor(F.col("sample_idx") / batch).alias("batch"), total.alias("sq"), F.size(actual).alias("n"))
        .groupBy("batch")
        .agg((F.sum("sq") / F.sum("n")).alias("loss"))
    )
    return losses.agg(F.avg("loss").alias("mse")).withColumn("rmse", F.sqrt("mse"))


def extract_temporal(features: DataFrame, start: str, end: str) -> DataFrame:
    return features.filter(
        F.col("recorded_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    ).select("recorded_at", "stop_id", "drt_probability", "hour_of_day", "day_of_week", "is_weekend")


def timeseries_long(grid: DataFrame, stops: DataFrame, stop_limit: int | None = None, hour_limit: int | None = None) -> DataFrame:
    """Flat table of the grid with stop names and calendar columns (weekday 0 = Monday).

    The limits make the sample form: first stops by id, first hours.
    """
    rows = grid
    if stop_limit is not None:
        chosen = grid.select("stop_id").distinct().orderBy("stop_id").limit(stop_limit)
        rows = rows.join(chosen, "stop_id", "left_semi")
    if hour_limit is not None:
        rows = rows.filter(F.col("t_idx") < hour_limit)
    named = stops.select(F.col("node_id").alias("stop_id"), F.col("node_name").alias("stop_name"), "latitude", "longitude")
    date = F.col("hour_at").cast("date")
    return rows.join(named, "stop_id").withColumns(
        {"hour_of_day": F.hour("hour_at"), "day_of_week": F.weekday(date), "is_weekend": is_weekend(date)}
    )


def training_view(features: DataFrame, stops: DataFrame) -> DataFrame:
    return demand.cyclical_time(features_with_stops(features, stops)).withColumnRenamed("drt_probability", "target_value")


def dataset_metadata(grid: DataFrame, values: list[str]) -> DataFrame:
    return grid.agg(
        F.countDistinct("stop_id").alias("num_nodes"),
        F.lit(len(values)).alias("num_features"),
        (F.max("t_idx") + 1).alias("num_timesteps"),
        F.min("hour_at").alias("first_hour"),
        F.max("hour_at").alias("last_hour"),
    )


def stop_spatial_features(usage: DataFrame, route_stats: DataFrame) -> DataFrame:
    """Per stop: mean daily boardings, peak over mean, share of hours without demand, routes."""
    daily = usage.groupBy("stop_id", F.col("recorded_at").cast("date").alias("day")).agg(
        F.sum("boarding_count").alias("boardings"),
        F.count(F.lit(1)).alias("hours"),
        F.count(F.when(F.col("boarding_count") == 0, 1)).alias("empty"),
        F.max("boarding_count").alias("peak"),
    )
    per_stop = daily.groupBy("stop_id").agg(
        F.avg("boardings").alias("avg_daily_boarding"),
        (F.max("peak") / F.when(F.sum("boardings") > 0, F.sum("boardings") / F.sum("hours"))).alias("peak_demand_ratio"),
        (F.sum("empty") / F.sum("hours")).alias("zero_demand_rate"),
    )
    return per_stop.join(route_stats.select("stop_id", "avg_weekday_interval", F.col("route_count").alias("total_routes")), "stop_id", "left")
