"""The monthly views of the transit tables, and the store that the registered questions read."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.calendar import month_filter
from headway.operators import od, scores, views
from headway.session import scratch
from headway.sources.mapping import MONTH, TransitTables
from headway.sources.stored_views import MonthlyViews, View, month_prints

#: Tables whose change concerns every month.
DIMENSIONS = ("customer", "nation", "supplier")
_OPEN: dict[tuple[str, str], tuple[tuple[str, str], MonthlyViews]] = {}


def month_rows(label: str, rows: DataFrame) -> Callable[[str], DataFrame]:
    """Gives one month of a base table; the first view that asks derives and writes it for all views, also from other threads."""
    held: dict[str, DataFrame] = {}
    lock = Lock()

    def of(month: str) -> DataFrame:
        with lock:
            if month not in held:
                path = scratch(rows.sparkSession, f"month-{label}")
                rows.filter(month_filter(rows["record_date"], month)).write.parquet(path)
                held[month] = rows.sparkSession.read.schema(rows.schema).parquet(path)
            return held[month]

    return of


def monthly_views(t, sph: DataFrame | None = None, od_wide: DataFrame | None = None) -> list[View]:
    """Base views, score tables and OD summary; ``sph`` and ``od_wide`` may stand for those of ``t``."""
    facts = month_rows("facts", t.sph if sph is None else sph)
    sections = month_rows("sections", t.sections)
    trips = t.od_wide if od_wide is None else od_wide
    hourly = "station_hourly_patterns"

    def score(build):
        return lambda read, m: build(facts(m), sections(m), read(hourly), t.sm, m)

    def summary(read, m):
        routes = od.collect_routes_per_stop(t.route_stops, t.routes)
        daily = od.daily_od_generated(od.daily_od_build(trips, t.od_stops, routes))
        return od.monthly_od_summary(daily, t.stops, month=m)

    return [
        View("hourly_traffic_patterns", "month_date", lambda read, m: views.hourly_traffic_patterns(facts(m), t.sm), ("station_passenger_history",)),
        View("district_monthly_traffic", "month_date", lambda read, m: views.district_monthly_traffic(facts(m), t.sm, m), ("station_passenger_history",)),
        View("station_monthly_traffic", "month_date", lambda read, m: views.station_monthly_traffic(facts(m), t.sm, t.stops, m), ("station_passenger_history",)),
        View("city_hourly_patterns", "month_date", lambda read, m: views.city_hourly_patterns(read("hourly_traffic_patterns")), ("hourly_traffic_patterns",)),
        View(hourly, "month_date", lambda read, m: views.station_hourly_patterns(facts(m), t.sm, t.stops, m), ("station_passenger_history",)),
        View("commuter_scores", "analysis_month", score(scores.commuter_scores), ("station_passenger_history", "section_passenger_history", hourly)),
        View("tourism_scores", "analysis_month", score(scores.tourism_scores), ("station_passenger_history", "section_passenger_history", hourly)),
        View("vulnerable_scores", "analysis_month", score(scores.vulnerable_scores), ("station_passenger_history", "section_passenger_history", hourly)),
        View("monthly_od_summary", "analysis_month", summary, ("daily_od",)),
    ]


def _state(t, *names: str) -> str:
    """Name, length and time of change of the files of source tables."""
    out = []
    for name in names:
        path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.folder}/{name}.parquet")
        files = path.getFileSystem(t.spark._jsc.hadoopConfiguration())
        out += sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in files.listStatus(path) if files.exists(path))
    return "|".join(out)


def store(t) -> MonthlyViews:
    """The store of ``t``'s folder, one for each session.

    It is built on demand. Where the events' files changed since, the months whose rows changed are
    built again; where a dimension changed, everything is.
    """
    where = (t.spark.sparkContext.applicationId, t.folder)
    facts, dimensions = _state(t, "events"), _state(t, *DIMENSIONS)
    seen, held = _OPEN.get(where, (("", ""), None))
    builders = monthly_views(TransitTables(t.spark, t.folder))
    if held is None or seen[1] != dimensions:
        root = scratch(t.spark, "monthly-views")
        held = MonthlyViews(t.spark, root, "months_" + root[-12:], builders, month_prints(t.ev, "record_date"))
    elif seen[0] != facts:
        held.use(builders)
        prints = month_prints(t.ev, "record_date")
        held.refresh({m: p for m, p in prints.items() if m in {k for _, k in held.held}}, {v for v, _ in held.held})
        held.prints = prints
    _OPEN[where] = ((facts, dimensions), held)
    return held


def ensure(t, names: Iterable[str], month: str = MONTH) -> None:
    """Build what is missing of a month of these views together, side by side where they don't wait for each other."""
    store(t).ensure_all(names, month)


def stored(t, name: str, month: str = MONTH) -> DataFrame:
    """One stored month of a view."""
    return t.built(f"stored {name} {month}", lambda: store(t).ensure(name, month))
