"""Demand patterns (survey section 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.operators import anomaly
from headway.plans.registry import define, register, rounded_even
from headway.plans.views import shp
from headway.sources.mapping import MONTH

# The given events are far fewer than a city's ridership, so the traffic floors are parameters here.
AREA = {"minimum": 100, "confidence": [(500, 1.0), (300, 0.8), (200, 0.7)]}


def top_sql(hours, measure, name, day, n=5, extra="", district=None):
    where = ["month_date = DATE '2024-01-01'"]
    if day:
        where.append(f"day_type = '{day}'")
    if hours:
        where.append(f"hour IN ({', '.join(map(str, hours))})")
    if district:
        where.append(f"district_name = '{district}'")
    cols = "".join(f", coalesce(sum({measure}) FILTER (hour = {h}), 0) AS hour_{h}" for h in hours or [])
    base = f"SELECT station_id, station_name, district_name, sum({measure}) AS {name}{cols} FROM shp WHERE {' AND '.join(where)} GROUP BY ALL"
    ratio = rounded_even(f"CAST({name} AS DOUBLE) / (SELECT sum({name}) / count(*) FROM ({base}))", 1)
    keep = f"WHERE {name} > 0" if hours else ""
    return f"""SELECT *, {ratio} AS vs_average, row_number() OVER (ORDER BY {name} DESC, station_id) AS rank
        FROM ({base}) {keep} ORDER BY {name} DESC, station_id LIMIT {n}"""


def spec(name, hours):
    return f"rank:i station_id:s station_name:s district_name:s {name}:i " + " ".join(f"hour_{h}:i" for h in hours) + " vs_average:f1"


define("wk_top", top_sql(None, "total_traffic", "weekend_total", "weekend"))
define(
    "wk_hours",
    """SELECT station_id, string_agg(CAST(hour AS VARCHAR), ',' ORDER BY place) AS peak_hours,
       string_agg(CAST(ht AS VARCHAR), ',' ORDER BY place) AS peak_traffic FROM (
         SELECT station_id, hour, CAST(sum(total_traffic) AS BIGINT) AS ht,
         row_number() OVER (PARTITION BY station_id ORDER BY sum(total_traffic) DESC, hour) AS place
         FROM shp WHERE day_type = 'weekend' AND month_date = DATE '2024-01-01' GROUP BY station_id, hour)
       WHERE place <= 3 GROUP BY station_id""",
)


def joined(df, *arrays):
    return df.withColumns({a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",") for a in arrays})


register(
    "weekend_dominant",
    "rank:i station_id:s station_name:s district_name:s weekend_total:i vs_average:f1 peak_hours:s peak_traffic:s",
    lambda t: joined(anomaly.weekend_dominant(shp(t, MONTH), MONTH), "peak_hours", "peak_traffic"),
    "SELECT w.*, peak_hours, peak_traffic FROM wk_top AS w JOIN wk_hours AS h ON w.station_id = h.station_id",
)
register(
    "weekend_peak_hours",
    "station_id:s peak_hours:s peak_traffic:s",
    lambda t: joined(anomaly.weekend_peak_hours(shp(t, MONTH), MONTH, shp(t, MONTH).select("station_id").distinct()), "peak_hours", "peak_traffic"),
    "SELECT * FROM wk_hours",
)
NIGHT = [23, 0, 1, 2, 3]
register(
    "night_demand",
    spec("total_night_ride", NIGHT),
    lambda t: anomaly.night_demand(shp(t, MONTH), MONTH),
    top_sql(NIGHT, "total_ride", "total_night_ride", None),
)
register(
    "night_peak_hour",
    "station_id:s total_night_ride:i peak_hour:i",
    lambda t: anomaly.night_peak_hour(anomaly.night_demand(shp(t, MONTH), MONTH, n=50)),
    f"""SELECT station_id, total_night_ride, CASE greatest(hour_23, hour_0, hour_1, hour_2, hour_3)
       WHEN hour_23 THEN 23 WHEN hour_0 THEN 0 WHEN hour_1 THEN 1 WHEN hour_2 THEN 2 ELSE 3 END AS peak_hour
       FROM ({top_sql(NIGHT, "total_ride", "total_night_ride", None, 50)})""",
)
for side, hrs in (("morning", [6, 7, 8]), ("evening", [17, 18, 19])):
    register(
        f"rush_hour_{side}",
        spec(f"total_{side}_rush", hrs),
        lambda t, side=side: anomaly.rush_hour(shp(t, MONTH), MONTH, side),
        top_sql(hrs, "total_ride", f"total_{side}_rush", "weekday"),
    )
register(
    "rush_hour_top",
    spec("total_rush_ride", []),
    lambda t: anomaly.rush_hour_top(shp(t, MONTH), MONTH, "NATION_3"),
    top_sql([7, 8, 17, 18, 19], "total_ride", "total_rush_ride", "weekday", district="NATION_3"),
)
register(
    "lunch_time",
    spec("total_lunch_alight", [11, 12, 13]),
    lambda t: anomaly.lunch_time(shp(t, MONTH), MONTH),
    top_sql([11, 12, 13], "total_alight", "total_lunch_alight", "weekday"),
)


def area_sql(kind, n=5, minimum=100, tiers=((500, 1.0), (300, 0.8), (200, 0.7))):
    a, b, c, d = ("mr", "ma", "ea", "er") if kind == "residential" else ("ma", "mr", "er", "ea")
    weight = "CASE " + " ".join(f"WHEN total_traffic >= {x} THEN {w}" for x, w in tiers) + " ELSE 0.5 END"
    return f"""SELECT station_id, station_name, district_name, mr AS morning_ride, ma AS morning_alight,
       er AS evening_ride, ea AS evening_alight, total_traffic,
       round(({a} / ({a} + {b}) + {c} / ({c} + {d})) / 2 * CAST({weight} AS DOUBLE) * 100 + 1e-9, 1) AS imbalance_ratio
       FROM (SELECT station_id, station_name, district_name,
         coalesce(sum(total_ride) FILTER (hour < 12), 0) AS mr, coalesce(sum(total_alight) FILTER (hour < 12), 0) AS ma,
         coalesce(sum(total_ride) FILTER (hour > 12), 0) AS er, coalesce(sum(total_alight) FILTER (hour > 12), 0) AS ea,
         sum(total_traffic) AS total_traffic FROM shp
         WHERE day_type = 'weekday' AND hour IN (6, 7, 8, 17, 18, 19) AND month_date = DATE '2024-01-01' GROUP BY ALL)
       WHERE {a} > {b} AND {c} > {d} AND total_traffic >= {minimum} ORDER BY imbalance_ratio DESC, station_id LIMIT {n}"""


AREA_SPEC = "station_id:s station_name:s district_name:s morning_ride:i morning_alight:i evening_ride:i evening_alight:i total_traffic:i imbalance_ratio:f1"
for kind in ("residential", "business"):
    register(
        f"area_{kind}",
        AREA_SPEC,
        lambda t, kind=kind: anomaly.area_type(shp(t, MONTH), MONTH, kind, **AREA),
        area_sql(kind),
    )
define(
    "under",
    """SELECT *, round(p * 100 / avg(p) OVER () + 1e-9, 1) AS utilization_rate,
       round(p / greatest(connecting_routes, 1) + 1e-9, 1) AS efficiency_score,
       quantile_cont(total, 0.25) OVER () AS bar FROM (
         SELECT station_id, station_name, district_name, round(avg(total_traffic)) AS p,
         max(total_traffic) AS max_daily_passengers, max(route_count) AS connecting_routes,
         CAST(sum(total_traffic) AS BIGINT) AS total FROM shp WHERE month_date = DATE '2024-01-01' GROUP BY ALL)""",
)
UNDER = "SELECT *, p AS avg_daily_passengers FROM under WHERE total <= bar AND p > 0 ORDER BY p, efficiency_score, station_id LIMIT {n}"
register(
    "underutilized",
    "station_id:s station_name:s district_name:s avg_daily_passengers:i max_daily_passengers:i connecting_routes:i "
    "utilization_rate:f1 efficiency_score:f1",
    lambda t: anomaly.underutilized(shp(t, MONTH), MONTH, n=10),
    UNDER.format(n=10),
)
register(
    "anomaly_integration",
    "pattern:s station_id:s district_name:s value:f1",
    lambda t: anomaly.anomaly_integration(shp(t, MONTH), MONTH),
    " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, station_id, district_name, CAST({v} AS DOUBLE) AS value FROM ({q})"
        for p, v, q in [
            ("weekend_dominant", "weekend_total", "SELECT * FROM wk_top"),
            ("night_demand", "total_night_ride", top_sql(NIGHT, "total_ride", "total_night_ride", None)),
            ("rush_morning", "total_morning_rush", top_sql([6, 7, 8], "total_ride", "total_morning_rush", "weekday")),
            ("rush_evening", "total_evening_rush", top_sql([17, 18, 19], "total_ride", "total_evening_rush", "weekday")),
            ("lunch_time", "total_lunch_alight", top_sql([11, 12, 13], "total_alight", "total_lunch_alight", "weekday")),
            ("residential", "imbalance_ratio", area_sql("residential", 5, 2000, ((10000, 1.0), (5000, 0.8), (2000, 0.7)))),
            ("business", "imbalance_ratio", area_sql("business", 5, 2000, ((10000, 1.0), (5000, 0.8), (2000, 0.7)))),
            ("underutilized", "avg_daily_passengers", UNDER.format(n=5)),
        ]
    ),
)
register(
    "rush_summary",
    "morning_total:i morning_max:i evening_total:i evening_max:i morning_evening_ratio:f2",
    lambda t: anomaly.rush_summary(anomaly.rush_hour(shp(t, MONTH), MONTH, "morning"), anomaly.rush_hour(shp(t, MONTH), MONTH, "evening")),
    f"""SELECT *, morning_total / evening_total AS morning_evening_ratio FROM
       (SELECT sum(total_morning_rush) AS morning_total, max(total_morning_rush) AS morning_max
        FROM ({top_sql([6, 7, 8], "total_ride", "total_morning_rush", "weekday")})) CROSS JOIN
       (SELECT sum(total_evening_rush) AS evening_total, max(total_evening_rush) AS evening_max
        FROM ({top_sql([17, 18, 19], "total_ride", "total_evening_rush", "weekday")}))""",
)
register(
    "area_summary",
    "residential_morning_ride:i business_morning_alight:i residential_evening_alight:i business_evening_ride:i "
    "max_imbalance:f1 mean_imbalance:f1 max_morning_ride:i max_morning_alight:i max_evening_ride:i max_evening_alight:i",
    lambda t: anomaly.area_summary(
        anomaly.area_type(shp(t, MONTH), MONTH, "residential", **AREA), anomaly.area_type(shp(t, MONTH), MONTH, "business", **AREA)
    ),
    f"""SELECT coalesce(sum(morning_ride) FILTER (kind = 'r'), 0) AS residential_morning_ride,
       coalesce(sum(morning_alight) FILTER (kind = 'b'), 0) AS business_morning_alight,
       coalesce(sum(evening_alight) FILTER (kind = 'r'), 0) AS residential_evening_alight,
       coalesce(sum(evening_ride) FILTER (kind = 'b'), 0) AS business_evening_ride,
       max(imbalance_ratio) AS max_imbalance, avg(imbalance_ratio) AS mean_imbalance,
       greatest(max(morning_ride), 1) AS max_morning_ride, greatest(max(morning_alight), 1) AS max_morning_alight,
       greatest(max(evening_ride), 1) AS max_evening_ride, greatest(max(evening_alight), 1) AS max_evening_alight
       FROM (SELECT *, 'r' AS kind FROM ({area_sql("residential")}) UNION ALL SELECT *, 'b' FROM ({area_sql("business")}))""",
)
register(
    "district_averages",
    "district_name:s avg_weekend_increase_pct:f4 avg_night_traffic_ratio:f4 avg_rush_hour_traffic:f4 "
    "avg_lunch_spike_pct:f4 avg_cv_coefficient:f4 total_stations:i",
    lambda t: anomaly.district_averages(t.sph, t.sm, MONTH),
    """WITH b AS (SELECT sgg_name, sph.node_id, day_type, hour, avg(alight_passenger) AS al,
         avg(ride_passenger + alight_passenger) AS tt, stddev_samp(ride_passenger + alight_passenger) AS sd
         FROM sph JOIN sm ON sph.node_id = sm.node_id
         WHERE ride_passenger + alight_passenger > 0 AND month_date = DATE '2024-01-01' GROUP BY ALL),
       w AS (SELECT node_id, avg(tt) FILTER (day_type = 'weekend') AS we, avg(tt) FILTER (day_type = 'weekday') AS wd,
         avg(CASE WHEN hour IN (23, 0, 1, 2, 3) THEN tt ELSE 0 END) / avg(tt) * 100 AS night FROM b GROUP BY node_id)
       SELECT sgg_name AS district_name, avg((we - wd) / wd * 100) AS avg_weekend_increase_pct,
       avg(night) AS avg_night_traffic_ratio,
       avg(CASE WHEN hour IN (6, 7, 8, 17, 18, 19) THEN tt ELSE 0 END) AS avg_rush_hour_traffic,
       avg(CASE WHEN hour IN (11, 12, 13) THEN al ELSE 0 END) / avg(al) * 100 AS avg_lunch_spike_pct,
       avg(sd / tt) AS avg_cv_coefficient, count(DISTINCT b.node_id) AS total_stations
       FROM b JOIN w ON b.node_id = w.node_id WHERE we IS NOT NULL AND wd IS NOT NULL GROUP BY sgg_name""",
)
