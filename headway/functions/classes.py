"""Threshold classes. Each scale lists (lower bound, label) from the top down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: class limits of the reports
DISTRICT_TRAFFIC = [
    (9_000_000, "very high"),
    (7_500_000, "high"),
    (6_000_000, "medium high"),
    (4_500_000, "medium"),
    (3_000_000, "medium low"),
    (1_500_000, "low"),
]
STATION_TRAFFIC = [
    (50_000, "extremely high"),
    (30_000, "very high"),
    (20_000, "high plus"),
    (10_000, "high"),
    (5_000, "medium high"),
    (2_000, "medium"),
]
MAP_TRAFFIC = [
    (500_000, "heavy"),
    (300_000, "busy"),
    (200_000, "raised"),
    (100_000, "normal"),
    (50_000, "light"),
    (20_000, "quiet"),
]
EFFICIENCY = [(20, "A"), (10, "B"), (5, "C"), (1, "D")]
DEMAND = [(2_000_000, "peak"), (1_500_000, "high"), (1_000_000, "medium")]
DELAY = [(1.5, "heavy"), (1.3, "congested"), (1.1, "normal")]
SUITABILITY = [(80, "매우 적합"), (60, "적합"), (40, "보통")]
SCORE_COLOUR = [(80, "red"), (60, "orange"), (40, "yellow"), (20, "green")]
SCORE_BANDS = [(90, "90+"), (80, "80-89"), (70, "70-79"), (60, "60-69")]
INEQUALITY = [(10, "DRT 필요성 매우 높음"), (5, "DRT 필요성 높음"), (3, "DRT 필요성 보통")]
OD_DEMAND = [(1000, "very high"), (500, "high"), (100, "medium"), (50, "low")]


def at_or_above(value: Column, scale: list[tuple[float, str]], otherwise: str) -> Column:
    return _chain(value, scale, otherwise, lambda v, limit: v >= limit)


def above(value: Column, scale: list[tuple[float, str]], otherwise: str) -> Column:
    return _chain(value, scale, otherwise, lambda v, limit: v > limit)


def _chain(value: Column, scale, otherwise: str, test) -> Column:
    out = F
    for limit, label in scale:
        out = out.when(test(value, limit), label)
    return out.otherwise(otherwise)


def traffic_class_district(v: Column) -> Column:
    return above(v, DISTRICT_TRAFFIC, "very low")


def traffic_class_station(v: Column) -> Column:
    return above(v, STATION_TRAFFIC, "very low")


def traffic_class_map(v: Column) -> Column:
    return above(v, MAP_TRAFFIC, "low")


def efficiency_grade(v: Column) -> Column:
    return at_or_above(v, EFFICIENCY, "F")


def demand_level(v: Column) -> Column:
    return at_or_above(v, DEMAND, "low")


def delay_level(minutes: Column, base: float = 90.0) -> Column:
    return at_or_above(minutes / base, DELAY, "smooth")


def delay_index(minutes: Column, base: float = 90.0) -> Column:
    return F.least(minutes / base * 100, F.lit(200.0))


def suitability(score: Column) -> Column:
    return at_or_above(score, SUITABILITY, "부적합")


def score_colour(score: Column) -> Column:
    return at_or_above(score, SCORE_COLOUR, "gray")


def score_band(score: Column) -> Column:
    return at_or_above(score, SCORE_BANDS, "<60")


def inequality_class(r: Column) -> Column:
    return above(r, INEQUALITY, "DRT 필요성 낮음")


def od_demand_class(v: Column) -> Column:
    return at_or_above(v, OD_DEMAND, "minimal")
