"""Calendar columns and parameter checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RANGE_DAYS = 365
DAY_TYPES = ("weekday", "weekend", "all")

NIGHT_HOURS = [23, 0, 1, 2, 3]
MORNING_RUSH = [6, 7, 8]
EVENING_RUSH = [17, 18, 19]
LUNCH_HOURS = [11, 12, 13]


def dow(date: Column) -> Column:
    """Day of week with Sunday = 0."""
    return F.dayofweek(date) - 1


def is_weekend(date: Column) -> Column:
    return dow(date).isin(0, 6)


def day_type(date: Column) -> Column:
    return F.when(is_weekend(date), "weekend").otherwise("weekday")


def month_bucket(date: Column) -> Column:
    return F.trunc(date, "month")


def date_parts(df: DataFrame, date: str) -> DataFrame:
    d = F.col(date)
    return df.withColumns(
        {
            "day_of_week": dow(d),
            "is_weekend": is_weekend(d),
            "week_of_month": F.ceil(F.dayofmonth(d) / 7).cast("int"),
        }
    )


def month_filter(date: Column, month: str | dt.date) -> Column:
    """Half-open range on the bare date column, so that partitions and row groups prune."""
    first = dt.date.fromisoformat(str(month)).replace(day=1)
    following = (first + dt.timedelta(days=32)).replace(day=1)
    return (date >= F.lit(first)) & (date < F.lit(following))


def vulnerable_band(hour: Column) -> Column:
    return (
        F.when(hour.between(9, 11), "medical")
        .when(hour.between(14, 16), "welfare")
        .when(hour.between(18, 20), "evening")
        .otherwise("normal")
    )


def is_tourism_hour(hour: Column) -> Column:
    return hour.between(10, 16)


def days_present(date: Column) -> Column:
    """Distinct days inside one month as an aggregate.

    A 31-bit mask merges map-side like a sum, so no distinct expansion is shuffled. The
    caller must group by month (or filter to one).
    """
    return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth(date) - 1)))


def hours_present(hour: Column) -> Column:
    """Distinct hours of day as a 24-bit mask aggregate."""
    return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), hour.cast("int"))))


def check_request(
    start: str | dt.date,
    end: str | dt.date,
    day_kind: str = "all",
    district: str | None = None,
    districts: list[str] | None = None,
) -> None:
    """Reject parameter sets that the analytics calls do not accept."""
    first, last = (dt.date.fromisoformat(str(x)) for x in (start, end))
    if first > last:
        raise ValueError("start date is after end date")
    if (last - first).days > MAX_RANGE_DAYS:
        raise ValueError(f"date range is longer than {MAX_RANGE_DAYS} days")
    if day_kind not in DAY_TYPES:
        raise ValueError(f"day type must be one of {DAY_TYPES}")
    if district is not None and districts is not None and district not in districts:
        raise ValueError(f"unknown district {district!r}")


def data_range_flag(requests: DataFrame, text: str, facts: DataFrame, date: str = "record_date") -> DataFrame:
    """Flag date texts as inside the loaded range, outside it, or unreadable."""
    span = facts.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).select(F.struct("lo", "hi")).scalar()
    asked = F.try_to_date(F.col(text), "yyyy-MM-dd")
    inside = asked.between(span.getField("lo"), span.getField("hi"))
    return requests.withColumn("asked_date", asked).withColumns(
        {
            "format_ok": F.col("asked_date").isNotNull(),
            "in_range": F.coalesce(inside, F.lit(False)),
            "suggested_date": F.when(inside, F.col("asked_date")).otherwise(span.getField("hi")),
        }
    )


def relative_date(phrase: Column, offsets: dict[str, int], today: str | dt.date) -> Column:
    """Word such as ``yesterday`` to a date, counted from a given clock."""
    table = F.create_map(*[x for k, v in offsets.items() for x in (F.lit(k), F.lit(v))])
    return F.date_add(F.lit(dt.date.fromisoformat(str(today))), F.element_at(table, F.lower(F.trim(phrase))))


def request_problem(start: Column, end: Column, day_kind: Column, district: Column, day_kinds: list[str], districts: list[str] | None = None) -> Column:
    """``check_request`` over a request log: the first broken rule, NULL when all hold."""
    out = (
        F.when(start > end, "start after end")
        .when(F.datediff(end, start) > MAX_RANGE_DAYS, "range too long")
        .when(~day_kind.isin(day_kinds), "day type")
    )
    return out if districts is None else out.when(district.isNotNull() & ~district.isin(districts), "district")
