"""Checks over logged SQL texts and the guarded runner."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.text_rules import strip

# fixed values: words that a read-only query must not contain
FORBIDDEN_COMMANDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "REPLACE",
    "MERGE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "CALL", "DECLARE",
]
RUNNER_FUNCTIONS = ["reflect", "java_method", "try_reflect"]  # they call any code of the driver
FORBIDDEN_FUNCTIONS = ["pg_sleep", "pg_read_file", "pg_write_file", "pg_ls_dir", "copy", "lo_import", "lo_export"]
UNSAFE_WORDS = ["DELETE", "DROP", "INSERT", "UPDATE", "TRUNCATE", "ALTER"]
# fixed values: tables that raise the confidence (the station facts count twice), and names that lower it
KNOWN_TABLES = [
    "bus_stops", "spatial_mapping", "station_passenger_history", "daily_od_analysis",
    "bus_routes", "route_stops", "operation_schedules", "route_details",
    "section_passenger_history", "section_speed_history", "od_traffic_history",
    "station_passenger_history", "road_traffic_history",
    "drt_commuter_scores", "drt_tourism_scores", "drt_vulnerable_scores",
    "admin_boundaries", "spatial_ref_sys",
    "area_vulnerability_scores", "poi_tourism_weights", "population_cache", "etl_job_status", "etl_job_logs",
    "mv_seoul_hourly_patterns", "mv_hourly_traffic_patterns", "mv_station_hourly_patterns",
    "mv_district_monthly_traffic", "mv_station_monthly_traffic", "mv_monthly_od_summary",
    "monthly_district_traffic_summary",
]
WRONG_TABLES = ["mv_daily_hourly_traffic", "traffic_summary", "bus_station_traffic"]
TYPE_PATTERNS = {
    "time_series": ["hour", "record_date", "DATE_TRUNC"],
    "aggregation": ["GROUP BY", "SUM", "COUNT", "AVG"],
    "spatial": ["ST_", "coordinates", "geometry"],
    "basic": ["WHERE", "ORDER BY"],
    "complex": ["JOIN", "SUBQUERY", "WITH", "CASE WHEN"],
}


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def sql_safety_flags(sql: Column) -> dict[str, Column]:
    """Rule set of the runner and the shorter rule set of the generator.

    Function names are matched in any case.
    """
    upper = F.upper(strip(sql))
    commands = rf"\b({'|'.join(FORBIDDEN_COMMANDS)})\b"
    functions = rf"(?i)\b({'|'.join(FORBIDDEN_FUNCTIONS)})\b"
    starts = upper.startswith("SELECT") | upper.startswith("WITH")
    hit, call = F.regexp_extract(upper, commands, 1), F.lower(F.regexp_extract(sql, functions, 1))
    empty = strip(sql) == ""
    unsafe = reduce(lambda c, w: c.when(upper.contains(w), f"word {w}"), UNSAFE_WORDS, F)
    return {
        "error": F.when(empty, "empty").when(hit != "", F.concat(F.lit("command "), hit)).when(call != "", F.concat(F.lit("function "), call)),
        "is_safe": ~empty & (hit == "") & (call == ""),
        "warn_start": ~starts,
        "warn_multiple": _count(sql, ";") > 1,
        "generator_error": F.when(empty, "empty")
        .when(~starts, "start")
        .when(upper.contains("SELECT") & ~upper.contains("FROM"), "no FROM")
        .otherwise(F.coalesce(unsafe.otherwise(None), F.when(_count(sql, "(") != _count(sql, ")"), "brackets"))),
    }


def extract_sql_text(answer: Column) -> Column:
    """The fenced SQL block, else the lines from the first SELECT or WITH up to a note."""
    fenced = F.regexp_extract(answer, r"(?s)```sql\n(.*?)\n```", 1)
    lines = F.transform(F.split(answer, "\n"), strip)
    starts = F.transform(lines, lambda x: F.upper(x).startswith("SELECT") | F.upper(x).startswith("WITH"))
    first = F.array_position(starts, F.lit(True)).cast("int")
    tail = F.when(first > 0, F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines))).otherwise(F.expr("cast(array() as array<string>)"))
    notes = F.transform(tail, lambda x: x.startswith("**") | x.startswith("###") | x.startswith("설명:"))
    stop = F.array_position(notes, F.lit(True)).cast("int")
    body = F.when(stop > 0, F.slice(tail, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(tail)
    chosen = F.when(fenced != "", fenced).otherwise(F.array_join(body, "\n"))
    return F.regexp_replace(strip(chosen), ";+$", "")


def extract_field(answer: Column, label: str, otherwise: str = "") -> Column:
    found = F.regexp_extract(answer, rf"(?si)\*\*{label}\*\*:?\s*(.*?)(?=\*\*|$)", 1)
    return F.when(F.regexp_extract(answer, rf"(?si)(\*\*{label}\*\*)", 1) == "", otherwise).otherwise(strip(found))


def sql_confidence(sql: Column, query_type: Column, data_from: str, data_to: str) -> Column:
    """Additive score between 0.1 and 1 from keywords, table names, date range and type patterns."""
    upper, low = F.upper(sql), F.lower(sql)
    points = lambda test, n: F.when(test, n).otherwise(0.0)
    parts = [F.lit(0.5), points(upper.contains("SELECT"), 0.2), points(upper.contains("FROM"), 0.1)]
    parts += [points(low.contains(t), 0.05) for t in KNOWN_TABLES]
    parts += [points(low.contains(t), -0.3) for t in WRONG_TABLES]
    parts.append(points(sql.contains(data_from) & sql.contains(data_to), 0.1))
    for kind, patterns in TYPE_PATTERNS.items():
        parts += [points((query_type == kind) & low.contains(p.lower()), 0.1) for p in patterns]
    return F.least(F.greatest(sum(parts[1:], parts[0]), F.lit(0.1)), F.lit(1.0))


def check_sql(sql: str) -> None:
    """Raise ``ValueError`` for a text that is not a read-only query."""
    if not sql.strip():
        raise ValueError("empty SQL text")
    word = re.search(rf"\b({'|'.join(FORBIDDEN_COMMANDS + FORBIDDEN_FUNCTIONS + RUNNER_FUNCTIONS)})\b", sql, re.IGNORECASE)
    if word:
        raise ValueError(f"not allowed: {word.group(1)}")


WRITING = ("Insert", "Overwrite", "Append", "Update", "Delete", "Merge", "Create", "Replace", "Drop", "Alter", "Add", "Rename", "Truncate", "Set", "Reset", "Call", "Execute")


def _top(spark: SparkSession, sql: str) -> str:
    """Name of the top node of the parsed plan, below common table expressions; nothing is run."""
    plan = spark.sql(f"EXPLAIN EXTENDED {sql}").first()[0]
    tree = plan.partition("== Parsed Logical Plan ==\n")[2].partition("\n== ")[0]
    top = tree.split("\n", 1)[0]
    below = re.findall(r"(?m)^\+- (.*)", tree)
    return re.match(r"\W*(\w*)", below[-1] if top.startswith("CTE ") and below else top).group(1)


@dataclass(frozen=True)
class GuardedRows:
    """Rows of a guarded query, at most ``limit`` of them if that is set."""

    query: DataFrame
    limit: int | None

    @property
    def rows(self) -> DataFrame:
        return self.query if self.limit is None else self.query.limit(self.limit)

    @property
    def summary(self) -> DataFrame:
        """One row: ``row_count`` of ``rows``, and whether the query has more (``truncated``)."""
        if self.limit is None:
            return self.query.agg(F.count(F.lit(1)).alias("row_count"), F.lit(False).alias("truncated"))
        n = self.query.limit(self.limit + 1).agg(F.count(F.lit(1)).alias("n"))
        return n.select(F.least("n", F.lit(self.limit)).alias("row_count"), (F.col("n") > self.limit).alias("truncated"))


def guarded_sql(spark: SparkSession, sql: str, limit: int | None = 1000) -> GuardedRows:
    """Run a read-only query over the registered views, limited unless it limits itself.

    The text is checked first; then the plan, which is made but not run, must not be a command that
    writes, and says whether a LIMIT ends the query; one in a subquery doesn't count.
    """
    check_sql(sql)
    text = sql.strip().rstrip(";")
    top = _top(spark, text)
    if top.startswith(WRITING):
        raise ValueError("not allowed: the statement is not a query")
    return GuardedRows(spark.sql(text), None if not limit or top == "GlobalLimit" else limit)


SQL_FUNCTIONS = """
CREATE OR REPLACE TEMPORARY FUNCTION calculate_distance(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)
RETURNS DOUBLE RETURN 2 * 6371000 * asin(sqrt(least(1.0D,
  power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))
;
CREATE OR REPLACE TEMPORARY FUNCTION calculate_drt_probability(
  boardings BIGINT, minutes DOUBLE, hour INT, weekend BOOLEAN, holiday BOOLEAN, availability INT)
RETURNS DOUBLE RETURN round(greatest(0.0D, least(1.0D, (
  (0.05D + 0.9D / (1 + exp(-(ln(greatest(minutes, 1.0D)) - 4.9986D) / 0.7142D)))
    * CASE availability WHEN 0 THEN 1.5D WHEN 1 THEN 1.2D ELSE 1.0D END * 0.5D
  + greatest(0.05D, 1 - ((ln(boardings + 1) - 0.153D) / 0.456D + 0.3355D) / 10.691D) * 0.3D
  + CASE WHEN hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19 THEN 1.0D WHEN hour BETWEEN 10 AND 16 THEN 0.8D
         WHEN hour BETWEEN 20 AND 22 THEN 0.6D ELSE 0.4D END * 0.2D)
  * CASE WHEN weekend OR holiday THEN 1.2D ELSE 1.0D END)), 4)
"""


def register_sql_functions(spark: SparkSession) -> None:
    """Named scalar functions as SQL expressions, which Catalyst inlines into the plan."""
    for statement in SQL_FUNCTIONS.split("\n;\n"):
        spark.sql(statement)
