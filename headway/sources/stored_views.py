"""Derived tables kept by month: questions read one stored partition instead of the facts.

A month of a view is one folder. A refresh writes new folders next to the old ones, then logs them
in one small write, which is the commit, and last points the partitions of the catalogue tables to
them. A reader sees the old month or the new one, never half of it, and a refresh that dies
between two of these steps leaves the old state or is finished by the next ``open``.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.functions.calendar import month_bucket
from headway.sources.tables import exists

#: Views that are written at the same time.
JOBS = 4
LOG = "view_name string, month date, seq int, location string, base_tables string, refresh string, source string, rows bigint, columns string, month_column string"


@dataclass(frozen=True)
class View:
    """``build(read, month)`` gives the rows of one month; ``read(name)`` is the same month of another view."""

    name: str
    month_column: str
    build: Callable[[Callable[[str], DataFrame], str], DataFrame]
    reads: tuple[str, ...]
    refresh: str = "monthly"


def month_prints(facts: DataFrame, date: str) -> dict[str, str]:
    """Count and sum of row hashes of each month: equal as long as a month's rows are, in any order.

    One pass with map-side sums; one row per month comes to the driver.
    """
    hashed = facts.select(month_bucket(F.col(date)).alias("month"), F.xxhash64(*facts.columns).cast("decimal(38,0)").alias("h"))
    rows = hashed.filter("month IS NOT NULL").groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).collect()
    return {str(r["month"]): f"{r['n']}:{r['h']}" for r in rows}


def in_order(views: Iterable[View]) -> list[View]:
    """Views after those that they read."""
    known = {v.name: v for v in views}
    out: list[View] = []

    def visit(view: View, path: tuple[str, ...]) -> None:
        if view.name in path:
            raise ValueError(f"views read each other: {' > '.join((*path, view.name))}")
        for name in view.reads:
            if name in known:
                visit(known[name], (*path, view.name))
        if view not in out:
            out.append(view)

    for v in known.values():
        visit(v, ())
    return out


@dataclass
class MonthlyViews:
    """Stored months of views below ``root``, a folder that all executors share.

    Catalogue tables are called ``<prefix>_<view>``. ``open`` makes them from the log where the
    catalogue lacks them, as in a new session.
    """

    spark: SparkSession
    root: str
    prefix: str
    views: list[View]
    prints: dict[str, str] = field(default_factory=dict)
    held: dict[tuple[str, str], dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.use(self.views)

    def use(self, views: list[View]) -> None:
        """Build from these views from now on (the same ones over newer tables)."""
        self.views = in_order(views)
        self._by_name = {v.name: v for v in self.views}

    def _table(self, name: str) -> str:
        return f"{self.prefix}_{name}"

    def open(self) -> MonthlyViews:
        if exists(self.spark, f"{self.root}/_log"):
            for row in self._latest().collect():  # one row per view and month
                self._point(row.asDict())
        return self

    def log(self) -> DataFrame:
        """Every stored month that ever was, one row each."""
        if not exists(self.spark, f"{self.root}/_log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.root}/_log")

    def _latest(self) -> DataFrame:
        last = Window.partitionBy("view_name", "month").orderBy(F.desc("seq"))  # few rows: views x months x loads
        return self.log().withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")

    def metadata(self) -> DataFrame:
        """View, base tables, refresh, month, rows, and how often the month was built."""
        loads = self.log().groupBy("view_name", "month").agg(F.count(F.lit(1)).alias("loads"))
        return self._latest().join(loads, ["view_name", "month"]).select("view_name", "base_tables", "refresh", "month", "rows", "loads")

    def months(self, name: str) -> list[str]:
        return sorted(m for v, m in self.held if v == name)

    def read(self, name: str, month: str | None = None) -> DataFrame:
        """A stored view, or one month of it: the scan lists that partition only."""
        rows = self.spark.table(self._table(name))
        return rows if month is None else rows.filter(F.col(self._by_name[name].month_column) == F.lit(month).cast("date"))

    def needed(self, names: Iterable[str]) -> list[View]:
        """The named views and all that they read, in order."""
        want = set(names)
        for view in reversed(self.views):
            if view.name in want:
                want |= set(view.reads) & set(self._by_name)
        return [v for v in self.views if v.name in want]

    def ensure(self, name: str, month: str) -> DataFrame:
        """One month of a view, built first, with the views that it reads, if it isn't stored."""
        self.ensure_all([name], month)
        return self.read(name, month)

    def ensure_all(self, names: Iterable[str], month: str) -> None:
        missing = [v.name for v in self.needed(names) if (v.name, month) not in self.held]
        if missing:
            self.build([month], missing, self.prints)

    def refresh(self, prints: dict[str, str], names: Iterable[str] | None = None) -> list[str]:
        """Rebuild the months whose ``prints`` (of ``month_prints``) differ from those logged; returns them."""
        self.prints = prints
        names = list(self._by_name) if names is None else list(names)
        stale = [m for m, p in prints.items() if any(self.held.get((n, m), {}).get("source") != p for n in names)]
        self.build(sorted(stale), names, prints)
        return sorted(stale)

    def build(self, months: list[str], names: Iterable[str], prints: dict[str, str]) -> None:
        """Write months of views in order of dependence; all of them become visible after the last is written.

        Months and views that don't wait for each other are written by jobs that run side by side.
        """
        names = set(names)
        staged: dict[tuple[str, str], str] = {}

        def write(task: tuple[View, str]) -> str:
            view, month = task
            return self._write(view, month, view.build(lambda n: self._of(staged, n, month), month))

        with ThreadPoolExecutor(JOBS) as jobs:
            for level in self._levels(names):
                tasks = [(view, month) for month in months for view in level]
                paths = list(jobs.map(write, tasks))
                staged |= {(view.name, month): path for (view, month), path in zip(tasks, paths, strict=True)}
        self._commit(staged, prints)

    def _levels(self, names: set[str]) -> list[list[View]]:
        """The named views in groups; each reads only views of earlier groups."""
        depth: dict[str, int] = {}
        for view in self.views:
            if view.name in names:
                depth[view.name] = 1 + max((depth[r] for r in view.reads if r in depth), default=-1)
        return [[self._by_name[n] for n, d in depth.items() if d == level] for level in sorted(set(depth.values()))]

    def replace(self, name: str, month: str, rows: DataFrame, source: str = "") -> None:
        """Swap in the given rows as one month of a view; other months and views stay."""
        self.replace_all({(name, month): rows}, source)

    def replace_all(self, rows: dict[tuple[str, str], DataFrame], source: str = "") -> None:
        """Swap in rows of several (view, month), written side by side; all become visible with one commit."""
        with ThreadPoolExecutor(JOBS) as jobs:
            paths = list(jobs.map(lambda key: self._write(self._by_name[key[0]], key[1], rows[key]), rows))
        self._commit(dict(zip(rows, paths, strict=True)), {month: source for _, month in rows})

    def _of(self, staged: dict[tuple[str, str], str], name: str, month: str) -> DataFrame:
        if (name, month) not in staged:
            return self.read(name, month)
        return self.spark.read.parquet(staged[name, month]).withColumn(self._by_name[name].month_column, F.lit(month).cast("date"))

    def _write(self, view: View, month: str, rows: DataFrame) -> str:
        path = f"{self.root}/{view.name}/{month}-{uuid.uuid4().hex}"
        inside = rows.filter(F.col(view.month_column) == F.lit(month).cast("date")).drop(view.month_column)
        inside.write.parquet(path)
        return path

    def _commit(self, staged: dict[tuple[str, str], str], prints: dict[str, str]) -> None:
        if not staged:
            return
        seq = 1 + max((r["seq"] for r in self.held.values()), default=0)

        def entry(key: tuple[str, str]) -> tuple:
            name, month = key
            view, data = self._by_name[name], self.spark.read.parquet(staged[key])
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields)
            return (name, dt.date.fromisoformat(month), seq, staged[key], ",".join(view.reads), view.refresh, prints.get(month, ""), data.count(), columns, view.month_column)

        with ThreadPoolExecutor(JOBS) as jobs:
            entries = list(jobs.map(entry, staged))
        log = self.spark.createDataFrame(entries, LOG).coalesce(1)
        log.write.mode("append").parquet(f"{self.root}/_log")
        for row in entries:
            self._point(dict(zip([c.split()[0] for c in LOG.split(", ")], row, strict=True)))

    def _point(self, row: dict) -> None:
        """Let the catalogue's partition of a month lie where the log says."""
        table, month = self._table(row["view_name"]), str(row["month"])
        part = f"PARTITION ({row['month_column']} = DATE'{month}')"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({row['columns']}, {row['month_column']} DATE) USING parquet "
            f"PARTITIONED BY ({row['month_column']}) LOCATION '{self.root}/{row['view_name']}'"
        )
        self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {part} LOCATION '{row['location']}'")
        self.spark.sql(f"ALTER TABLE {table} {part} SET LOCATION '{row['location']}'")
        self.spark.catalog.refreshTable(table)
        self.held[row["view_name"], month] = row

    def vacuum(self) -> int:
        """Delete folders that no partition points to (once no reader of old months is left); returns their number."""
        current = {re.sub(".*/", "", r["location"]) for r in self.held.values()}
        gone = 0
        for view in self.views:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{view.name}")
            files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for item in files.listStatus(folder) if files.exists(folder) else ():
                if item.getPath().getName() not in current:
                    gone += files.delete(item.getPath(), True)
        return gone

    def close(self) -> None:
        """Take the tables out of the catalogue; the files stay and can be opened again."""
        for view in self.views:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(view.name)}")
        self.held.clear()
