"""Monthly views: late rows, order of dependence, interrupted refreshes, other sessions."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from headway.plans.stored import month_rows
from headway.session import scratch
from headway.sources.stored_views import MonthlyViews, View, in_order, month_prints

JAN, FEB, MAR = "2024-01-01", "2024-02-01", "2024-03-01"


def facts(spark, rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), k, n) for d, k, n in rows], "day date, stop string, n bigint")


FIRST = [("2024-01-03", "a", 5), ("2024-01-30", "b", 2), ("2024-02-01", "a", 7), ("2024-02-29", "a", 1)]
LATE = [("2024-01-31", "a", 10)]


def views(base):
    def totals(read, month):
        return base.groupBy(F.trunc("day", "month").alias("month"), "stop").agg(F.sum("n").alias("n"))

    def best(read, month):
        return read("totals").groupBy("month").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("stops"))

    return [View("best", "month", best, ("totals",)), View("totals", "month", totals, ("facts",), "daily")]


@pytest.fixture
def held(spark):
    root = scratch(spark, "views-test")
    made = MonthlyViews(spark, root, "t" + root[-10:], views(facts(spark, FIRST)))
    made.refresh(month_prints(facts(spark, FIRST), "day"))
    yield made
    made.close()


def rows(frame, *names):
    return sorted(tuple(str(r[n]) for n in names) for r in frame.collect())


BEFORE = [(JAN, "a", "5"), (JAN, "b", "2"), (FEB, "a", "8")]
AFTER = [(JAN, "a", "15"), (JAN, "b", "2"), (FEB, "a", "8")]


def totals(store):
    return rows(store.read("totals"), "month", "stop", "n")


def test_late_row_rebuilds_its_month_alone(spark, held):
    assert totals(held) == BEFORE and rows(held.read("best", JAN), "most", "stops") == [("5", "2")]
    before = dict(held.held)
    base = facts(spark, FIRST + LATE)
    held.use(views(base))
    assert held.refresh(month_prints(base, "day")) == [JAN]
    assert totals(held) == AFTER and rows(held.read("best"), "month", "most") == [(JAN, "15"), (FEB, "8")]
    assert held.held["totals", FEB] == before["totals", FEB]
    assert rows(held.metadata(), "view_name", "month", "rows", "loads", "base_tables", "refresh") == [
        ("best", JAN, "1", "2", "totals", "monthly"), ("best", FEB, "1", "1", "totals", "monthly"),
        ("totals", JAN, "2", "2", "facts", "daily"), ("totals", FEB, "1", "1", "facts", "daily"),
    ]
    assert held.refresh(month_prints(base.repartition(5), "day")) == []
    assert held.vacuum() == 2 and totals(held) == AFTER


def test_replacing_a_month_leaves_the_others(spark, held):
    new = held.read("totals", JAN).filter("stop = 'b'")
    held.replace("totals", JAN, new)
    assert totals(held) == [(JAN, "b", "2"), (FEB, "a", "8")]
    held.replace("totals", MAR, spark.createDataFrame([(dt.date(2024, 3, 1), "z", 1)], "month date, stop string, n bigint"))
    assert held.months("totals") == [JAN, FEB, MAR] and rows(held.read("totals", MAR), "stop") == [("z",)]
    held.replace("totals", FEB, new.limit(0))
    assert rows(held.read("totals"), "month") == [(JAN,), (MAR,)]


def test_scan_lists_one_month(held):
    plan = held.read("totals", JAN)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert len(held.read("totals", JAN).inputFiles()) < len(held.read("totals").inputFiles())


@pytest.mark.parametrize("step", ["_write", "_commit", "_point"])
def test_a_refresh_that_dies(spark, held, monkeypatch, step):
    """Before the log is written the old state stays; after it, the next ``open`` finishes."""
    base = facts(spark, FIRST + LATE)
    held.use(views(base))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(held, step, dies)
        with pytest.raises(RuntimeError):
            held.refresh(month_prints(base, "day"))
    assert totals(held) == BEFORE
    again = MonthlyViews(spark, held.root, held.prefix, views(base)).open()
    assert totals(again) == (AFTER if step == "_point" else BEFORE)
    assert again.refresh(month_prints(base, "day")) == ([] if step == "_point" else [JAN])
    assert totals(again) == AFTER


def test_another_session_opens_the_log(spark, held):
    held.close()
    other = MonthlyViews(spark, held.root, held.prefix + "x", views(facts(spark, FIRST))).open()
    assert totals(other) == BEFORE
    assert other.refresh(month_prints(facts(spark, FIRST), "day")) == []
    other.close()


def test_prints(spark):
    a = month_prints(facts(spark, FIRST), "day")
    assert set(a) == {JAN, FEB} and a == month_prints(facts(spark, FIRST[::-1]).repartition(3), "day")
    twice = month_prints(facts(spark, [*FIRST, FIRST[0], FIRST[0]]), "day")
    assert twice[JAN] != a[JAN] and twice[FEB] == a[FEB]
    assert month_prints(facts(spark, FIRST).limit(0), "day") == {}


def test_order_of_views():
    make = lambda name, *reads: View(name, "m", lambda read, month: None, reads)
    assert [v.name for v in in_order([make("c", "b", "x"), make("b", "a"), make("a")])] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        in_order([make("a", "b"), make("b", "a")])


def test_stored_questions_follow_the_events(spark, tmp_path):
    """A change of January's events changes the next answer about January."""
    from headway.plans.stored import stored
    from headway.sources.mapping import TransitTables
    from small_tables import SF

    for name in ("customer", "nation", "supplier"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    path = str(tmp_path / "events.parquet")
    events.write.parquet(path)
    total = lambda: stored(TransitTables(spark, str(tmp_path)), "station_monthly_traffic").agg(F.sum("total_ride")).first()[0]
    first = total()
    events.filter("event_id % 2 = 0").write.mode("append").parquet(path)
    assert total() == 2 * first


def test_several_months_are_replaced_by_one_commit(spark, held):
    new = lambda month, n: spark.createDataFrame([(dt.date.fromisoformat(month), "c", n)], "month date, stop string, n bigint")
    held.replace_all({("totals", JAN): new(JAN, 4), ("totals", MAR): new(MAR, 6)}, "by hand")
    assert totals(held) == [(JAN, "c", "4"), (FEB, "a", "8"), (MAR, "c", "6")]
    last = held.log().filter("source = 'by hand'").collect()
    assert len(last) == 2 and len({r.seq for r in last}) == 1 and sorted(r.rows for r in last) == [1, 1]


def test_month_rows_are_written_once(spark):
    base = spark.createDataFrame([(dt.date(2024, 1, 31), 1), (dt.date(2024, 2, 1), 2)], "record_date date, n bigint")
    of = month_rows("test", base)
    with ThreadPoolExecutor(4) as jobs:
        frames = list(jobs.map(of, [JAN] * 4))
    assert len({f.inputFiles()[0] for f in frames}) == 1 and [r.n for r in of(JAN).collect()] == [1]
    assert [r.n for r in of(FEB).collect()] == [2] and of(MAR).count() == 0


def test_views_of_a_month_share_its_facts(spark):
    from headway.plans.stored import monthly_views
    from headway.sources.mapping import TransitTables

    t = TransitTables(spark, "/root/testdata/sf0.001")
    by_name = {v.name: v for v in monthly_views(t)}
    hourly = by_name["station_hourly_patterns"].build(lambda name: None, JAN)
    for name in ("commuter_scores", "tourism_scores", "vulnerable_scores", "district_monthly_traffic"):
        files = by_name[name].build(lambda _: hourly, JAN).inputFiles()
        assert any("month-facts" in f for f in files) and not any("events" in f for f in files)


def test_models_are_built_together(spark, monkeypatch):
    from headway.plans import scores, stored
    from headway.sources.mapping import TransitTables

    built = []
    monkeypatch.setattr(stored, "_OPEN", {})
    monkeypatch.setattr(MonthlyViews, "build", lambda self, months, names, prints: built.append(sorted(names)))
    monkeypatch.setattr(MonthlyViews, "read", lambda self, name, month=None: spark.range(1))
    scores.models(TransitTables(spark, "/root/testdata/sf0.001"))
    assert built[0] == ["commuter_scores", "station_hourly_patterns", "tourism_scores", "vulnerable_scores"]
