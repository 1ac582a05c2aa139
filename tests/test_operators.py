"""Small fixtures and brute force for what SQL does not check."""

import datetime as dt
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.functions import calendar as cal
from headway.functions import geo, sql_rules, text_rules
from headway.operators import anomaly, chunks, graph, joins, od_queries, ranking, reshape, retrieval, scores, sequences, spatial
from headway.sources import tables


def values(df, column):
    return [r[column] for r in df.collect()]


# numbers and ranks -----------------------------------------------------------------------


@pytest.mark.parametrize("data", [[1, 2, 3, 4], [5], [7, 1], [3, 3, 9], list(range(1, 38)), [10, 400, 2, 2, 81, 7]])
def test_exclusive_quartiles(spark, data):
    row = ranking.exclusive_quartiles(spark.createDataFrame([(x,) for x in data], "v long"), "v").first()
    expected = [int(q) for q in statistics.quantiles(data, n=4)] if len(data) > 1 else data * 3
    assert [row.q1, row.q2, row.q3] == expected


def test_continuous_percentile(spark):
    data = [random.Random(3).randint(0, 1000) for _ in range(101)] + [5, 5]
    df = spark.createDataFrame([(x,) for x in data], "v long")
    got = spark.range(1).select(ranking.continuous_percentile(df, "v", 0.25).alias("q")).first().q
    assert got == pytest.approx(float(np.percentile(data, 25)))


@pytest.mark.parametrize("spread", [0, 3, 5_000, 1 << 44])
def test_order_statistics_of_every_rank(spark, spread):
    """Negative and far values, many repeats, nulls; no sort in Spark."""
    rng = random.Random(spread)
    data = [rng.randint(-spread, spread) for _ in range(300)] + [spread] * 100
    df = spark.createDataFrame([(x,) for x in [*data, None]], "v long").repartition(4)
    ranks = [0, 1, 75, 150, 299, 300, 398, 399]
    assert ranking.order_statistics(df, "v", lambda n: ranks) == (400, {r: sorted(data)[r] for r in ranks})
    assert ranking.order_statistics(df.filter("v IS NULL"), "v", lambda n: ranks) == (0, {})
    none = ranking.exclusive_quartiles(df.limit(0), "v").first()
    assert list(none) == [None] * 3
    assert spark.range(1).select(ranking.continuous_percentile(df.limit(0), "v", 0.25)).first()[0] is None


def test_dense_index_covers_all_positions(spark):
    df = spark.range(1000).withColumn("k", F.md5(F.col("id").cast("string"))).repartition(7)
    rows = ranking.dense_index(df, "k").orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(1000))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


# scores ------------------------------------------------------------------------------------

SHP = (
    "month_date date, day_type string, station_id string, district_name string, hour int, total_ride long, "
    "total_alight long, total_traffic long, operating_days long"
)


def shp_rows(spark, rows):
    return spark.createDataFrame([(dt.date(2024, 1, 1), *r) for r in rows], SHP)


def test_integer_and_exact_division(spark):
    shp = shp_rows(spark, [("weekday", "a", "D", 9, 7, 0, 7, 2)])
    assert values(scores.traffic_per_day(shp, "2024-01-01", "weekday"), "avg_traffic_count") == [3]
    assert values(scores.vulnerable_sed(shp, "2024-01-01"), "avg_traffic_count") == [3.5]


def test_loop_section_counts_once(spark):
    sections = spark.createDataFrame([("a", "a", 5), ("a", "b", 2)], "from_node_id string, to_node_id string, passenger_count int")
    got = joins.section_ends(sections, "passenger_count").groupBy("node_id").sum("passenger_count").collect()
    assert {r[0]: r[1] for r in got} == {"a": 7, "b": 2}


def test_night_peak_prefers_the_earlier_listed_hour(spark):
    night = spark.createDataFrame([(4, 4, 0, 0, 0), (1, 2, 2, 0, 5)], "hour_23 int, hour_0 int, hour_1 int, hour_2 int, hour_3 int")
    assert values(anomaly.night_peak_hour(night), "peak_hour") == [23, 3]


# geometry ----------------------------------------------------------------------------------


def test_haversine(spark):
    df = spark.createDataFrame([(37.5665, 126.9780, 37.4979, 127.0276), (37.5, None, 37.4, 127.0)], "a double, b double, c double, d double")
    got = values(df.select(geo.haversine_km(*[F.col(c) for c in "abcd"]).alias("km")), "km")
    assert got == [pytest.approx(8.79, abs=0.02), 0.0]


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_point_in_polygon(spark):
    shape = "adm_cd string, adm_nm string, sggnm string, polygons array<array<array<struct<lon:double,lat:double>>>>"
    areas = spark.createDataFrame(
        [("2", "with hole", "D", [[square(0.0, 0.0, 1.0, 1.0), square(0.4, 0.4, 0.6, 0.6)], [square(2.0, 0.0, 3.0, 1.0)]]), ("1", "overlap", "D", [[square(0.0, 0.0, 0.3, 0.3)]])],
        shape,
    )
    points = {"in": (0.2, 0.7), "hole": (0.5, 0.5), "edge": (0.0, 0.5), "corner": (1.0, 1.0), "far": (5.0, 5.0), "second": (2.5, 0.5), "both": (0.1, 0.1)}
    stops = spark.createDataFrame([(k, x, y, True) for k, (x, y) in points.items()], "node_id string, longitude double, latitude double, is_active boolean")
    got = {r.node_id: r.adm_cd for r in spatial.spatial_within(stops, areas, cell=0.25).collect()}
    assert got == {"in": "2", "second": "2", "both": "1"}


def test_radius_join_against_all_pairs(spark):
    rng = random.Random(5)
    pts = [(str(i), 126 + rng.random() * 0.2, 37 + rng.random() * 0.2) for i in range(120)]
    stops = spark.createDataFrame(pts, "node_id string, longitude double, latitude double")
    got = {(r.src, r.dst) for r in spatial.range_radius_join(stops, 2.0).collect()}

    def km(a, b):
        la, lb = np.radians(a[2]), np.radians(b[2])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371 * np.arcsin(np.sqrt(h))

    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] != b[0] and km(a, b) <= 2.0}


# graph -------------------------------------------------------------------------------------


def both_ways(spark, pairs):
    return spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src string, dst string")


def test_components_of_two_triangles_and_a_loner(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefz"], "node_id string")
    edges = both_ways(spark, ["ab", "bc", "ca", "de", "ef", "fd"])
    got = {r.node_id: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d", "z": "z"}


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(200)]
    hub = [("h", f"s{i:03d}") for i in range(150)]
    names = sorted({x for p in chain + hub for x in p})
    nodes = spark.createDataFrame([(n,) for n in names], "node_id string")
    got = graph.connected_components(nodes, both_ways(spark, chain + hub), rounds=20)
    assert {r.component for r in got.collect()} == {"c0000", "h"}


def test_laplacian(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcz"], "node_id string")
    edges = both_ways(spark, ["ab", "bc"])
    got = {(r.src, r.dst): r.weight for r in graph.normalized_laplacian_edges(nodes, edges).collect()}
    assert got[("a", "b")] == pytest.approx(-1 / np.sqrt(2)) and got[("z", "z")] == 1.0 and len(got) == 8


# sequences ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ramp(spark):
    """200 hours × 2 stops with value = time index; odd hours of stop b are missing rows."""
    start = dt.datetime(2024, 1, 1)
    rows = [(s, start + dt.timedelta(hours=t), float(t)) for s in "ab" for t in range(200) if s == "a" or t % 2 == 0]
    df = spark.createDataFrame(rows, "stop_id string, recorded_at timestamp_ntz, v double")
    return sequences.hour_grid(df, ["v"])


def test_dense_grid(ramp):
    rows = ramp.rows()
    assert rows.groupBy("stop_id").count().collect()[0][1] == 200
    b = {r.t_idx: r.v for r in rows.filter("stop_id = 'b'").collect()}
    assert b == {t: (float(t) if t % 2 == 0 else 0.0) for t in range(200)}


def test_blocks_carry_their_halos(spark):
    """A long, sparse history: blocks are bounded, and every window equals the one cut from the whole array."""
    start = dt.datetime(2024, 1, 1, 5)
    hours = {"a": [0, 1, 167, 168, 500, 999], "b": [3], "c": list(range(0, 1000, 7))}
    rows = [(s, start + dt.timedelta(hours=t), float(t + 1)) for s, ts in hours.items() for t in ts]
    rows += [("b", start + dt.timedelta(hours=3), 6.0)]  # averaged with 4.0
    grid = sequences.hour_grid(spark.createDataFrame(rows, "stop_id string, recorded_at timestamp_ntz, v double"), ["v"])
    whole = {s: [float(t + 1) if t in ts else 0.0 for t in range(1000)] for s, ts in hours.items()}
    whole["b"][3] = 5.0
    blocks = grid.blocks(200, 24).collect()
    assert max(len(r.v) for r in blocks) <= 200 + 200 + 24 and len(blocks) == 15
    assert all(r.v == whole[r.stop_id][r.start : r.start + len(r.v)] and r.start == max(r.lo - 200, 0) for r in blocks)
    assert {(r.stop_id, r.t_idx): r.v for r in grid.rows().collect()} == {(s, t): x for s, v in whole.items() for t, x in enumerate(v)}
    got = {(r.stop_id, r.t_idx): (r.x, r.y) for r in sequences.sliding_windows(grid, "v", 30, 5).collect()}
    assert got == {(s, t): (v[t - 30 : t], v[t : t + 5]) for s, v in whole.items() for t in range(30, 996)}
    assert sequences.sliding_windows(grid, "v", 999, 2).count() == 0
    none = sequences.hour_grid(spark.createDataFrame([], "stop_id string, recorded_at timestamp_ntz, v double"), ["v"])
    assert none.rows().count() == 0 and sequences.multi_scale_sequences(none, ["v"], "v").count() == 0


def test_multi_scale_sequences(ramp):
    rows = {r.t_idx: r for r in sequences.multi_scale_sequences(ramp, ["v"], "v").filter("stop_id = 'a'").collect()}
    assert sorted(rows) == list(range(168, 177))
    r = rows[170]
    assert r.y == [float(x) for x in range(170, 194)]
    assert r.v_hour == [float(x) for x in range(164, 170)]
    assert r.v_day == [float(x) for x in range(146, 170)]
    assert r.v_week == [float(x) for x in range(2, 26)]


def test_strided_and_periodic(ramp):
    p = {r.t_idx: r for r in sequences.periodic_samples(ramp, "v").filter("stop_id = 'a'").collect()}
    assert p[30].day_sample == [6.0] and p[30].week_sample == [] and p[180].day_sample == [156.0, 132.0, 108.0]
    s = {r.t_idx: r for r in sequences.strided_samples(ramp, "v").filter("stop_id = 'a'").collect()}
    assert s[30].day_sample is None and s[180].day_sample == [108.0, 132.0, 156.0]
    assert s[180].week_sample == [12.0 + 24 * i for i in range(7)]


def test_scores_of_stops_without_a_district(spark):
    day = dt.date(2024, 1, 6)  # a Saturday
    sph = spark.createDataFrame([(day, "r", n, 9, 2, 30, 10) for n in ("1", "2", "3")], "record_date date, route_id string, node_id string, hour int, dispatch_count bigint, ride_passenger bigint, alight_passenger bigint")
    sections = spark.createDataFrame([(day, "1", "4", 9, 500)], "record_date date, from_node_id string, to_node_id string, hour int, passenger_count bigint")
    shp = spark.createDataFrame([(dt.date(2024, 1, 1), "weekend", n, "D", 9, 30, 10, 1) for n in ("1", "2", "3")], "month_date date, day_type string, station_id string, district_name string, hour int, total_ride bigint, total_alight bigint, operating_days bigint")
    sm = spark.createDataFrame([("1",), ("2",), ("4",)], "node_id string")  # 3 is unmapped, 4 has no patterns
    for model, value, nine in ((scores.vulnerable_scores, "section_passenger_count", [500.0, 40.0, 0.0]), (scores.tourism_scores, "section_passenger_density", [0.5, 0.04, 0.0])):
        rows = model(sph, sections, shp, sm, "2024-01-01").orderBy("station_id", "hour_of_day").collect()
        assert [(r.station_id, r.hour_of_day) for r in rows] == [(n, h) for n in ("1", "2", "3") for h in range(24)]
        assert [r[value] for r in rows if r.hour_of_day == 9] == nine
    mdi = {(r.station_id, r.hour_of_day): r.mdi_t_score for r in scores.vulnerable_scores(sph, sections, shp, sm, "2024-01-01").collect()}
    assert mdi["1", 9] == pytest.approx(0.15) and mdi["2", 0] == pytest.approx(0.7) and mdi["3", 0] == 0


def test_strided_points_are_read_without_slices(ramp):
    got = sequences.strided_samples(ramp, "v")
    row = got.filter("stop_id = 'a' AND t_idx = 72").first()
    assert row.day_sample == [0.0, 24.0, 48.0] and row.week_sample is None
    assert "flatten(array(slice" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_split_of_eleven(spark):
    df = spark.createDataFrame([("a", i) for i in range(11)], "stop_id string, t_idx int")
    got = [r.split for r in sequences.temporal_split(df).orderBy("t_idx").collect()]
    assert [got.count(k) for k in ("train", "val", "test")] == [6, 2, 3]


def test_forecast_error_makes_sequences_once(spark):
    values = [float(k * k % 13) for k in range(230)]
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), v + add) for s, add in (("a", 0.0), ("b", 5.0)) for k, v in enumerate(values)]
    grid = sequences.hour_grid(spark.createDataFrame(rows, "stop_id string, recorded_at timestamp, v double"), ["v"])
    plain = sequences.forecast_error(sequences.temporal_split(sequences.multi_scale_sequences(grid, ["v"], "v")), "v_day", "y").first()
    samples = sequences.multi_scale_sequences(grid, ["v"], "v", names=("day",))
    assert samples.columns == ["stop_id", "t_idx", "hour_at", "v_day", "y"]
    split = sequences.temporal_split(samples, spans=grid.spans(first=168, ahead=23))
    thin = sequences.forecast_error(split, "v_day", "y", steps=24)
    assert thin.first() == plain and plain.mse > 0
    assert thin._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(transform") == 1


def test_merged_sequences_are_made_once(spark):
    parts, spans = [], []
    for hours, stops in ((30, "abc"), (20, "ab"), (40, "abd")):
        rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), float(k)) for s in stops for k in range(hours)]
        grid = sequences.hour_grid(spark.createDataFrame(rows, "stop_id string, recorded_at timestamp, v double"), ["v"])
        parts.append(sequences.sliding_windows(grid, "v"))
        spans.append(grid.spans(first=6))
    plain = sequences.merge_monthly_sequences(parts)
    got = sequences.merge_monthly_sequences(parts, spans)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert sorted(r.sample_idx for r in got.filter("stop_id = 'a'").collect()) == list(range(24 + 14 + 34))
    assert {r.stop_id for r in got.collect()} == {"a", "b"}
    for frame in (plain, got):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(transform") == 3


# origin–destination --------------------------------------------------------------------------

ROUTES = "array<struct<route_id:string,route_type:string,dispatch_interval:int>>"


def test_service_quality(spark):
    ten, twenty, unknown = ("1", "2", 10), ("2", "1", 20), ("3", "1", None)
    rows = [(2, [ten, twenty], [], []), (1, [ten, unknown], [], []), (0, [], [ten], [twenty]), (0, [], [], [])]
    df = spark.createDataFrame(rows, f"min_direct_connections int, common_routes {ROUTES}, from_routes {ROUTES}, to_routes {ROUTES}")
    got = od_queries.service_quality(df).collect()
    assert got[0].avg_dispatch_interval_min == pytest.approx(13.3333, abs=1e-3) and got[0].route_diversity_index == 2
    assert got[0].service_quality_score == pytest.approx(80 * 0.6 + 30 * 0.2 + 100 * 0.2)
    broken = got[1]
    assert (broken.service_quality_score, broken.avg_dispatch_interval_min, broken.route_diversity_index, broken.transfer_penalty) == (50, 30, 1, 0)
    assert got[2].avg_dispatch_interval_min == 40 and got[2].transfer_penalty == 1
    assert got[3].avg_dispatch_interval_min == 70


# text ----------------------------------------------------------------------------------------

GOLDEN_TYPES = [
    ("호출버스 개념 알려줘", "definition"),
    ("마을에 어떤 혜택이 오나", "benefits"),
    ("전반적 흐름을 말해줘", "comprehensive"),
    ("정류장 뜻", "definition"),
    ("plain greeting", "general"),
]
GOLDEN_VARIANTS = [
    ("새 DRT 정의", {"새 DRT 정의", "새 DRT 개념", "새 수요응답형교통 정의"}),
    ("농촌 DRT 장점", {"농촌 DRT 장점", "농촌 DRT 이점", "농촌 수요응답형교통 장점"}),
    ("심야 예약 방법", {"심야 예약 방법", "심야 예약 방식"}),
    ("DRT 요금", {"DRT 요금", "수요응답형교통 요금", "demand responsive transport 요금"}),
]


def test_question_types(spark):
    df = spark.createDataFrame(GOLDEN_TYPES, "q string, expected string").withColumn("got", text_rules.question_answer_type(F.col("q")))
    assert df.filter("got <> expected").count() == 0


def test_query_expansion(spark):
    df = spark.createDataFrame([(q,) for q, _ in GOLDEN_VARIANTS], "q string").select("q", text_rules.expand_queries(F.col("q")).alias("v"))
    assert {r.q: set(r.v) for r in df.collect()} == dict(GOLDEN_VARIANTS)


def guarded(spark, sql, limit=7):
    found = sql_rules.guarded_sql(spark, sql, limit)
    summary = found.summary.first()
    assert found.rows.count() == summary.row_count
    return summary.row_count, summary.truncated


GUARDED = [
    ("SELECT * FROM numbers;", (7, True)),
    ("SELECT * FROM numbers LIMIT 9", (9, False)),
    ("select * from numbers order by id limit 9 offset 25", (5, False)),
    ("SELECT * FROM numbers WHERE id < 7", (7, False)),
    ("SELECT * FROM (SELECT * FROM numbers LIMIT 20)", (7, True)),
    ("SELECT *, 'LIMIT 5' AS note FROM numbers", (7, True)),
    ("WITH x AS (SELECT * FROM numbers LIMIT 20) SELECT * FROM x", (7, True)),
    ("WITH x AS (SELECT * FROM numbers) SELECT * FROM x ORDER BY id LIMIT 12", (12, False)),
    ("(SELECT * FROM numbers LIMIT 8) UNION ALL SELECT * FROM numbers", (7, True)),
    ("SELECT 'a\n+- GlobalLimit 5' AS x, id FROM numbers", (7, True)),
    ("SELECT * FROM numbers WHERE id < 0", (0, False)),
]


@pytest.mark.parametrize("sql, expected", GUARDED)
def test_guarded_sql(spark, sql, expected):
    spark.range(30).createOrReplaceTempView("numbers")
    assert guarded(spark, sql) == expected


@pytest.mark.parametrize("sql", ["DROP TABLE numbers", "  ", "select pg_sleep(1)", "select reflect('java.lang.System', 'exit', 1)", "SET spark.sql.ansi.enabled = false"])
def test_guarded_sql_refuses(spark, sql):
    with pytest.raises(ValueError):
        sql_rules.guarded_sql(spark, sql)


def test_guarded_sql_without_a_limit(spark):
    spark.range(30).createOrReplaceTempView("numbers")
    assert guarded(spark, "SELECT * FROM numbers", None) == (30, False)


def test_request_checks():
    cal.check_request("2024-01-01", "2024-02-01", "weekday", "A", ["A"])
    for args in (("2024-02-01", "2024-01-01"), ("2023-01-01", "2024-06-01"), ("2024-01-01", "2024-01-02", "holiday"), ("2024-01-01", "2024-01-02", "all", "B", ["A"])):
        with pytest.raises(ValueError):
            cal.check_request(*args)


# documents -------------------------------------------------------------------------------------


def document(seed, n):
    rng = random.Random(seed)
    marks = ["1. ", "1.1 ", "(3) ", "- ", "제 2장 ", "", "", "", "", "", "", ""]
    return "\n".join(rng.choice(marks) + " ".join("단어" if rng.random() < 0.1 else "w" * rng.randint(2, 9) for _ in range(rng.randint(0, 60))) for _ in range(n))


DOCS = [(i, document(i, n)) for i, n in enumerate((1, 3, 10, 40, 80))] + [
    (90, "1. Head\n" + "long words. " * 300),
    (91, "   \n \n"),
    (92, "tail " * 8),
    (93, "1. A\nshort\n2. B\nshort too\n" + "x" * 2500),
]


def chunks_by_hand(text):
    """The chunking rules written out step by step."""
    heads = [re.compile(p) for p in chunks.TITLES + chunks.SECTIONS]
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    is_head = [any(h.match(x) for h in heads) for x in lines]
    starts = []
    size = 0
    for i, line in enumerate(lines):
        if not starts or is_head[i] or size + len(line) > 1200:
            size = len(line) + (0 if starts else 1)
            starts.append(i)
        else:
            size += len(line) + 1
    out = []
    for start, end in zip(starts, starts[1:] + [len(lines)]):
        last_head = next((lines[i] for i in range(end - 1, -1, -1) if is_head[i]), None)
        out.append((last_head, "\n".join(lines[start:end])))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_structure_chunks(docs):
    got = {}
    for r in chunks.structure_chunks(docs).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append((r.section_title, r.content))
    assert got == {i: c for i, t in DOCS if (c := chunks_by_hand(t))}


def test_merge_keeps_all_text_and_sizes(docs):
    rows = chunks.merge_small_chunks(docs).orderBy("doc_id", "chunk_idx").collect()
    for i, text in DOCS:
        mine = [r for r in rows if r.doc_id == i]
        whole = [c for _, c in chunks_by_hand(text)]
        assert "\n\n".join(r.text for r in mine).replace("\n\n", "\n") == "\n".join(whole).replace("\n\n", "\n")
        for before, after in zip(mine, mine[1:]):
            assert after.char_count >= 300 or before.char_count + after.char_count > 2000


def test_split_bounds_and_metadata(docs):
    rows = chunks.split_large_chunks(docs).collect()
    assert all(r.char_count == len(r.text) and r.word_count == len(r.text.split()) for r in rows)
    assert all(r.char_count <= 2000 for r in rows if r.doc_id != 93)
    head, *parts = sorted((r for r in rows if r.doc_id == 90), key=lambda r: r.chunk_idx)
    assert (head.text, head.chunk_type) == ("1. Head", "title")
    assert len(parts) > 2 and {r.chunk_type for r in parts} == {"paragraph"} and all(r.char_count <= 1200 for r in parts)
    assert {r.section_title for r in parts} == {"1. Head"} and [r.sub_chunk_index for r in parts] == list(range(len(parts)))


def importance_by_hand(line):
    base = 1.0 if any(re.match(p, line) for p in chunks.TITLES) else 0.8 if any(re.match(p, line) for p in chunks.SECTIONS) else 0.3
    base += 0.2 if any(k in line for k in chunks.KEYWORDS) else 0
    base += 0.1 if re.search("[가-힣]", line) else 0
    return min(base, 1.0)


def test_chunk_metadata(docs):
    for r in chunks.with_metadata(chunks.structure_chunks(docs)).collect():
        lines = [x.strip() for x in r.content.split("\n")]
        assert r.importance_score == pytest.approx(sum(map(importance_by_hand, lines)) / len(lines))
        levels = [next((n for p, n in chunks.LEVELS if re.match(p, x)), 4) for x in lines]
        assert r.structure_level == min(levels)
        assert r.has_korean == bool(re.search("[가-힣]", r.content))
        assert (r.word_count, r.char_count) == (len(r.content.split()), len(r.content))


@pytest.mark.parametrize("size,overlap", [(50, 10), (200, 40), (1500, 300)])
def test_recursive_split(size, overlap):
    text = " ".join(f"word{i}" for i in range(400))
    parts = chunks.recursive_split(text, size, overlap, chunks.PLAIN_SEPARATORS)
    assert all(0 < len(p) <= size for p in parts)
    seen = [w for p in parts for w in p.split()]
    assert list(dict.fromkeys(seen)) == text.split()


def test_recursive_split_keeps_separators_in_front():
    assert chunks.recursive_split("aaaa. bbbb. cccc", 7, 0, chunks.PLAIN_SEPARATORS) == ["aaaa", ". bbbb", ". cccc"]


def test_recursive_split_of_one_long_word():
    parts = chunks.recursive_split("x" * 103, 20, 5, chunks.PLAIN_SEPARATORS)
    assert all(len(p) <= 20 for p in parts) and len(parts[0]) == 20
    assert sum(map(len, parts)) >= 103


# retrieval ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    """Documents around a few centres, one centre holding a third of them, and ten times the usual queries."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 3
    docs = centres[np.where(rng.random(900) < 0.33, 0, rng.integers(0, 12, 900))] + rng.normal(size=(900, 8)) * 0.5
    asked = centres[rng.integers(0, 12, 250)] + rng.normal(size=(250, 8))
    docs[7] = docs[3]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "doc_id long, vector array<float>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vector array<float>")
    unit = lambda m: m.astype("float32").astype("float64") / np.linalg.norm(m.astype("float32").astype("float64"), axis=1, keepdims=True)
    return d, q, unit(asked) @ unit(docs).T


@pytest.mark.parametrize("threshold, pieces", [(0.9, {}), (0.5, {"block": 20, "rows": 70, "cells": 16}), (-1.0, {"block": 100, "rows": 300, "cells": 3})])
def test_vector_search_is_exact(vectors, threshold, pieces):
    d, q, sims = vectors
    expected = {
        (i, int(j), n + 1) for i in range(len(sims)) for n, j in enumerate([j for j in np.lexsort((np.arange(900), -sims[i])) if sims[i, j] >= threshold][:4])
    }
    got = retrieval.similar_top_k(d, q, 4, threshold, **pieces)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got.collect()} == expected


def test_vector_search_skips_far_cells(spark, vectors):
    d, q, _ = vectors
    pivots = retrieval._pivots(d, 16)
    cells = [retrieval._cells(retrieval._in_cells(x, pivots)).withColumns({"parts": F.lit(1), "before": F.lit(0)}) for x in (d, q)]
    every, near = (retrieval._near_cells(*cells, pivots, t).count() for t in (-1.0, 0.95))
    assert every == cells[0].count() * cells[1].count() and near < every * 0.7


def test_vector_search_runs_no_job_while_planned(spark, vectors):
    d, q, _ = vectors
    spark.sparkContext.setJobGroup("planning", "vector search")
    retrieval.similar_top_k(d, q)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


def test_vector_search_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    got = retrieval.similar_top_k(d, d.withColumnRenamed("doc_id", "query_id"), 1, 0.5)
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == [(1, 1), (7, 1)]
    for docs, asked in ((d.limit(0), d), (d, d.limit(0)), (d.filter("doc_id = 2"), d)):
        assert retrieval.similar_top_k(docs, asked.withColumnRenamed("doc_id", "query_id")).count() == 0


# tables -----------------------------------------------------------------------------------------


def test_upsert_last_load_wins_and_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, v int, day int, load_seq int"
    tables.upsert(spark, path, spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 1, 1), ("c", 3, 2, 1)], schema), ["k", "day"], "day")
    out = tables.upsert(spark, path, spark.createDataFrame([("a", 9, 1, 3), ("a", 8, 1, 2), ("d", 4, 3, 2)], schema), ["k", "day"], "day")
    assert sorted((r.k, r.v, r.day) for r in out.collect()) == [("a", 9, 1), ("b", 2, 1), ("c", 3, 2), ("d", 4, 3)]


LOADS = "k string, v int, day int, load_seq int"


def table_rows(df):
    return sorted((r.k, r.v, r.day) for r in df.collect())


@pytest.mark.parametrize("stop_at", ["last_per_key", "_commit"])
def test_upsert_that_dies_leaves_the_table(spark, tmp_path, monkeypatch, stop_at):
    path = str(tmp_path / "t")
    first = tables.upsert(spark, path, spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 2, 1)], LOADS), ["k"], "day")
    new = spark.createDataFrame([("a", 9, 1, 2), ("c", 3, 3, 2)], LOADS)

    def die(*_):
        raise RuntimeError("executor and driver are gone")

    with monkeypatch.context() as broken:
        broken.setattr(tables, stop_at, die)
        with pytest.raises(RuntimeError):
            tables.upsert(spark, path, new, ["k"], "day")
    assert table_rows(tables.read_table(spark, path)) == [("a", 1, 1), ("b", 2, 2)]
    tables.upsert(spark, path, new, ["k"], "day")
    assert table_rows(tables.read_table(spark, path)) == [("a", 9, 1), ("b", 2, 2), ("c", 3, 3)]
    assert table_rows(first) == [("a", 1, 1), ("b", 2, 2)], "a frame keeps reading the load that it opened"
    assert tables.vacuum(spark, path) >= 1 and tables.vacuum(spark, path) == 0
    assert table_rows(tables.read_table(spark, path)) == [("a", 9, 1), ("b", 2, 2), ("c", 3, 3)]


def test_upsert_evaluates_its_batch_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    new = spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 2, 1), (None, 3, None, 1)], LOADS).mapInPandas(note, LOADS)
    for _ in range(2):
        out = tables.upsert(spark, str(tmp_path / "t"), new, ["k"], "day")
    assert seen.value == 6 and out.count() == 3
    empty = tables.upsert(spark, str(tmp_path / "none"), new.limit(0), ["k"], "day")
    assert empty.count() == 0 and empty.columns == ["k", "v", "day", "load_seq"]


def test_fresh_upsert_writes_its_batch_and_keeps_what_it_lacks(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, n int, v int, day int, load_seq int"
    tables.upsert(spark, path, spark.createDataFrame([("a", 1, 1, 1, 1), (None, 2, 2, 1, 1), (None, None, 3, 1, 1), ("d", 4, 4, 2, 1)], schema), ["k", "n", "day"], "day", fresh=True)
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    new = spark.createDataFrame([(None, 2, 9, 1, 2), ("e", None, 5, 1, 2)], schema).mapInPandas(note, schema)
    out = tables.upsert(spark, path, new, ["k", "n", "day"], "day", fresh=True)
    assert sorted((str(r.k), str(r.n), r.v) for r in out.collect()) == [("None", "2", 9), ("None", "None", 3), ("a", "1", 1), ("d", "4", 4), ("e", "None", 5)]
    assert seen.value == 2
    with pytest.raises(ValueError, match="fresh"):
        tables.upsert(spark, path, spark.createDataFrame([("a", 1, 7, 1, 1)], schema), ["k", "n", "day"], "day", fresh=True)
    assert out.count() == 5 and tables.read_table(spark, path).count() == 5 and tables.vacuum(spark, path) >= 1
    old, rows = (spark.range(9).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")) for _ in range(2))
    assert "Broadcast" not in tables._lacking(old, rows, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_first_and_last_rows_shrink_before_the_shuffle_without_sorted_aggregates(spark):
    from headway.operators.joins import first_per_key, last_per_key

    rows = spark.createDataFrame([("a", "x", 2), ("a", "y", 3), ("a", "z", None), (None, "n", 1), (None, "m", 0)], "k string, v string, s int")
    assert sorted((str(r.k), r.v) for r in first_per_key(rows, ["k"], "s").collect()) == [("None", "m"), ("a", "x")]
    assert sorted((str(r.k), r.v) for r in last_per_key(rows, ["k"], "s").collect()) == [("None", "n"), ("a", "y")]
    text = last_per_key(rows, ["k"], "s")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and text.count("WindowGroupLimit") == 2  # once before the exchange


def test_stream_ingest_takes_two_spellings_of_a_date_as_one_key(spark, tmp_path):
    from headway.schemas import STATION_FEED
    from headway.streaming import feeds

    pages = [{"record_date": d, "routeId": "r", "staId": "a", "ridePnsgerCnt00h": n} for d, n in (("2024-01-01", "1"), ("2024-1-1", "2"), ("nonsense", "3"))]
    spark.createDataFrame([tuple(p.get(f) for f in STATION_FEED.fieldNames()) for p in pages], STATION_FEED).coalesce(1).write.json(str(tmp_path / "in/1"))
    out = str(tmp_path / "out")
    feeds.stream_ingest_station(spark, str(tmp_path / "in"), out, str(tmp_path / "state"))
    got = tables.read_table(spark, out).groupBy("record_date").agg(F.count("*").alias("n"), F.sum("ride_passenger").alias("s")).collect()
    assert sorted((str(r.record_date), r.n, r.s) for r in got) == [("2024-01-01", 24, 1), ("None", 24, 3)]


def test_hours_are_cast_after_the_explode(spark):
    from headway.operators import reshape
    from headway.schemas import STATION_FEED

    wide = spark.range(1).select(*[F.lit("7" if f.startswith("a05") else None).cast("string").alias(f) for f in STATION_FEED.fieldNames()])
    wide = wide.union(wide)
    tall = reshape.station_wide_to_tall(wide)
    assert tall.count() == 48 and tall.agg(F.sum("dispatch_count"), F.sum("ride_passenger")).first() == (336, 0)
    text = tall._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("try_cast") + text.count("cast(") < 24


def test_step_log_counts_a_repeated_step_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [
        ("j", "r1", 1, "RUNNING", at, 5, 0, ""), ("j", "r1", 2, "SUCCESS", at + dt.timedelta(minutes=2), 0, 5, ""),
        ("j", "r2", 1, "RUNNING", at + dt.timedelta(hours=1), 7, 0, ""), ("j", "r2", 1, "RUNNING", at + dt.timedelta(hours=2), 7, 0, "again"),
    ]
    for row in rows:
        tables.log_steps(str(tmp_path / "log"), spark.createDataFrame([row], tables.STEPS))
    steps = tables.job_steps(spark, str(tmp_path / "log"))
    assert steps.count() == 3
    last = tables.latest_job_status(steps).first()
    assert (last.run, last.step, last.status, last.steps, last.rows_read, last.message) == ("r2", 1, "RUNNING", 1, 7, "again")


# streams ---------------------------------------------------------------------------------------


EVENT = "id long, at timestamp, n long"


def landing(spark, tmp_path):
    def land(name, rows):
        frame = spark.createDataFrame([(i, dt.datetime(2024, 1, day, hour), n) for i, day, hour, n in rows], EVENT)
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    return land


def state_rows(spark, checkpoint):
    return spark.read.format("statestore").load(str(checkpoint)).count()


def test_stream_state_expires_and_late_rows_are_dropped(spark, tmp_path):
    from headway.streaming import feeds

    land = landing(spark, tmp_path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        events = feeds.landed(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENT).schema)
        return feeds.append_rows(feeds.stream_dedupe(events, ["id"], "at", "2 days"), out, state)

    land("1", [(1, 1, 0, 1), (1, 1, 0, 2), (2, 9, 0, 1), (3, 10, 0, 1)])
    assert sorted(r.id for r in run().collect()) == [1, 2, 3]
    assert state_rows(spark, state) == 2, "row 1 is older than the bound"
    land("2", [(2, 9, 5, 2), (4, 9, 5, 1), (5, 7, 0, 1), (6, 20, 0, 1)])
    assert sorted(r.id for r in run().collect()) == [1, 2, 3, 4, 6], "5 is late, 2 is known"
    assert state_rows(spark, state) == 1


def test_stream_windows_are_stored_once(spark, tmp_path):
    from headway.streaming import feeds

    land = landing(spark, tmp_path)
    table, state = str(tmp_path / "table"), str(tmp_path / "state")

    def run():
        events = feeds.landed(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENT).schema)
        rows = events.select("at", F.col("id").cast("string").alias("node_id"), F.col("n").alias("ride_passenger"), F.lit(0).alias("alight_passenger"))
        return feeds.upsert_windows(feeds.stream_hourly_traffic(rows, "at", "2 days"), "hour_at", ["hour_at", "node_id"], table, state)

    land("1", [(1, 1, 0, 1), (1, 9, 0, 2), (1, 10, 0, 3)])
    run()
    land("2", [(1, 9, 0, 5), (1, 1, 0, 7), (1, 20, 0, 1)])
    got = [(r.hour_at.day, r.ride_passenger, r.records) for r in run().orderBy("hour_at").collect()]
    assert got == [(1, 1, 1), (9, 7, 2), (10, 3, 1), (20, 1, 1)]
    assert state_rows(spark, state) == 1


def test_expired_days_are_deleted(spark, tmp_path):
    from headway.streaming import feeds

    land = landing(spark, tmp_path)
    table, state = tmp_path / "cache", str(tmp_path / "state")

    def run(day):
        events = feeds.landed(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENT).schema)
        return {r.id: r.n for r in feeds.stream_ttl_cache(events, ["id"], "at", str(table), state, dt.datetime(2024, 1, day, 12), "48 HOURS").collect()}

    land("1", [(1, 1, 0, 1), (1, 2, 0, 2), (2, 2, 13, 3), (3, 3, 0, 4), (4, 4, 0, 5)])
    assert run(4) == {2: 3, 3: 4, 4: 5}
    land("2", [(3, 5, 1, 9), (5, 1, 0, 1)])
    assert run(6) == {3: 9}
    assert sorted(f.name for f in table.iterdir() if f.is_dir()) == ["day=2024-01-04", "day=2024-01-05"]
    assert run(30) == {} and not [f for f in table.iterdir() if f.is_dir()]


def test_first_row_of_a_hot_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (-F.col("id")).alias("seq"))
    kept = reshape.dedupe_keep_first(df, ["k"], "seq")
    assert kept.count() == df.select("k").distinct().count()
    assert kept.filter("k = 'hot'").first().seq == -19998


def test_section_nulls_stay_null(spark):
    wide = {f"a18SumLoadPsngNum{h:02d}h": "3" for h in range(24)} | {"a18SumLoadPsngNum05h": "x", "a18SumLoadPsngNum06h": None}
    row = {"record_date": "2024-01-01", "routeId": "r", "fromStaId": "a", "toStaId": "b", "staSn": "1", "a18SumLoadPsng": ""} | wide
    schema = ", ".join(f"{c} string" for c in row)
    tall = reshape.section_wide_to_tall(spark.createDataFrame([tuple(row.values())], schema))
    got = {r.hour: r.passenger_count for r in tall.collect()}
    assert got[5] is None and got[6] is None and got[7] == 3 and len(got) == 24


def test_stream_ingest_keeps_first_in_batch_and_last_between_batches(spark, tmp_path):
    from headway.schemas import STATION_FEED
    from headway.streaming import feeds

    def page(name, rows):
        full = [{"record_date": "2024-01-01", "routeId": "r", "staSn": "1"} | {f"ridePnsgerCnt{h:02d}h": str(n) for h in range(24)} | {"staId": s} for s, n in rows]
        spark.createDataFrame([tuple(r.get(f, None) for f in STATION_FEED.fieldNames()) for r in full], STATION_FEED).coalesce(1).write.json(str(tmp_path / "in" / name))

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    page("1", [("a", 1), ("a", 2), ("b", 3)])
    feeds.stream_ingest_station(spark, str(tmp_path / "in"), out, state)
    page("2", [("a", 5)])
    feeds.stream_ingest_station(spark, str(tmp_path / "in"), out, state)
    got = {r.node_id: (r.n, r.s) for r in tables.read_table(spark, out).groupBy("node_id").agg(F.count("*").alias("n"), F.sum("ride_passenger").alias("s")).collect()}
    assert got == {"a": (24, 120), "b": (24, 72)}


def test_nested_heat_map_pages_keep_every_station(spark):
    from headway.operators import traffic

    stations = spark.range(2500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") % 7).cast("string"))).alias("district_name"),
        F.col("id").cast("string").alias("station_id"), F.lit("n").alias("station_name"), F.lit(37.5).alias("latitude"),
        F.lit(127.0).alias("longitude"), (F.col("id") * 7 % 1000).alias("total_traffic"),
    )
    rows = traffic.heatmap_nested(stations.select("district_name").distinct(), stations, page=100).collect()
    assert sum(len(r.stations) for r in rows) == 2500 and max(len(r.stations) for r in rows) <= 100
    hot = [s.total_traffic for r in sorted((r for r in rows if r.district_name == "hot"), key=lambda r: r.page_no) for s in r.stations]
    assert hot == sorted(hot, reverse=True) and len(hot) == 834


def test_nested_heat_map_query_joins_the_pages_of_a_district(spark):
    from headway.operators import traffic
    from headway.plans.traffic import whole_districts

    stations = spark.range(2500).select(
        F.when(F.col("id") % 9 == 0, "cold").otherwise("hot").alias("district_name"), F.col("id").cast("string").alias("station_id"), F.lit("n").alias("station_name"),
        F.lit(37.5).alias("latitude"), F.lit(127.0).alias("longitude"), (F.col("id") * 7 % 1000).alias("total_traffic"),
    )
    districts = spark.createDataFrame([("hot", 5), ("cold", 3), ("none", 1)], "district_name string, total_traffic int")
    got = {r.district_name: (r.station_count, r.station_list) for r in whole_districts(traffic.heatmap_nested(districts, stations)).collect()}
    order = sorted(((-(i * 7 % 1000), str(i)) for i in range(2500)))
    cold = [s for _, s in order if int(s) % 9 == 0]
    hot = [s for _, s in order if int(s) % 9 != 0]
    assert got == {"hot": (len(hot), ",".join(hot)), "cold": (len(cold), ",".join(cold)), "none": (0, None)} and len(hot) > 2000


def test_od_date_comes_from_the_last_folder_or_file_name(spark, tmp_path):
    from headway.schemas import OD_CSV_COLUMNS
    from headway.sources.files import read_od_csv

    line = ",".join(OD_CSV_COLUMNS) + "\n" + ",".join(["a", "b", "3", *["1"] * 24]) + "\n"
    for parent, rest in (("28501454", "file_date=20250715/part-00000-28501454-aaaa.csv"), ("20230101", "OD_20250715.csv")):
        target = tmp_path / parent / rest
        target.parent.mkdir(parents=True)
        target.write_text(line)
        assert [str(r.record_date) for r in read_od_csv(spark, str(tmp_path / parent)).collect()] == ["2025-07-15"]


def test_keyword_candidates_are_all_pairs(spark):
    """Against every pair, at several shares, with frequent words, empty texts and equal sets."""
    rng = np.random.default_rng(8)
    word = lambda: f"w{min(int(rng.zipf(1.4)), 400)}"
    text = lambda n: " ".join(word() for _ in range(n))
    asked = [(i, text(int(rng.integers(1, 15)))) for i in range(60)] + [(60, ""), (61, None), (62, "W1  w2\tw2")]
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(150)] + [(150, " "), (151, None), (152, "w2 w1"), (153, asked[3][1])]
    sets = lambda rows: {i: set((t or "").lower().split()) for i, t in rows}
    q, d = sets(asked), sets(docs)
    frames = spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(docs, "doc_id int, text string")
    for percent in (5, 10, 33, 50, 100):
        got = [tuple(r) for r in retrieval.keyword_candidates(*frames, percent).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in q for b in d if q[a] & d[b] and 100 * len(q[a] & d[b]) >= percent * len(q[a] | d[b])}


def test_keyword_overlaps_count_words_in_pieces_and_blocks(spark):
    """Small pieces and blocks give the counts of brute force; pairs below the share never meet in a join."""
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{min(int(rng.zipf(1.5)), 90)}" for _ in range(n))
    asked = [(i, text(int(rng.integers(1, 12)))) for i in range(50)] + [(50, None), (51, asked_twice := "w1 w3"), (52, asked_twice)]
    docs = [(i, text(int(rng.integers(1, 40))), i / 8) for i in range(120)] + [(120, None, 0.0), (121, "w3 w1", 0.5)]
    q, d = ({r[0]: set((r[1] or "").split()) for r in rows} for rows in (asked, docs))
    frames = spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(docs, "doc_id int, text string, boost double")
    found = retrieval.keyword_overlaps(*frames, 15, rows=30, block=20)
    want = {(a, b, len(q[a] & d[b]), len(q[a]), len(d[b]), docs[b][2]) for a in q for b in d if q[a] & d[b] and 100 * len(q[a] & d[b]) >= 15 * len(q[a] | d[b])}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("percent", [0, 10, 40, 100])
def test_frequent_words_are_not_counted_for_each_document(percent, monkeypatch):
    """Brute force over one piece, with long questions, words that no document holds, null ids and any order of sizes."""
    import pyarrow as pa

    for name, value in (("LEAST", 2), ("FREQUENT", 9), ("STEP", 4), ("ASKED_ROWS", 40), ("LOOKUPS", 50), ("BATCH", 20)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(percent)
    some = lambda n: list(dict.fromkeys(f"w{min(int(rng.zipf(1.3)), 500)}" for _ in range(n)))
    docs = [some(int(rng.integers(1, 120))) for _ in range(200)]
    asked = [some(int(rng.integers(1, 30))) for _ in range(90)] + [["no", "such"], ["w1"], docs[3], [f"w{i}" for i in range(1, 400)]]

    def rows(asks, sets):
        ids = pa.array([None, *range(1, len(sets))], pa.int64())
        floats = [pa.array([i / 8 for i in range(len(sets))], pa.float64())] * 2
        columns = [pa.array([asks] * len(sets)), ids, *floats, pa.array(list(map(len, sets)), pa.int32()), pa.array([" ".join(x) for x in sets])]
        return pa.RecordBatch.from_arrays(columns, ["asks", "id", "boost", "bonus", "n", "words"])

    touched, join = [], np.concatenate
    monkeypatch.setattr(retrieval.np, "concatenate", lambda x, *a: (touched.append(sum(map(len, x))) if len(x) and getattr(x[0], "dtype", None) == "int32" else None, join(x, *a))[1])
    given = pa.Table.from_batches([rows(False, docs), rows(True, asked)]).to_batches(max_chunksize=64)
    found = [tuple(r.values()) for b in retrieval._overlaps(iter(given), percent, None) for r in b.to_pylist()]
    want = [
        (i or None, j or None, len(both), len(a), len(d), j / 8)
        for i, a in enumerate(asked) for j, d in enumerate(docs)
        if (both := set(a) & set(d)) and 100 * len(both) >= percent * len(set(a) | set(d))
    ]
    order = lambda x: [(v is not None, v or 0) for v in x]
    assert sorted(found, key=order) == sorted(want, key=order) and len(want) >= 1
    if percent >= 40:
        assert sum(touched) < sum(len(set(a) & set(d)) for a in asked for d in docs)
    with pytest.raises(ValueError, match="document follows"):
        list(retrieval._overlaps(iter([rows(True, asked), rows(False, docs)]), percent, None))


def test_only_pairs_that_may_be_the_best_are_ranked(spark):
    """Ties, scores above 1 and documents that come twice; what is left out never changes the ranks."""
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"w{min(int(rng.zipf(1.4)), 60)}" for _ in range(n))
    asked = [(i, text(int(rng.integers(1, 12)))) for i in range(40)] + [(40, "w1"), (40, "w2 w1"), (41, None)]
    texts = [(i, text(int(rng.integers(1, 30)))) for i in range(150)]
    texts += [(i, "w1 w2") for i in range(150, 180)] + texts[:20]
    docs = [(i, x, i % 3 / 2, i % 10 / 10, ["title", "list", None][i % 3], i % 5, f"{2022 + i % 4}-03-01") for i, x in texts]
    docs = spark.createDataFrame(docs, "doc_id long, text string, boost double, importance_score double, chunk_type string, structure_level int, loaded_at string")
    questions = spark.createDataFrame(asked, "query_id long, query string")
    shown = docs.drop("text", "boost").distinct()
    bonus = retrieval.rank_bonus(*map(F.col, ("importance_score", "chunk_type", "structure_level", "loaded_at")))

    def ranked(best):
        pairs = retrieval.keyword_overlaps(questions, docs.withColumn("bonus", bonus), 10, rows=40, block=20, best=best).join(shown, "doc_id")
        semantic = retrieval.overlap_score(F.col("common"), F.col("asked"), F.col("held"), F.col("boost"))
        out = retrieval.rerank(pairs.withColumn("semantic_score", semantic), 3)
        return pairs.count(), sorted((r.query_id, r["rank"], r.doc_id, r.rerank_score, r.reason) for r in out.collect())

    (every, want), (some, got) = ranked(None), ranked(3)
    assert got == want and some < every / 2


def test_landed_texts_are_one_file_a_document_in_small_folders(spark, tmp_path, monkeypatch):
    import pathlib

    from headway.plans import ingest
    from headway.sources.files import read_text_docs
    from headway.sources.mapping import TransitTables

    texts = ["a\nb", "", None, "한글 x", "a\nb", " ", "\n", "end\n"]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(ingest, "FOLDER_FILES", 4)
    path = ingest.text_files(TransitTables(spark, str(tmp_path)))
    assert sorted(r.text for r in read_text_docs(spark, path).collect()) == sorted(x + "\n" for x in texts if x)
    folders = [f for f in pathlib.Path(path.removeprefix("file://")).iterdir() if f.is_dir()]
    assert sorted(len(list(f.glob("*.txt"))) for f in folders) == [2, 4]


def test_small_texts_share_tasks(spark, tmp_path):
    """The rows of Spark's reader, whatever the names, without a task for every few files."""
    from headway.sources import files

    for folder in ("a", "a/deep er/x%20y", "b=1", "_hidden", ".hidden", "_k=2", "한글", *(f"many/{i}" for i in range(40))):
        (tmp_path / folder).mkdir(parents=True)
        for name in ("one.txt", "two #?.md", "three.TXT", "four.csv", "_five.txt", ".six.md", "seven.tar.txt", "8.txt._COPYING_"):
            (tmp_path / folder / name).write_text(f"{folder} {name} 글")
    (tmp_path / "a" / "empty.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").load(str(tmp_path))
        want = sorted((r.path, bytes(r.content).decode()) for r in raw.collect())
        for found in (files.read_text_docs(spark, str(tmp_path)), files.read_text_docs(spark, f"file://{tmp_path}/")):
            assert sorted((r.path, r.text) for r in found.collect()) == want and len(want) == 135
            assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < raw.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = tmp_path / "a" / "one.txt"
    assert [r.text for r in files.read_text_docs(spark, str(one)).collect()] == [one.read_text()]
    assert files.read_text_docs(spark, f"{tmp_path}/many/{{1,2}}").count() == 6
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_text_docs(spark, f"{tmp_path}/none")


def test_hours_of_a_section_are_merged_before_they_move(spark):
    from headway.plans.ingest import SECTION, by_hour

    tall = spark.range(240).selectExpr("'2024-01-01' AS record_date", "'r' AS route_id", "string(id % 10) AS from_node_id", "'t' AS to_node_id", "int(id / 10) AS hour", "id AS trip_time")
    got = by_hour(tall)
    assert {r.from_node_id: r.trip_times for r in got.collect()} == {str(k): ",".join(f"{h}={h * 10 + k}" for h in range(24)) for k in range(10)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == [*SECTION, "trip_times"] and "HashAggregate" in plan and "ObjectHash" not in plan and "SortAggregate" not in plan


def test_only_long_chunks_are_split_in_python(spark):
    rows = [(1, ["a b", "c d " * 700, "e"]), (2, ["f"]), (3, [])]
    df = spark.createDataFrame(rows, "id int, c array<string>").select("id", chunks._split(F.col("c"), 2000).alias("p"))
    got = {r.id: r.p for r in df.collect()}
    assert got == {1: [None, chunks.recursive_split("c d " * 700, chunks.SIZE, chunks.OVERLAP, chunks.SEPARATORS), None], 2: [None], 3: []}
