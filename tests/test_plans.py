"""Plan shapes: no cross joins, pruned scans, filters at the scan."""

import pytest
from small_tables import SF

import __spark_entry__ as entry

SHAPES = """
weekend_dominant commuter_scores tourism_scores vulnerable_scores monthly_od_summary range_radius_join spatial_within
band_self_join multi_scale_sequences or_join_sections district_averages heatmap_statistics hourly_traffic rerank
data_range_flag scalar_cross_join grid_cross_join
""".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SHAPES)
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_scan_reads_needed_columns(spark):
    text = plan(entry.queries()["daily_traffic_summary"](spark, SF))
    assert "props" not in text


def test_month_filter_is_a_range_on_the_date(spark, tmp_path):
    from pyspark.sql import functions as F

    from headway.functions.calendar import month_filter

    path = str(tmp_path / "facts")
    days = spark.range(90).select(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("record_date"), "id")
    days.write.partitionBy("record_date").parquet(path)
    df = spark.read.parquet(path).filter(month_filter(F.col("record_date"), "2024-02-01"))
    assert "PartitionFilters: [isnotnull(record_date" in plan(df)
    assert df.count() == 29


def test_top_per_group_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["city_top_drt"](spark, SF))


MONTHLY = """
weekend_dominant weekend_peak_hours night_demand rush_hour_morning rush_hour_top lunch_time area_residential underutilized
anomaly_integration rush_summary area_summary heatmap_districts heatmap_stations heatmap_nested heatmap_statistics
district_detail kpi_overview kpi_concentration kpi_inequality top_stations efficiency_grade quartiles_exclusive
commuter_pdr commuter_ru commuter_scores tourism_tdr tourism_scores vulnerable_sed vulnerable_mdi vulnerable_scores
district_drt_scores drt_model_statistics compare_drt_models city_top_drt drt_score_filter drt_area_mean drt_suitability_class
od_p1_transfers od_p2_high_demand od_p3_low_efficiency od_time_origins od_mismatch
""".split()


#: These compare with section loads or dispatches, which no view holds: they read that month of the facts too.
WITH_FACTS = {"commuter_ru", "vulnerable_mdi"}


@pytest.mark.parametrize("name", MONTHLY)
def test_a_question_about_one_month_reads_one_stored_month(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # shows all pushed filters
    scans = [line for line in plan(entry.queries()[name](spark, SF)).split("\n") if "FileScan" in line]
    stored = [line for line in scans if ".months_" in line]
    assert stored or name == "quartiles_exclusive"  # counted while planned: a row of three numbers is left
    for line in stored:
        assert "month" in line.split("PartitionFilters: [")[1] and "= 2024-01-01)" in line.split("PartitionFilters: [")[1]
    facts = [line for line in scans if "events.parquet" in line]
    assert bool(facts) == (name in WITH_FACTS)
    for line in facts:
        assert "GreaterThanOrEqual(ts" in line and "LessThan(ts" in line


@pytest.mark.parametrize("name", ["classify_lines", "structure_chunks", "chunk_metadata", "merge_small_chunks", "split_large_chunks", "recursive_split"])
def test_texts_are_not_shuffled(spark, name):
    assert "Exchange" not in plan(entry.queries()[name](spark, SF))


def test_sequences_sort_no_stop_whole(spark):
    text = plan(entry.queries()["multi_scale_sequences"](spark, SF))
    assert "Window" not in text and "REPARTITION_BY_NUM" in text


def test_scores_broadcast_no_stops(spark):
    from headway.operators import scores, views
    from headway.sources.mapping import MONTH, TransitTables

    t = TransitTables(spark, SF)
    shp = views.station_hourly_patterns(t.sph, t.sm, t.stops, MONTH)
    for model in (scores.commuter_scores, scores.tourism_scores, scores.vulnerable_scores):
        joins = [line for line in plan(model(t.sph, t.sections, shp, t.sm, MONTH)).split("\n") if "Join" in line]
        assert any("SortMergeJoin" in line for line in joins)
        assert not [line for line in joins if "Broadcast" in line and ("station_id#" in line or "node_id#" in line)]


def test_scores_group_a_month_once(spark):
    from headway.operators import scores, views
    from headway.sources.mapping import MONTH, TransitTables

    t = TransitTables(spark, SF)
    shp = views.station_hourly_patterns(t.sph, t.sm, t.stops, MONTH).localCheckpoint()
    for model in (scores.tourism_scores, scores.vulnerable_scores):
        joins = [line for line in plan(model(t.sph, t.sections, shp, t.sm, MONTH)).split("\n") if "Join" in line]
        assert len([line for line in joins if "hour_of_day" in line]) == 3
