"""Registered queries against their SQL statements on the smallest tables."""

import math

import pytest
from small_tables import SF

import __spark_entry__ as entry

SAMPLE = """
hourly_traffic_patterns district_monthly_traffic station_monthly_traffic city_hourly_patterns period_summary
district_ranking stop_weekly_avg stop_route_stats data_range_flag or_join_sections hourly_traffic peak_hours
weekday_weekend_ratio heatmap_nested heatmap_statistics kpi_concentration overview_metrics station_display_name
weekend_dominant night_peak_hour rush_hour_evening area_residential underutilized district_averages commuter_scores
tourism_scores vulnerable_scores station_drt_detail drt_model_statistics compare_drt_models city_top_drt
daily_vulnerable_features poi_weights daily_od_build monthly_od_summary od_time_destinations od_mismatch od_pair_hourly
station_wide_to_tall section_wide_to_tall dedupe_keep_first clean_stops clean_routes clean_route_stops filter_summary
read_csv_bom read_od_csv normalize_geojson upsert_station purge_expired spatial_within range_radius_join mstgcn_features
densify_time_grid multi_scale_sequences strided_samples train_zscore merge_monthly_sequences connected_components
normalized_laplacian_edges classify_lines changed_files similar_top_k rerank format_context parse_labelled_text
sql_confidence sql_safety_flags constraint_check stream_late_rows stream_ttl_cache
""".split()


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else repr(v + 0.0)
        return None if v is None else str(v)

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canon(df.collect(), df.columns) == canon(cursor.fetchall(), names)


def test_every_statement_runs(duck):
    for name, sql in entry.oracle_sql().items():
        duck.execute(f"SELECT count(*) FROM ({sql})")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
