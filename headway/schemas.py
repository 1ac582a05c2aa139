"""Explicit schemas of landed files and table keys."""

from __future__ import annotations

from pyspark.sql import types as T

HH = [f"{h:02d}" for h in range(24)]


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# Landed feeds keep every value as text; operators cast with try_cast.
STATION_FEED = T.StructType(
    _text("record_date", "routeId", "routeNm", "staId", "staNm", "staSn")
    + _text(*[f"a05Num{h}h" for h in HH], *[f"ridePnsgerCnt{h}h" for h in HH], *[f"alghPnsgerCnt{h}h" for h in HH])
)
SECTION_FEED = T.StructType(
    _text("record_date", "routeId", "fromStaId", "toStaId", "staSn", "a18SumLoadPsng")
    + _text(*[f"a18SumLoadPsngNum{h}h" for h in HH])
)
SPEED_FEED = T.StructType(
    _text("record_date", "routeId", "fromStaId", "toStaId", "fromStaSn", "toStaSn") + _text(*[f"tripTime{h}h" for h in HH])
)
OD_FEED = T.StructType(_text("record_date", "startSggNm", "startEmdNm", "endSggNm", "endEmdNm", "totPsngNum"))

OD_CSV_COLUMNS = ["RIDE_PUB_STA_ID", "ALGH_PUB_STA_ID", "CNT"] + [f"CNT_{h}H" for h in HH]

KEYS = {
    "station": ["record_date", "route_id", "node_id", "hour"],
    "section": ["record_date", "route_id", "from_node_id", "to_node_id", "hour"],
    "speed": ["record_date", "route_id", "from_node_id", "to_node_id", "hour"],
    "od": ["record_date", "start_district", "start_admin_dong", "end_district", "end_admin_dong"],
    "daily_od": ["analysis_date", "from_station_id", "to_station_id"],
    "stops": ["node_id"],
    "routes": ["route_id"],
    "schedules": ["route_id"],
    "details": ["route_id"],
    "route_stops": ["route_id", "node_sequence"],
    "population": ["admin_dong_code", "time_zone"],
    "scores": ["station_id", "analysis_month", "hour_of_day"],
}

# fixed values: headers of the stop, route and route-stop master files and the columns they load into;
# some stop headers have two spellings
STOP_HEADERS = {
    "노드ID": "node_id",
    "노드명": "node_name",
    "노드설명": "node_description",
    "노드번호": "node_num",
    "정류장번호": "node_num",
    "노드유형": "node_type",
    "좌표X": "coordinates_x",
    "좌표Y": "coordinates_y",
    "매핑좌표X": "mapping_x",
    "매핑좌표Y": "mapping_y",
    "맵핑좌표X": "mapping_x",
    "맵핑좌표Y": "mapping_y",
    "표준여부": "is_standard",
    "표준코드여부(1:표준/0:비표준)": "is_standard",
    "사용여부": "is_active",
}
ROUTE_HEADERS = {
    "노선ID": "route_id",
    "노선명": "route_name",
    "노선유형": "route_type",
    "지역ID": "region_id",
    "거리": "total_distance",
    "기점명(인가정보)": "start_point",
    "종점명(인가정보)": "end_point",
    "인가선수": "authorized_vehicles",
    "운행여부": "is_operating",
    "배차": "weekday_interval",
    "배차(토요일)": "saturday_interval",
    "배차(공휴일)": "holiday_interval",
    "첫차시간": "weekday_first_time",
    "막차시간": "weekday_last_time",
    "첫차시간(토요일)": "saturday_first_time",
    "막차시간(토요일)": "saturday_last_time",
    "첫차시간(공휴일)": "holiday_first_time",
    "막차시간(공휴일)": "holiday_last_time",
    "최소배차": "min_interval",
    "최대배차": "max_interval",
    "운행소요시간": "total_operation_time",
    "종점대기시간": "terminal_waiting_time",
    "곡률도": "curvature",
    "예비차량건수": "spare_vehicles",
    "최고속도": "max_speed",
    "평균속도": "avg_speed",
}
ROUTE_STOP_HEADERS = {
    "노선ID": "route_id",
    "노드ID": "stop_id",
    "노드순번": "node_sequence",
    "정류장순번": "stop_sequence",
    "구간ID": "section_id",
    "정류장구간ID": "stop_section_id",
    "교차로구간ID": "intersection_section_id",
    "링크ID": "link_id",
    "구간거리누계": "cumulative_section_distance",
    "정류장거리누계": "cumulative_stop_distance",
    "방향안내": "direction_guide",
    "사용여부": "is_active",
}
