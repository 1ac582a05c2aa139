"""Readers for landed files."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from itertools import batched
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.operators.cleansing import CITY, dong_from_full_name
from headway.schemas import OD_CSV_COLUMNS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOM = "﻿"


def read_csv_bom(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """CSV with a byte-order mark and foreign headers. All columns are text; no inference pass."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.lstrip(BOM).strip() for c in df.columns])
    return df.withColumnsRenamed(names or {})


#: Eight digits after ``=`` in the last folder, or before ``.`` or ``_`` in the file name; other
#: folders and the random names of part files may hold digits of their own.
OD_DATE = r"(?:=(?=\d{8}/)|[/_-](?=\d{8}[._]))(\d{8})"


def read_od_csv(spark: SparkSession, path: str, date_pattern: str = OD_DATE) -> DataFrame:
    """Daily OD files; the date is taken from the last folder (``name=yyyyMMdd``) or the file name.

    Fails when a column is missing or a path has no date.
    """
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    missing = [c for c in OD_CSV_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"OD file lacks columns {missing}")
    tail = F.substring_index(F.col("_metadata.file_path"), "/", -2)
    found = F.try_to_timestamp(F.regexp_extract(tail, date_pattern, 1), F.lit("yyyyMMdd")).cast("date")
    day = F.coalesce(found, F.raise_error(F.concat(F.lit("no date in the path of an OD file: "), tail)).cast("date"))
    return df.select(
        day.alias("record_date"),
        F.col("RIDE_PUB_STA_ID").alias("from_station_id"),
        F.col("ALGH_PUB_STA_ID").alias("to_station_id"),
        F.expr("try_cast(CNT AS bigint)").alias("cnt"),
        *[F.coalesce(F.expr(f"try_cast(CNT_{h:02d}H AS bigint)"), F.lit(0)).alias(f"h{h:02d}") for h in range(24)],
    )


def read_api_json(spark: SparkSession, path: str, service: str, row: T.StructType) -> DataFrame:
    """Landed pages, either bare rows or ``{service: {row: [...]}}``."""
    page = T.StructField(service, T.StructType([T.StructField("row", T.ArrayType(row))]))
    df = spark.read.schema(T.StructType([*row.fields, page])).json(path)
    bare = F.array(F.struct(*[F.col(f.name) for f in row.fields]))
    return df.select(F.explode(F.coalesce(F.col(f"{service}.row"), bare)).alias("r")).select("r.*")


def boundary_schema() -> T.StructType:
    props = T.StructType([T.StructField(n, T.StringType()) for n in ("adm_cd", "adm_cd2", "adm_nm", "sgg", "sido", "sidonm", "sggnm")])
    rings = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", rings)])
    feature = T.StructType([T.StructField("properties", props), T.StructField("geometry", geometry)])
    return T.StructType([T.StructField("features", T.ArrayType(feature))])


def read_geojson(spark: SparkSession, path: str, city: str | None = CITY) -> DataFrame:
    """FeatureCollection files of multipolygons to one row per feature of the city."""
    features = (
        spark.read.schema(boundary_schema()).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    )
    p = "f.properties."
    out = features.select(
        *[F.col(p + n) for n in ("adm_cd", "adm_cd2", "adm_nm", "sgg", "sido", "sidonm", "sggnm")],
        dong_from_full_name(F.col(p + "adm_nm")).alias("admin_dong_name"),
        F.transform(
            "f.geometry.coordinates",
            lambda polygon: F.transform(
                polygon, lambda ring: F.transform(ring, lambda v: F.struct(v[0].alias("lon"), v[1].alias("lat")))
            ),
        ).alias("polygons"),
    )
    return out if city is None else out.filter(F.col("sidonm") == city)


_ENTRY = "struct<type:string,geometry:string,properties:string,coordinates:string>"


def geojson_features(text: Column) -> Column:
    """Any GeoJSON-like text to an array of features ``{geometry, properties}``.

    Accepts a collection (typed or not), a feature, a bare geometry or a list of these.
    Entries without a geometry type are dropped.
    """
    top = F.from_json(text, "struct<type:string,features:string,geometry:string,properties:string,coordinates:string>")
    listed = F.from_json(F.when(F.ltrim(text).startswith("["), text).otherwise(top["features"]), f"array<{_ENTRY}>")
    one = F.array(F.from_json(text, _ENTRY))
    entries = F.when(F.ltrim(text).startswith("[") | top["features"].isNotNull(), listed).otherwise(one)

    def geometry(e: Column) -> Column:
        bare = F.to_json(F.struct(e["type"].alias("type"), e["coordinates"].alias("coordinates")))
        return F.when(e["geometry"].isNotNull(), e["geometry"]).when(e["coordinates"].isNotNull(), bare)

    shaped = F.transform(
        entries,
        lambda e: F.struct(
            geometry(e).alias("geometry"),
            F.get_json_object(geometry(e), "$.type").alias("geometry_type"),
            F.coalesce(F.get_json_object(geometry(e), "$.coordinates"), e["coordinates"]).alias("coordinates"),
            F.coalesce(e["properties"], F.lit("{}")).alias("properties"),
        ),
    )
    return F.filter(shaped, lambda f: F.coalesce(f["geometry_type"], F.lit("")) != "")


def normalize_geojson(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per valid feature with its position."""
    return df.select(*keep, F.posexplode(geojson_features(F.col(text))).alias("feature_idx", "f")).select(
        *keep, "feature_idx", "f.*"
    )


def validate_geojson(df: DataFrame, text: str) -> DataFrame:
    """Adds ``errors`` and ``valid``: an empty collection and features without coordinates."""
    features = geojson_features(F.col(text))
    lacking = F.filter(
        F.transform(
            features,
            lambda f, i: F.when(f["coordinates"].isNull(), F.concat(F.lit("Feature "), i.cast("string"), F.lit(": Missing coordinates"))),
        ),
        lambda e: e.isNotNull(),
    )
    none = F.when(F.coalesce(F.size(features), F.lit(0)) <= 0, F.array(F.lit("No valid features found")))
    return df.withColumn("errors", F.coalesce(none, lacking)).withColumn("valid", F.size("errors") == 0)


#: Files that a task reads; folders that the driver lists itself; text that leaves a task at once.
TASK_FILES, DRIVER_FOLDERS, BATCH_BYTES = 2000, 32, 1 << 20


def read_text_docs(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    """Every text file below ``path`` as one row.

    Where Arrow knows the file system, tasks list the folders and read the files; the driver knows folders and the number
    of files only. Spark's own reader, for all other paths, keeps every file on the driver and counts each as 4 MB of work, so
    small files make a task for a few of them.
    """
    files = _listed_files(spark, path, glob)
    if files is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        name.alias("source"),
        F.lower(F.element_at(F.split("path", r"\."), -1)).alias("file_type"),
        F.decode("content", "UTF-8").alias("text"),
        F.md5("content").alias("file_hash"),
    )


def _listed_files(spark: SparkSession, path: str, glob: str) -> DataFrame | None:
    """(path, content) of the files below a folder that Arrow can list, else None."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    if any(c in path for c in "*?[]{}\\,"):
        return None
    root = hadoop.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    try:
        system, own = fs.FileSystem.from_uri(_uri(root))
        if system.get_file_info(own).type != fs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError):
        return None
    pattern = hadoop.GlobPattern(glob).compiled().pattern()
    folders, found, level = [], 0, [root]
    while level:
        if len(level) <= DRIVER_FOLDERS:
            counted = [_counted(f, pattern) for f in level]
        else:
            counted = _spread(spark, "folder", level).mapInArrow(_mapped(_counted, pattern, ["found", "below"]), "found long, below array<string>").collect()
        level = [f for _, below in counted for f in below]
        folders += [f for f in level]
        found += sum(n for n, _ in counted)
    tasks = max(spark.sparkContext.defaultParallelism, -(-found // TASK_FILES))
    paths = _spread(spark, "folder", [root, *folders]).mapInArrow(_mapped(_paths, pattern, ["path"]), "path string")
    return paths.repartition(tasks, "path").mapInArrow(_contents, "path string, content binary")


def _uri(path: str) -> str:
    """Hadoop writes local paths with one slash, and no path of it is encoded."""
    scheme, rest = path.split(":", 1)
    return f"{scheme}:{'' if rest.startswith('//') else '//'}{quote(rest)}"


def _spread(spark: SparkSession, name: str, items: list[str]) -> DataFrame:
    frame = spark.createDataFrame(pa.table({name: pa.array(items, pa.string())}))
    return frame.repartition(min(len(items), 4 * spark.sparkContext.defaultParallelism))


def _listing(folder: str) -> list[tuple[str, bool]]:
    """Names in a folder that Spark would read, which leaves out empty files, and whether they are folders."""
    system, own = fs.FileSystem.from_uri(_uri(folder))
    seen = [(f.base_name, f.type == fs.FileType.Directory) for f in system.get_file_info(fs.FileSelector(own)) if f.size != 0]
    return sorted((n, d) for n, d in seen if n.startswith(("_metadata", "_common_metadata")) or not re.match(r"\.|_[^=]*$", n) and not n.endswith("._COPYING_"))


def _counted(folder: str, pattern: str) -> tuple[int, list[str]]:
    names = _listing(folder)
    return sum(not d and re.fullmatch(pattern, n, re.DOTALL) is not None for n, d in names), [f"{folder.rstrip('/')}/{n}" for n, d in names if d]


def _paths(folder: str, pattern: str) -> Iterator[str]:
    return (f"{folder.rstrip('/')}/{n}" for n, d in _listing(folder) if not d and re.fullmatch(pattern, n, re.DOTALL))


def _mapped(make: Callable, pattern: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function: rows made of each folder, one row of several columns or rows of one."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                made = make(folder, pattern)
                if len(names) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array([made[0]], pa.int64()), pa.array([made[1]], pa.list_(pa.string()))], names)
                else:
                    for some in batched(made, 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names)

    return mapped


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

    rows, size = [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, own = fs.FileSystem.from_uri(_uri(path))
            with system.open_input_file(own) as f:
                rows.append((path, f.read()))
            size += len(rows[-1][1])
            if size >= BATCH_BYTES:
                yield packed(rows)
                rows, size = [], 0
    if rows:
        yield packed(rows)
