"""Sources and sinks of map files: GeoJSON feature collections and zipped KML placemarks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "geometry struct<type:string,coordinates:array<double>>, properties {}"


def read_points(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """``x, y`` and the named properties (``struct<...>`` text) of a GeoJSON collection of points; a missing file is an empty one.

    Features without geometry have null coordinates; properties that a feature lacks are null.
    """
    schema = f"type string, features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:{properties}>>"
    try:
        read = spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        read = spark.createDataFrame([], schema)
    each = read.select(F.explode("features").alias("f"))
    return each.select(F.get(F.col("f.geometry.coordinates"), F.lit(0)).alias("x"), F.get(F.col("f.geometry.coordinates"), F.lit(1)).alias("y"), "f.properties.*")


def write_points(points: DataFrame, path: str, digits: int = 6) -> None:
    """One GeoJSON feature a line (newline-delimited), coordinates rounded; every column but x and y is a property.

    Lines rather than one collection, so that tasks write side by side.
    """
    rest = [c for c in points.columns if c not in ("x", "y")]
    where = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(F.round("x", digits), F.round("y", digits)).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), where.alias("geometry"), F.struct(*rest).alias("properties"))
    points.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """``file, lon, lat, text`` of the placemarks with a point in every KML member of the KMZ files at ``path``; files that are no archives are left out."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if not zipfile.is_zipfile(io.BytesIO(content)):
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inner = [z.read(m).decode(errors="replace") for m in sorted(z.namelist()) if m.lower().endswith(".kml")]
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(inner), pa.string()), "kml": pa.array(inner, pa.string())})

    kml = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unzip, "file string, kml string")
    marks = kml.select("file", F.posexplode(F.split("kml", "<Placemark")).alias("i", "text")).where("i > 0")
    at = r"<coordinates>\s*([-0-9.]+),([-0-9.]+)"
    found = marks.where(F.col("text").rlike(at))
    return found.select("file", F.regexp_extract("text", at, 1).cast("double").alias("lon"), F.regexp_extract("text", at, 2).cast("double").alias("lat"), "text")


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """As ``read_points`` for features a line each, as ``write_points`` leaves them."""
    read = spark.read.schema(f"type string, geometry struct<type:string,coordinates:array<double>>, properties {properties}").json(path)
    return read.select(F.get(F.col("geometry.coordinates"), F.lit(0)).alias("x"), F.get(F.col("geometry.coordinates"), F.lit(1)).alias("y"), "properties.*")


def read_polygons(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """``rings`` (arrays of points, the shell first) and the named properties of GeoJSON polygon features, a line each."""
    read = spark.read.schema(f"type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties {properties}").json(path)
    return read.where("geometry.type = 'Polygon'").select(F.col("geometry.coordinates").alias("rings"), "properties.*")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """``id, type, tags, lat, lon`` of map elements from documents ``{"elements": [...]}``, a line each; tags are a map."""
    read = spark.read.schema("elements array<struct<id:long,type:string,tags:map<string,string>,lat:double,lon:double>>").json(path)
    return read.select(F.explode("elements").alias("e")).select("e.*")


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several parquet tables that exists."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(", ".join(paths))


def whitelisted(rows: DataFrame, path: str) -> DataFrame:
    """The rows whose id the parquet table at ``path`` lists; all of them if there is no such table."""
    try:
        ids = rows.sparkSession.read.parquet(path).select("id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows
    return rows.join(ids, "id", "left_semi")
