"""KMZ archives of KML documents: placemarks with their popup's fields, and trees of links to regions, by Spark's XML reader."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import normal_label

_MARK = "Placemark array<struct<name:string,description:string,Point:struct<coordinates:string>>>"
_LINK = "NetworkLink array<struct<name:string,Region:struct<LatLonAltBox:struct<north:double,south:double,east:double,west:double>>,Link:struct<href:string>>>"
SCHEMA = f"Document struct<{_MARK.replace(' ', ':', 1)},{_LINK.replace(' ', ':', 1)}>"


def text(value: Column) -> Column:
    """A value as XML text."""
    out = value.cast("string")
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def element(name: str, *inside: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *inside, F.lit(f"</{name}>"))


def write_kmz(documents: DataFrame, path: str) -> None:
    """Each row of ``documents(file, kml)`` as ``path/file.kmz``, a zip with one KML member. A task that runs again writes the same bytes."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path)
        where.create_dir(root, recursive=True)
        for batch in batches:
            for name, kml in zip(batch["file"].to_pylist(), batch["kml"].to_pylist(), strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo("doc.kml"), kml)
                with where.open_output_stream(f"{root}/{name}.kmz") as f:
                    f.write(held.getvalue())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    documents.select("file", "kml").mapInArrow(store, "n long").agg(F.sum("n")).collect()


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """``file, doc`` (parsed) for every KML member of the archives at ``path``; files that are no archives are left out, members that are no KML give a null."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for member in sorted(m for m in z.namelist() if m.lower().endswith(".kml")):
                            yield pa.RecordBatch.from_pydict({"file": [name], "kml": [z.read(member).decode(errors="replace")]})

    kml = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unzip, "file string, kml string")
    return kml.select(F.regexp_extract("file", "([^/]+)[.][^./]*$", 1).alias("file"), F.from_xml("kml", SCHEMA, {"rowTag": "kml", "mode": "PERMISSIVE"}).alias("doc"))


def placemarks(read: DataFrame) -> DataFrame:
    """``file, i, name, lon, lat, fields`` of the placemarks with a point; ``fields`` are the popup table's values by normalised label."""
    each = read.select("file", F.posexplode("doc.Document.Placemark").alias("i", "p"))
    at = F.split(F.trim(F.col("p.Point.coordinates")), ",")
    number = lambda k: F.expr("try_cast(at[%d] as double)" % k)
    cell = r"<td>\s*([^<]+?)\s*</td>\s*<td>\s*([^<]*?)\s*</td>"
    part = lambda k: F.regexp_extract_all("p.description", F.lit(cell), F.lit(k))
    found = each.withColumn("at", at).withColumn("lon", number(0)).withColumn("lat", number(1)).where("lon is not null and lat is not null")
    labels = F.transform(F.coalesce(part(1), F.array().cast("array<string>")), normal_label)
    return found.select("file", "i", "p.name", "lon", "lat", F.map_from_arrays(labels, F.coalesce(part(2), F.array().cast("array<string>"))).alias("fields"))


def links(read: DataFrame) -> DataFrame:
    """``file, name, href, north, south, east, west`` of the network links."""
    each = read.select("file", F.explode("doc.Document.NetworkLink").alias("l"))
    return each.select("file", "l.name", "l.Link.href", "l.Region.LatLonAltBox.*")


def tiles(found: DataFrame, root: str, deepest: int = 32) -> DataFrame:
    """``name, href, parent, depth``: the links reached from the document ``root``, level by level; a link's ``parent`` is the link that led to its document.

    A document that is linked again, or that links back, is not entered twice: the first level that reaches it stands. Beyond ``deepest`` levels it raises.
    """
    from ..functions.storage import kept

    all_links = found.select("file", "name", "href")
    level = kept(all_links.where(F.col("file") == root).select("name", "href", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")), "level")
    out, entered = level, level.select("href").distinct().unionByName(found.sparkSession.range(1).select(F.lit(root).alias("href")))
    for depth in range(1, deepest + 1):
        way = level.groupBy(F.col("href").alias("file")).agg(F.min("name").alias("parent"))
        level = kept(all_links.join(way, "file").select("name", "href", "parent", F.lit(depth).alias("depth")), "level")
        if level.limit(1).count() == 0:
            return out
        out = out.unionByName(level)
        fresh = level.join(entered, "href", "left_anti")
        entered = entered.unionByName(fresh.select("href").distinct())
        level = fresh
    raise ValueError("the links go deeper than allowed")
