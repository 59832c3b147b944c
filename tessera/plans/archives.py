"""KMZ archives written from tables and read back, held against SQL on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import shared_path
from ..sources import kml
from ..sources.fixtures import fixture
from .catalog import built


def _documents(rows, item):
    """A document for each ``file`` of the rows, of their items."""
    body = rows.select("file", item.alias("item")).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("item")), "").alias("body"))
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>')
    return body.select("file", F.concat(head, kml.element("kml", kml.element("Document", F.col("body")))).alias("kml"))


def _read_back(spark, documents, label):
    path = shared_path(spark, label)
    kml.write_kmz(documents, path)
    return kml.read_kmz(spark, path)


def _mark(name, lon, lat, *fields):
    cells = [F.concat(F.lit(f"&lt;tr&gt;&lt;td&gt; {label} &lt;/td&gt;&lt;td&gt;"), kml.text(kml.text(value)), F.lit("&lt;/td&gt;&lt;/tr&gt;")) for label, value in fields]
    point = kml.element("Point", kml.element("coordinates", F.lit(" "), F.concat_ws(",", lon.cast("string"), lat.cast("string"), F.lit("0")), F.lit(" ")))
    return kml.element("Placemark", kml.element("name", kml.text(name)), kml.element("description", *cells), F.when(lon.isNotNull() & lat.isNotNull(), point).otherwise(""))


@built("s4_kmz_soundings", "select id, x as lon, y as lat, depth_ft from fx_sounding where id % 7 <> 0")
def _s4(spark, d):
    """Soundings in several archives; those whose depth can't be read are dropped."""
    rows = fixture(spark, d, "fx_sounding").withColumn("file", F.concat(F.lit("s"), (F.col("id") % 5).cast("string")))
    depth = F.when(F.col("id") % 7 == 0, "n/a").otherwise(F.col("depth_ft").cast("string"))
    read = _read_back(spark, _documents(rows, _mark(F.col("id"), F.col("x"), F.col("y"), ("Depth (ft):", depth), ("Data Source:", F.lit("survey")))), "soundings")
    found = kml.placemarks(read)
    return found.select(F.col("name").cast("long").alias("id"), "lon", "lat", F.expr("try_cast(fields['depth_ft'] as double)").alias("depth_ft")).where("depth_ft is not null")


@built("s6_kmz_named_placemarks", "select id, 'ramp &amp; dock' as name, lon, lat from fx_element where tags like '%ramp%' and lat is not null and lon between -60 and 60 and lat between 10 and 60")
def _s6(spark, d):
    """Placemarks found by name within a box; elements without a place have no point."""
    rows = fixture(spark, d, "fx_element").withColumn("file", F.concat(F.lit("e"), F.floor(F.col("id") / 500).cast("string")))
    name = F.coalesce(F.get_json_object("tags", "$.name"), F.lit("none"))
    found = kml.placemarks(_read_back(spark, _documents(rows, _mark(name, F.col("lon"), F.col("lat"), ("Id:", F.col("id")))), "elements"))
    return found.where(F.col("name").rlike("(?i)ramp|dock") & F.col("lon").between(-60, 60) & F.col("lat").between(10, 60)).select(F.col("fields")["id"].cast("long").alias("id"), F.trim("name").alias("name"), "lon", "lat")


@built("s7_region_tree", """select 'b' || k as name, 'b' || k as href, null as parent, 0 as depth, max(y) + 10 as north, min(x) - 10 as west from (select *, id % 4 as k from fx_sounding) s group by k
union all select 't' || id, 'x' || id, 'b' || (id % 4), 1, y + 10, x - 10 from fx_sounding""")
def _s7(spark, d):
    """A root document that links to four, and they to their tiles, each with its region."""
    s = fixture(spark, d, "fx_sounding").select(F.concat(F.lit("b"), (F.col("id") % 4).cast("string")).alias("file"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("href"), "x", "y")
    s = s.select("file", "name", "href", (F.col("y") + 10).alias("north"), (F.col("y") - 10).alias("south"), (F.col("x") + 10).alias("east"), (F.col("x") - 10).alias("west"))
    top = s.groupBy("file").agg(F.max("north").alias("north"), F.min("south").alias("south"), F.max("east").alias("east"), F.min("west").alias("west"))
    rows = s.unionByName(top.select(F.lit("root").alias("file"), F.col("file").alias("name"), F.col("file").alias("href"), "north", "south", "east", "west"))
    box = kml.element("Region", kml.element("LatLonAltBox", *[kml.element(c, F.col(c).cast("string")) for c in ("north", "south", "east", "west")]))
    link = kml.element("NetworkLink", kml.element("name", kml.text(F.col("name"))), box, kml.element("Link", kml.element("href", kml.text(F.col("href")))))
    found = kml.links(_read_back(spark, _documents(rows, link), "tiles"))
    return kml.tiles(found, "root").join(found.select("name", "href", "north", "west"), ["name", "href"]).select("name", "href", "parent", "depth", "north", "west")
