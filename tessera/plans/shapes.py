"""Queries over nested values: placemark text, coordinate arrays, polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry
from ..sources.fixtures import fixture
from .catalog import built

#: The stand-in lake: an octagon with a square island.
LAKE = [[(1950, 1000), (1672, 1672), (1000, 1950), (328, 1672), (50, 1000), (328, 328), (1000, 50), (1672, 328)], [(900, 900), (1100, 900), (1100, 1100), (900, 1100)]]
_EDGES = "select * from (values " + ", ".join(f"({i}, {a}::double, {b}::double, {r[(j + 1) % len(r)][0]}::double, {r[(j + 1) % len(r)][1]}::double)" for i, r in enumerate(LAKE) for j, (a, b) in enumerate(r)) + ") e(ring, x0, y0, x1, y1)"


@built("g6_point_in_lake", f"""with e as ({_EDGES}), p as (select n.id, e.*, n.x, n.y, case when x1 = x0 and y1 = y0 then 0 else greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) end as t from fx_naip n cross join e)
select id, sum(case when (y0 > y) <> (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / nullif(y1 - y0, 0) then 1 else 0 end) % 2 = 1 as inside, round(min(sqrt(power(x - x0 - t * (x1 - x0), 2) + power(y - y0 - t * (y1 - y0), 2))), 6) as shore_m from p group by id""")
def _g6(spark, d):
    return geometry.inside_and_shore(fixture(spark, d, "fx_naip"), geometry.edges(spark, LAKE)).withColumn("shore_m", F.round("shore_m", 6))


@built("r6_lake_mask", f"""with e as ({_EDGES}), g as (select id, x, y from fx_sounding), p as (select g.*, e.* from g cross join e)
select id, sum(case when (y0 > y) <> (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / nullif(y1 - y0, 0) then 1 else 0 end) % 2 = 1 as water from p group by id""")
def _r6(spark, d):
    return geometry.inside_and_shore(fixture(spark, d, "fx_sounding"), geometry.edges(spark, LAKE)).select("id", F.col("inside").alias("water"))


@built("r6_raster_mask", f"""with e as ({_EDGES}), g as (select r, c, c * 25.0 as x, r * 25.0 as y from (select unnest(range(0, 80)) as r) a cross join (select unnest(range(0, 80)) as c) b),
p as (select g.*, e.*, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) as t from g cross join e)
select r, c, min(sqrt(power(x - x0 - t * (x1 - x0), 2) + power(y - y0 - t * (y1 - y0), 2))) >= 60 as far from p group by r, c
having sum(case when (y0 > y) <> (y1 > y) and x >= x0 + (y - y0) * (x1 - x0) / nullif(y1 - y0, 0) then 1 else 0 end) % 2 = 1""")
def _r6_mask(spark, d):
    """Nodes of a 25 m raster in the lake, and which of them lie 60 m or more from its shores."""
    return geometry.eroded(geometry.edges(spark, LAKE), 25.0, 60.0)


@built("g6_points_in_parcels", """with e as (select id as shell, x as x0, y as y0, coalesce(lead(x) over w, first_value(x) over w) as x1, coalesce(lead(y) over w, first_value(y) over w) as y1 from fx_ring where ring = 0 window w as (partition by id order by seq rows between unbounded preceding and unbounded following)),
p as (select n.id, n.x, n.y, e.*, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) as t from fx_naip n cross join e),
s as (select id, sum(case when (y0 > y) <> (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / nullif(y1 - y0, 0) then 1 else 0 end) % 2 = 1 as inside, round(min(sqrt(power(x - x0 - t * (x1 - x0), 2) + power(y - y0 - t * (y1 - y0), 2))), 6) as shore_m from p group by id)
select id, case when shore_m > 0 then inside end as inside, shore_m from s""")
def _g6_parcels(spark, d):
    """Even-odd over the shells of all parcels at once: a polygon whose edges grow with the table. Points on an edge are neither in nor out."""
    parcels = geometry.ring_edges(fixture(spark, d, "fx_ring").where("ring = 0"))
    return geometry.inside_and_shore(fixture(spark, d, "fx_naip"), parcels).select("id", F.when(F.round("shore_m", 6) > 0, F.col("inside")).alias("inside"), F.round("shore_m", 6).alias("shore_m"))


@built("s5_placemarks", """with c as (select page_id, unnest(string_split(html, '<a ')) as chunk, generate_subscripts(string_split(html, '<a '), 1) - 1 as pos from pages)
select page_id, pos, regexp_extract(chunk, 'href="([^"]+)"', 1) as href, length(chunk) as n from c where pos > 0""")
def _s5(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.posexplode(F.split("html", "<a ")).alias("pos", "chunk"))
    return pages.where("pos > 0").select("page_id", "pos", F.regexp_extract("chunk", 'href="([^"]+)"', 1).alias("href"), F.length("chunk").alias("n"))


@built("s13_keyed_json", "select event_id as id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _s13(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.from_json("props", "map<string,string>")["k"].cast("long").alias("k"))


@built("s14_nested_marks", "select user_id as section, count(*) as marks, count(distinct event_type) as kinds from events group by user_id")
def _s14(spark, d):
    nested = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("section"), (F.col("event_id") % 16).alias("part")).agg(F.collect_list("event_type").alias("marks"))
    return nested.select("section", F.explode("marks").alias("m")).groupBy("section").agg(F.count("*").alias("marks"), F.countDistinct("m").alias("kinds"))


@built("s15_byte_grid", "select r, sum(ft)::bigint as total, count(*) as known from fx_grid where ft is not null group by r")
def _s15(spark, d):
    """Rows of the depth grid packed to base64 bytes, 255 where unknown, and decoded again."""
    grid = fixture(spark, d, "fx_grid").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", F.coalesce("ft", F.lit(255)).cast("int").alias("v")))).alias("a"))
    packed = grid.select("r", F.base64(F.unhex(F.array_join(F.transform("a", lambda x: F.lpad(F.hex(x["v"]), 2, "0")), ""))).alias("b64"))
    text = packed.select("r", F.hex(F.unbase64("b64")).alias("h"))
    values = text.select("r", F.explode(F.expr("transform(sequence(1, length(h), 2), i -> cast(conv(substring(h, i, 2), 16, 10) as long))")).alias("v"))
    return values.where("v <> 255").groupBy("r").agg(F.sum("v").alias("total"), F.count("*").alias("known"))


@built("k6_coordinate_trim", "select vec_id, sum(v) as total, count(*) as n from (select vec_id, unnest(list_transform(embedding, lambda x: round(x::double * 1000)::bigint)) as v from embeddings) e group by vec_id")
def _k6(spark, d):
    trimmed = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("v"))
    return trimmed.select("vec_id", F.explode("v").alias("v")).groupBy("vec_id").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@built("a35_nested_bbox", "select label, min(v) as lo, max(v) as hi, count(*) as n from (select label, unnest(embedding) as v from embeddings) e group by label")
def _a35(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.explode("embedding").alias("v")).groupBy("label").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))


@built("a41_key_frequency", "select k, count(*) as n from (select unnest(json_keys(props)) as k from events) e group by k")
def _a41(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.explode(F.expr("json_object_keys(props)")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@built("j6_shore_distance", f"""with e as ({_EDGES}), p as (select n.id, e.*, n.x, n.y, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) as t from fx_sentinel n cross join e),
s as (select id, min(sqrt(power(x - x0 - t * (x1 - x0), 2) + power(y - y0 - t * (y1 - y0), 2))) as d from p group by id)
select id, round(d, 6) as shore_m, d > 50 as offshore from s""")
def _j6(spark, d):
    out = geometry.inside_and_shore(fixture(spark, d, "fx_sentinel"), geometry.edges(spark, LAKE))
    return out.select("id", F.round("shore_m", 6).alias("shore_m"), (F.col("shore_m") > 50).alias("offshore"))
