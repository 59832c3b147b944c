"""Null samples: pseudo-random points by a multiplicative congruence on row ids, so that both engines draw the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import geometry, spatial
from ..sources.fixtures import fixture
from .catalog import built
from .shapes import _EDGES, LAKE

M = 2147483647
_DRAWN = f"""d as (select o_orderkey as id, (o_orderkey * 48271) % {M} % 2000 * 1.0::double as x, (o_orderkey * 69621) % {M} % 2000 * 1.0::double as y from orders),
e as ({_EDGES}), c as (select d.id, d.x, d.y, e.*, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) as s from d cross join e),
n as (select id, x, y, min(sqrt(power(x - x0 - s * (x1 - x0), 2) + power(y - y0 - s * (y1 - y0), 2))) as shore_m from c group by id, x, y
  having sum(case when (y0 > y) <> (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / nullif(y1 - y0, 0) then 1 else 0 end) % 2 = 1)"""


def null_points(spark, sf_dir: str) -> DataFrame:
    """``id, x, y, shore_m`` of one point for each order, those outside the lake rejected."""
    key = F.col("o_orderkey").cast("long")
    drawn = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("id"), (key * 48271 % M % 2000).cast("double").alias("x"), (key * 69621 % M % 2000).cast("double").alias("y"))
    kept = geometry.inside_and_shore(drawn, geometry.edges(spark, LAKE)).where("inside")
    return drawn.join(kept, "id").select("id", "x", "y", "shore_m")


@built("n1_null_points", f"with {_DRAWN} select id, x, y, round(shore_m, 6) as shore_m from n")
def _n1(spark, d):
    return null_points(spark, d).withColumn("shore_m", F.round("shore_m", 6))


@built("n2_null_recall", f"""with {_DRAWN} select n.id % 5 as trial, count(*) as points, sum(case when exists (select 1 from fx_naip b where sqrt((n.x - b.x) * (n.x - b.x) + (n.y - b.y) * (n.y - b.y)) <= 15) then 1 else 0 end)::bigint as hits
from n group by 1""")
def _n2(spark, d):
    points = null_points(spark, d)
    near = spatial.has_within(points, fixture(spark, d, "fx_naip"), 15.0).select("id", F.lit(1).alias("hit"))
    return points.join(near, "id", "left").groupBy((F.col("id") % 5).alias("trial")).agg(F.count("*").alias("points"), F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("hits"))


@built("n3_shore_matched_null", f"""with {_DRAWN}, q as (select cast(floor(shore_m / 50) as bigint) as band, count(*) as quota from (
  select n2.id, min(sqrt(power(n2.x - x0 - greatest(0, least(1, ((n2.x - x0) * (x1 - x0) + (n2.y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) * (x1 - x0), 2)
    + power(n2.y - y0 - greatest(0, least(1, ((n2.x - x0) * (x1 - x0) + (n2.y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) * (y1 - y0), 2))) as shore_m
  from fx_sounding n2 cross join e group by n2.id) s group by 1)
select id, band from (select n.id, q.band, q.quota, row_number() over (partition by q.band order by (n.id * 16807) % {M}, n.id) as rn from n join q on cast(floor(n.shore_m / 50) as bigint) = q.band) r where rn <= quota""")
def _n3(spark, d):
    band = F.floor(F.col("shore_m") / 50).cast("long")
    quota = geometry.inside_and_shore(fixture(spark, d, "fx_sounding"), geometry.edges(spark, LAKE)).groupBy(band.alias("band")).agg(F.count("*").alias("quota"))
    w = Window.partitionBy("band").orderBy(F.col("id") * 16807 % M, "id")
    picked = null_points(spark, d).select("id", band.alias("band")).join(quota, "band").withColumn("rn", F.row_number().over(w))
    return picked.where("rn <= quota").select("id", "band")
