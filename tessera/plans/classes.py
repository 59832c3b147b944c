"""Anomalies against the local background, class masks and their blobs; the SQL opens every box by a nested loop instead of running sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classes, raster
from ..operators.components import grid_components
from ..sources.fixtures import fixture
from .catalog import _NDWI, _OTSU, built

#: The raster of fx_pixel, and the box of 25 pixels around each.
ROWS, COLS, K = 40, 25, 12
#: fx_pixel has seven scenes of at most 1,000 pixels: a tenth of a raster has to be wet, and a pixel seen in four scenes, twice at either stage.
LEAST_WET, LEAST_SEEN, LEAST_END = 100, 4, 2
#: Its pixels differ from year to year more than a lake's bottom does, so an anomaly is milder and held in fewer scenes.
BRIGHT_Z, HELD, DRY_Z = 0.5, 0.4, 0.5
#: Pixels this near the raster's edge are mixed with the shore.
SHORE = 2

_LOOKS = f"""th as ({_OTSU}),
  px as (select p.t, p.r, p.c, p.green, p.nir, {_NDWI} as ndwi, threshold from fx_pixel p join th on p.t = th.t where valid and {_NDWI} is not null),
  w as (select * from px where ndwi > threshold)"""

_ANOMALIES = f"""{_LOOKS},
  big as (select t from w group by t having count(*) >= {LEAST_WET}),
  box as (select a.t, a.r, a.c, a.green, a.nir, count(*) as n, avg(v.green) as mg, avg(v.green * v.green) as sg, avg(v.nir) as mn, avg(v.nir * v.nir) as sn
    from w a join big on a.t = big.t cross join (select unnest(range(-{K}, {K + 1})) as dr) x cross join (select unnest(range(-{K}, {K + 1})) as dc) y
    join w v on v.t = a.t and v.r = greatest(0, least({ROWS - 1}, a.r + dr)) and v.c = greatest(0, least({COLS - 1}, a.c + dc)) group by 1, 2, 3, 4, 5),
  z as (select t, r, c, case when n > {0.05 * (2 * K + 1) ** 2} then (green - mg) / sqrt(greatest(1e-6, sg - mg * mg)) end as zg,
    case when n > {0.05 * (2 * K + 1) ** 2} then (nir - mn) / sqrt(greatest(1e-6, sn - mn * mn)) end as zn from box),
  an as (select r, c, count(*) as obs, sum(case when zg > {BRIGHT_Z} then 1 else 0 end)::bigint as hits, sum(coalesce(zn, 0)) / count(*) as nir_z from z group by r, c)"""

_MASKS = f"""{_ANOMALIES},
  st as (select t, sum(case when ndwi > threshold then 1 else 0 end) / count(*)::double as stage from px group by t),
  cut as (select percentile_cont(0.3) within group (order by stage) as lo, percentile_cont(0.7) within group (order by stage) as hi from st),
  lk as (select px.r, px.c, ndwi <= threshold as land, stage <= lo as low, stage >= hi as high from px join st on px.t = st.t cross join cut
    where px.r between {SHORE} and {ROWS - 1 - SHORE} and px.c between {SHORE} and {COLS - 1 - SHORE}),
  s as (select r, c, count(*) as seen, avg(land::int) as fr, coalesce(avg(land::int) filter (where low), 0) as fl, coalesce(avg(land::int) filter (where high), 0) as fh,
    count(*) filter (where low) as nl, count(*) filter (where high) as nh from lk group by r, c having count(*) >= {LEAST_SEEN}),
  k as (select s.r, s.c, fr, fl - fh as delta, hits / obs::double as frac, case when fr >= 0.6 then 'exposed' when fl - fh >= 0.35 and fh < 0.6 and nl >= {LEAST_END} and nh >= {LEAST_END} then 'drawdown'
    when hits / obs::double >= {HELD} and obs >= {LEAST_SEEN} then case when nir_z >= {DRY_Z} then 'rock' else 'shoal' end end as cls from s left join an on s.r = an.r and s.c = an.c),
  masks as (select r, c, cls, case cls when 'exposed' then fr when 'drawdown' then delta else frac end as conf from k where cls is not null)"""


def _pixels(spark, d):
    """``t, r, c, green, nir, ndwi, threshold`` of the valid pixels, with their scene's own threshold."""
    pixels = fixture(spark, d, "fx_pixel").where("valid").withColumn("ndwi", raster.ndwi(F.col("green"), F.col("nir"))).where("ndwi is not null")
    cuts = raster.otsu_thresholds(pixels.select("t", F.col("ndwi").alias("v")), "t", "v").withColumn("threshold", F.round("threshold", 9))
    return pixels.join(cuts, "t").select("t", "r", "c", "green", "nir", "ndwi", "threshold")


def _anomalies(pixels):
    return classes.anomalies(classes.local_z(pixels.where("ndwi > threshold"), "t", ["green", "nir"], K, ROWS, COLS, LEAST_WET), BRIGHT_Z)


def _masks(spark, d):
    pixels = _pixels(spark, d)
    stages = pixels.groupBy("t").agg((F.count(F.when(F.expr("ndwi > threshold"), 1)) / F.count("*")).alias("stage"))
    cuts = stages.agg(F.percentile("stage", 0.3).alias("lo"), F.percentile("stage", 0.7).alias("hi"))
    stages = stages.join(F.broadcast(cuts)).select("t", (F.col("stage") <= F.col("lo")).alias("low"), (F.col("stage") >= F.col("hi")).alias("high"))  # one row of cuts
    inner = pixels.where(F.col("r").between(SHORE, ROWS - 1 - SHORE) & F.col("c").between(SHORE, COLS - 1 - SHORE))
    looks = inner.join(stages, "t").select("r", "c", F.expr("ndwi <= threshold").alias("land"), "low", "high")
    return classes.class_masks(looks, _anomalies(pixels), LEAST_SEEN, LEAST_END, held=HELD, dry_z=DRY_Z)


@built("a9_anomaly_fraction", f"with {_ANOMALIES} select r, c, obs, hits, round(hits / obs::double, 9) as frac, round(nir_z, 6) + 0.0 as nir_z from an")
def _a9(spark, d):
    return _anomalies(_pixels(spark, d)).withColumn("frac", F.round("frac", 9)).withColumn("nir_z", F.round("nir_z", 6) + 0.0)


@built("a10_class_masks", f"with {_MASKS} select r, c, cls, round(conf, 9) as conf from masks")
def _a10(spark, d):
    return _masks(spark, d).withColumn("conf", F.round("conf", 9))


@built("a11_detected_blobs", f"""with recursive {_MASKS}, m as (select cls, r, c, r * {COLS} + c as k, conf from masks),
reach as (select cls, k, k as other from m union select a.cls, a.k, n.k from reach a join m o on a.cls = o.cls and a.other = o.k join m n on n.cls = o.cls and abs(n.r - o.r) + abs(n.c - o.c) = 1),
b as (select cls, k, min(other) as blob from reach group by cls, k)
select case when b.cls = 'exposed' and count(*) >= 8 then 'island' else b.cls end as cls, blob, count(*) as px, 100 * count(*) as area_m2, round(avg(conf), 6) as confidence, round(avg(m.r), 6) as r, round(avg(m.c), 6) as c
from b join m on b.cls = m.cls and b.k = m.k group by b.cls, blob having count(*) >= 2""")
def _a11_blobs(spark, d):
    """Blobs of one class and two pixels at least, with the mean of the statistic that made them; large exposed ones are islands.

    The classes' masks lie below each other on one raster, a row apart, so one search finds the blobs of all.
    """
    band = F.expr("case cls when 'exposed' then 0 when 'drawdown' then 1 when 'rock' then 2 else 3 end") * (ROWS + 1)
    masks = _masks(spark, d).withColumn("lr", (F.col("r") + band).cast("long"))
    blobs = grid_components(masks.select(F.col("lr").alias("r"), F.col("c").cast("long").alias("c")), COLS).select(F.col("r").alias("lr"), F.col("c").cast("int").alias("c"), F.col("blob").alias("component"))
    out = masks.join(blobs, ["lr", "c"]).groupBy("component", "cls").agg(F.min(F.col("r") * COLS + F.col("c")).cast("long").alias("blob"), F.count("*").alias("px"), F.avg("conf").alias("confidence"), F.avg("r").alias("r"), F.avg("c").alias("c"))
    island = F.when((F.col("cls") == "exposed") & (F.col("px") >= 8), "island").otherwise(F.col("cls"))
    return out.where("px >= 2").select(island.alias("cls"), "blob", "px", (100 * F.col("px")).alias("area_m2"), F.round("confidence", 6).alias("confidence"), F.round("r", 6).alias("r"), F.round("c", 6).alias("c"))
