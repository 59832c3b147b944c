"""Iterative and streaming queries; a drained stream must give what the batch SQL gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, trajectory
from ..operators.components import grid_components
from ..sources.fixtures import fixture
from ..streaming import live, processors
from .catalog import _LEGS, _SCAN, BUILT, built


def _arriving(spark, d) -> live.Feed:
    return live.Feed(spark, d, live.by_time(spark, d, 3), 3)


def _swept(spark, d):
    feed = _arriving(spark, d)
    return live.collected(lambda: processors.swept(feed.fixes()), feed.arrivals(), "swept")


@built("t2s_stateful_legs", _LEGS + " select seq, trip, kind, round(leg_m, 6) as leg_m from k")
def _t2s(spark, d):
    return _swept(spark, d).where("what = 'fix' and kind is not null").select("seq", "trip", "kind", F.round("leg_m", 6).alias("leg_m"))


@built("t2s_swept_cells", BUILT["a34_strongest_claim"][1])
def _t2s_cells(spark, d):
    """Cells that trips gained, arrival by arrival; the strongest claim of all trips stands."""
    return trajectory.strongest_claims(_swept(spark, d).where("what = 'cell'"))


@built("t3s_live_hazard_scan", _SCAN + "select seq, hazard_id, round(range_m, 6) as range_m, round(ttc, 6) as ttc, severity, confirmed from hit")
def _t3s(spark, d):
    feed, hazards = _arriving(spark, d), fixture(spark, d, "fx_naip")
    hits = live.collected(lambda: alerts.corridor_scan(feed.fixes(), hazards), feed.arrivals(), "hits")
    return hits.withColumn("range_m", F.round("range_m", 6)).withColumn("ttc", F.round("ttc", 6))


@built("r7_connected_components", """with recursive m as (select r, c, r * 50 + c as k from fx_grid where ft >= 20),
reach as (select k, k as other from m union select a.k, n.k from reach a join m o on a.other = o.k join m n on abs(n.r - o.r) + abs(n.c - o.c) = 1)
select m.r, m.c, min(reach.other) as blob from m join reach on m.k = reach.k group by m.r, m.c""")
def _r7(spark, d):
    return grid_components(fixture(spark, d, "fx_grid").where("ft >= 20").select("r", "c"), 50)


@built("a11_blob_stats", """with recursive m as (select r, c, ft, r * 50 + c as k from fx_grid where ft >= 20),
reach as (select k, k as other from m union select a.k, n.k from reach a join m o on a.other = o.k join m n on abs(n.r - o.r) + abs(n.c - o.c) = 1),
b as (select k, min(other) as blob from reach group by k)
select b.blob, count(*) as cells, avg(m.ft) as ft, avg(m.r) as cr, avg(m.c) as cc from m join b on m.k = b.k group by b.blob having count(*) >= 2""")
def _a11(spark, d):
    grid = fixture(spark, d, "fx_grid").where("ft >= 20")
    blobs = grid_components(grid.select("r", "c"), 50).join(grid, ["r", "c"])
    return blobs.groupBy("blob").agg(F.count("*").alias("cells"), F.avg("ft").alias("ft"), F.avg("r").alias("cr"), F.avg("c").alias("cc")).where("cells >= 2")
