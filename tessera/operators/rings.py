"""Rings in order: outlines of raster blobs with their holes, and ways stitched end to end.

Both are arcs that each have one next arc; positions come by pointer jumping over all arcs, so no ring is held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept
from .raster import _walk, outlines


def ring_order(arcs: DataFrame) -> DataFrame:
    """``id, ring, pos`` of the arcs ``id, next`` that lie on closed rings: a ring is named by its smallest arc, which stands at 0. Arcs whose chain ends are left out."""
    walked = _walk(arcs)
    rings = walked.where("next is not null").select("id", F.col("least").alias("ring"))
    cut = kept(arcs.join(rings, "id").select("id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), "ring"), "rings")
    left = _walk(cut.select("id", "next")).select("id", "left").join(cut.select("id", "ring"), "id")
    size = left.groupBy("ring").agg(F.max("left").alias("n"))
    return left.join(size, "ring").select("id", "ring", (F.col("n") - F.col("left")).alias("pos"))


def blob_rings(blobs: DataFrame, width: int) -> DataFrame:
    """``blob, ring, pos, x, y, hole``: the corners of each blob's polygon, in order, from ``blobs(r, c, blob)`` on a raster of ``width`` columns.

    Shells run counter-clockwise, holes clockwise; ``pos`` counts sides of cells from the ring's lowest, leftmost corner. Where two cells of a blob meet at a
    corner only, the outline stays with the cell it follows, so rings touch there but don't cross.
    """
    e = outlines(blobs)
    heading = F.when(F.col("x1") > F.col("x0"), 0).when(F.col("y1") > F.col("y0"), 1).when(F.col("x1") < F.col("x0"), 2).otherwise(3)
    e = kept(e.withColumn("way", heading).withColumn("id", ((F.col("y0") * (width + 1) + F.col("x0")) * 4 + F.col("way")).cast("long")), "sides")
    then = e.select("blob", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.struct((F.col("way")).alias("way"), "id").alias("t"))
    # one side begins there, or two at a pinch: then the one to the left
    turn = F.pmod(F.col("t.way") - F.col("way"), F.lit(4))
    arcs = kept(e.join(then, ["blob", "x1", "y1"]).groupBy("id").agg(F.max_by("t.id", F.struct((turn == 1).alias("left"), "t.id")).alias("next"), F.max_by("t.way", F.struct((turn == 1).alias("left"), "t.id")).alias("then")), "arcs")
    placed = ring_order(arcs.select("id", "next")).join(e, "id")
    doubled = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0"))
    side = placed.groupBy("ring").agg((doubled < 0).alias("hole"))
    before = e.join(arcs, "id").select(F.col("next").alias("id"), (F.col("way") != F.col("then")).alias("corner"))
    corners = placed.join(before.where("corner").select("id"), "id")
    return corners.join(side, "ring").select("blob", "ring", "pos", F.col("x0").alias("x"), F.col("y0").alias("y"), "hole")


def stitched(ways: DataFrame) -> DataFrame:
    """``ring, pos, id, forward`` of ``ways(id, a, b)``: the ways of each closed ring in order, from the smallest id, which is walked from a to b.

    A way may join at either end of the next. Where other than two ends meet at a point, there is no telling which way goes on, so chains end
    there; ways of chains that don't close, and ways without an end, are left out (``unclosed`` has them). A way that ends where it begins is a ring.
    """
    known = ways.where("a is not null and b is not null").select("id", "a", "b")
    # an end's number: twice the id, one more for b; the arc that leaves an end has the same number
    ends = kept(known.select(F.explode(F.array(F.struct((F.col("id") * 2).alias("end"), F.col("a").alias("p")), F.struct((F.col("id") * 2 + 1).alias("end"), F.col("b").alias("p")))).alias("e")).select("e.*"), "ends")
    pairs = ends.groupBy("p").agg(F.min("end").alias("u"), F.max("end").alias("v"), F.count("*").alias("n")).where("n = 2")
    # an arc that arrives at an end goes on from the other one there; arriving at an end is leaving the way's other end
    across = lambda c: F.when(F.col(c) % 2 == 0, F.col(c) + 1).otherwise(F.col(c) - 1)
    joins = pairs.select(across("u").alias("id"), F.col("v").alias("next")).unionByName(pairs.select(across("v").alias("id"), F.col("u").alias("next")))
    arcs = kept(ends.select(F.col("end").alias("id")).join(joins, "id", "left"), "arcs")
    rings = ring_order(arcs).where("ring % 2 = 0")  # of a ring's two directions the one that walks its smallest way forward
    return rings.select((F.col("ring") / 2).cast("long").alias("ring"), "pos", F.floor(F.col("id") / 2).cast("long").alias("id"), (F.col("id") % 2 == 0).alias("forward"))


def unclosed(ways: DataFrame, rings: DataFrame) -> DataFrame:
    """The ways that ``rings``, made of them, leave out."""
    return ways.join(rings.select("id"), "id", "left_anti")


def ring_vertices(ways: DataFrame, rings: DataFrame) -> DataFrame:
    """``ring, pos, i, x, y``: the points of ``ways(id, points array<struct<x, y>>)`` along each ring, in order of ``pos, i``; points that two ways share come once."""
    each = rings.join(ways.select("id", "points"), "id")
    walked = F.when(F.col("forward"), F.col("points")).otherwise(F.reverse("points"))
    walked = F.slice(walked, F.lit(1), F.greatest(F.size("points") - 1, F.lit(0)))
    return each.select("ring", "pos", F.posexplode(walked).alias("i", "p")).select("ring", "pos", "i", "p.x", "p.y")
