"""Unions of boxes: the parts of sides that no other box covers, chained to rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import kept
from .rings import ring_order


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def _open_cells(boxes: DataFrame, size: float) -> DataFrame:
    """``cx, cy``: the cells that boxes touch and that lie strictly inside none of them."""
    span = lambda low, high: F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))
    touched = boxes.select("x0", "x1", "y0", "y1", F.explode(span("x0", "x1")).alias("cx")).select("x0", "x1", "y0", "y1", "cx", F.explode(span("y0", "y1")).alias("cy"))
    held = lambda low, high, c: (F.col(low) < F.col(c) * size) & (F.col(high) > (F.col(c) + 1) * size)
    whole = F.max(held("x0", "x1", "cx") & held("y0", "y1", "cy"))
    return touched.groupBy("cx", "cy").agg(whole.alias("whole")).where("not whole").select("cx", "cy")


def bare_sides(boxes: DataFrame) -> DataFrame:
    """``way, x0, y0, x1, y1``: the pieces of the sides of ``boxes(x0, y0, x1, y1)`` that bound their union, with the union on the left; ``way`` is 0 east, 1 north, 2 west, 3 south.

    A side meets the boxes that share a cell with it; boxes on its outer side cover it where they overlap, and of sides that lie on each other the first
    box's stands. So a piece is found from its neighbourhood alone. A cell that lies inside one box has no piece, so where boxes crowd only the cells
    along the union's rim are looked at. Boxes without extent or with unknown sides are left out, equal ones are one.
    """
    names = ["x0", "y0", "x1", "y1"]
    b = kept(boxes.select(*[F.col(c).cast("double").alias(c) for c in names]).where("x0 < x1 and y0 < y1").distinct().withColumn("key", F.struct(*names)), "boxes")
    extent = lambda low, high: F.max(high) - F.min(low)
    mean, n, wide, tall = b.agg(F.avg((F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")) / 2), F.count("*"), extent("x0", "x1"), extent("y0", "y1")).first()
    mean = mean or 1.0
    # how often the boxes cover their extent: the more, the smaller the cells, so that most lie inside a box
    layers = n * mean * mean / max((wide or 1.0) * (tall or 1.0), mean * mean)
    size = 2.0 ** round(math.log2(mean * 1.5 if layers < 8 else mean / 8))  # by a power of two cells divide without rounding
    opened = kept(_open_cells(b, size), "open")
    side = lambda way, at, low, high: F.struct(F.lit(way).alias("way"), F.col(at).alias("at"), F.col(low).alias("low"), F.col(high).alias("high"))
    sides = b.select("key", F.explode(F.array(side(0, "y0", "x0", "x1"), side(1, "x1", "y0", "y1"), side(2, "y1", "x0", "x1"), side(3, "x0", "y0", "y1"))).alias("s")).select("key", "s.*")
    across = F.col("way") % 2 == 0
    reach = lambda end, along: F.when(across == along, F.col(end)).otherwise(F.col("at"))
    filed = sides.withColumn("cx", _cells(reach("low", True), reach("high", True), size)).withColumn("cy", _cells(reach("low", False), reach("high", False), size))
    filed = filed.join(opened, ["cx", "cy"])
    # a side's stretch within its cell; stretches begin and end at the same places for all sides
    cell = F.when(across, F.col("cx")).otherwise(F.col("cy"))
    filed = filed.withColumn("low", F.greatest("low", cell * size)).withColumn("high", F.least("high", (cell + 1) * size)).where("low < high")
    filed = kept(filed.withColumn("piece", F.struct("key", "way", "at", "low")), "sides")
    other = b.select(F.col("key").alias("o"), *[F.col(c).alias("o" + c) for c in names]).withColumn("cx", _cells(F.col("ox0"), F.col("ox1"), size)).withColumn("cy", _cells(F.col("oy0"), F.col("oy1"), size))
    met = filed.join(other.join(opened, ["cx", "cy"], "left_semi"), ["cx", "cy"]).where("key <> o")
    near = F.when(across, F.col("oy0")).otherwise(F.col("ox0"))  # the other box across the side, and along it
    far = F.when(across, F.col("oy1")).otherwise(F.col("ox1"))
    low, high = F.when(across, F.col("ox0")).otherwise(F.col("oy0")), F.when(across, F.col("ox1")).otherwise(F.col("oy1"))
    at, first = F.col("at"), F.col("o") < F.col("key")
    upper = F.col("way").isin(1, 2)  # the union ends at the box's high side
    covers = F.when(upper, ((near <= at) & (at < far)) | ((far == at) & first)).otherwise(((near < at) & (at <= far)) | ((near == at) & first))
    hidden = met.where(covers & (low < F.col("high")) & (high > F.col("low"))).select("piece", "way", "at", "low", "high", F.greatest(low, F.col("low")).alias("a"), F.least(high, F.col("high")).alias("b"))
    hidden = kept(hidden, "hidden")
    gone = hidden.where("a = low and b = high").select("piece").distinct()  # one box hides them
    ends = filed.select("piece", "way", "at", "low", "high", F.col("high").alias("a"), F.col("high").alias("b"))
    w = Window.partitionBy("piece").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    bare = hidden.unionByName(ends).join(gone, "piece", "left_anti").withColumn("from", F.coalesce(F.max("b").over(w), F.col("low"))).where("from < a")
    begin, end = F.when(F.col("way") < 2, F.col("from")).otherwise(F.col("a")), F.when(F.col("way") < 2, F.col("a")).otherwise(F.col("from"))
    x = lambda v: F.when(across, v).otherwise(at)
    y = lambda v: F.when(across, at).otherwise(v)
    return bare.select("way", x(begin).alias("x0"), y(begin).alias("y0"), x(end).alias("x1"), y(end).alias("y1"))


def box_union(boxes: DataFrame) -> DataFrame:
    """``ring, pos, x, y, hole``: the corners of the union's rings in order, shells counter-clockwise and holes clockwise.

    ``pos`` counts pieces from the ring's first one, so it leaves gaps where a piece goes on straight. Rings that meet at a corner touch there and don't cross.
    """
    pieces = kept(bare_sides(boxes).withColumn("id", F.concat_ws("|", "x0", "y0", "way")), "pieces")
    then = pieces.select(F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.struct("way", "id").alias("t"))
    left = (F.pmod(F.col("t.way") - F.col("way"), F.lit(4)) == 1).alias("left")
    arcs = pieces.join(then, ["x1", "y1"]).groupBy("id").agg(F.max_by("t", F.struct(left, F.col("t.id"))).alias("t"))
    arcs = kept(arcs.select("id", F.col("t.id").alias("next"), F.col("t.way").alias("then")), "arcs")
    placed = ring_order(arcs.select("id", "next")).join(pieces, "id")
    side = placed.groupBy("ring").agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) < 0).alias("hole"))
    turned = pieces.select("id", "way").join(arcs, "id").where("way <> then").select(F.col("next").alias("id"))
    return placed.join(turned, "id").join(side, "ring").select("ring", "pos", F.col("x0").alias("x"), F.col("y0").alias("y"), "hole")
