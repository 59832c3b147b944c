"""Polygon operators over edge tables: a polygon is its rings' edges, so containment and area are sums over joined edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spatial import segment_distance


def edges(spark: SparkSession, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """``ring, x0, y0, x1, y1`` of closed rings; the first is the shell, the others are holes. As small as the polygon's text."""
    rows = [(i, *ring[j], *ring[(j + 1) % len(ring)]) for i, ring in enumerate(rings) for j in range(len(ring))]
    return spark.createDataFrame([(i, *map(float, e)) for i, *e in rows], "ring int, x0 double, y0 double, x1 double, y1 double")


#: Where in a row of cells its scan line lies: no fraction of common coordinates.
LINE = 0.41421356237309515


def _filed(polygon: DataFrame) -> tuple[DataFrame, float, float, float] | None:
    """The edges with their rows of cells ``row``, and the cells' side and corner: cells are about two edges wide, a ten-thousandth of the polygon at least."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    low = lambda c: F.min(F.least(c + "0", c + "1"))
    high = lambda c: F.max(F.greatest(c + "0", c + "1"))
    n, total, x0, x1, y0, y1 = polygon.agg(F.count("*"), F.sum(length), low("x"), high("x"), low("y"), high("y")).first()
    if not n:
        return None
    side = max(2 * total / n, max(x1 - x0, y1 - y0) / 10_000) or 1.0
    row = lambda v: F.floor((v - y0) / side)
    rows = F.sequence(row(F.least("y0", "y1")), row(F.greatest("y0", "y1")))
    return polygon.select("x0", "y0", "x1", "y1", F.explode(rows).alias("row")), side, x0, y0


def _at(y: Column) -> Column:
    """Where the edge meets the level ``y``."""
    return F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))


def inside(points: DataFrame, polygon: DataFrame) -> DataFrame:
    """``id, inside`` of ``points(id, x, y)``: even-odd over all edges ``x0, y0, x1, y1`` of ``polygon``, however many.

    Every row of cells has a scan line; the crossings of the line are summed up cell by cell from the right, so a cell knows how many lie beyond
    it. From there a point needs only the edges of its own cell: those that cross the line to its right, and those between the line and itself. A point on
    an edge counts what lies beyond it to the right and just above its level (an edge's lower end is its own, its upper end isn't); points without a place are
    outside. Repeated ids must have equal places.
    """
    filed = _filed(polygon)
    if filed is None:
        return points.select("id", F.lit(False).alias("inside"))
    edges_, side, left, bottom = filed
    line = F.lit(bottom) + (F.col("row") + LINE) * side
    col = lambda v: F.floor((v - left) / side)
    on_line = (F.col("y0") > line) != (F.col("y1") > line)
    crossed = edges_.where(on_line).select("row", col(_at(line)).alias("col")).groupBy("row", "col").agg(F.count("*").alias("n"))
    w = Window.partitionBy("row").orderBy(F.desc("col")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.lag("col").over(Window.partitionBy("row").orderBy("col"))
    # cells after the crossing before this one and up to it see this and all beyond
    spans = crossed.select("row", "col", F.sum("n").over(w).alias("beyond"), (F.coalesce(upto + 1, F.lit(0))).alias("from"))
    place = points.where("x is not null and y is not null").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    place = place.withColumn("row", F.floor((F.col("y") - bottom) / side)).withColumn("col", F.greatest(F.lit(-1), col(F.col("x"))))
    cells = place.select("row", "col").distinct()
    # crossings strictly beyond a cell: of the first span that begins after it
    seen = cells.join(spans.withColumnRenamed("col", "to"), "row").where("to > col").groupBy("row", "col").agg(F.max("beyond").alias("beyond"))
    # an edge's columns within its row: where it enters and leaves
    foot, top = F.lit(bottom) + F.col("row") * side, F.lit(bottom) + (F.col("row") + 1) * side
    clipped = lambda y: F.when(F.col("y0") == F.col("y1"), F.lit(None)).otherwise(_at(F.greatest(foot, F.least(top, y))))
    ends = F.array_compact(F.array(clipped(F.col("y0")), clipped(F.col("y1")), F.when(F.col("y0") == F.col("y1"), F.col("x0")), F.when(F.col("y0") == F.col("y1"), F.col("x1"))))
    near = edges_.withColumn("col", F.explode(F.sequence(col(F.array_min(ends) - side * 1e-9), col(F.array_max(ends) + side * 1e-9))))
    x, y = F.col("x"), F.col("y")
    right = on_line & (_at(line) > x) & (col(_at(line)) == F.col("col"))
    # whether an edge lies above the point is asked by where it meets the point's own level, so that ties fall as in the plain sum over edges
    beside, rises = x < _at(y), (F.col("y1") > F.col("y0")) == (F.col("x1") > F.col("x0"))
    above = F.when(F.col("y0") == F.col("y1"), F.col("y0") > y).otherwise(beside != rises)
    height = F.col("y0") + (x - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0))
    between = ((F.col("x0") > x) != (F.col("x1") > x)) & (above != (height > line))
    own = place.join(near, ["row", "col"]).groupBy("id").agg((F.count_if(right) + F.count_if(between)).alias("own"))
    out = points.select("id").join(place, "id", "left").join(seen, ["row", "col"], "left").join(own, "id", "left")
    return out.select("id", ((F.coalesce("beyond", F.lit(0)) + F.coalesce("own", F.lit(0))) % 2 == 1).alias("inside"))


def shore_distance(points: DataFrame, polygon: DataFrame) -> DataFrame:
    """``id, shore_m`` of ``points(id, x, y)``: how far the nearest edge is, at any distance; points without a place have no row."""
    from .spatial import Pyramid, opened

    e = polygon.select("x0", "y0", "x1", "y1", F.monotonically_increasing_id().alias("id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    for c in "xy":
        e = e.withColumn("l" + c, F.least(c + "0", c + "1")).withColumn("h" + c, F.greatest(c + "0", c + "1"))
    tree = Pyramid(e, 8, boxes=("lx", "hx", "ly", "hy"))
    if tree.empty:
        return points.select("id", F.lit(None).cast("double").alias("shore_m")).limit(0)
    met = opened(points.select("id", "x", "y"), tree).join(tree.points.select("level", "cx", "cy", "x0", "y0", "x1", "y1"), ["level", "cx", "cy"])
    d = segment_distance(F.col("l_x"), F.col("l_y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return met.groupBy(F.col("l_id").alias("id")).agg(F.min(d).alias("shore_m"))


def inside_and_shore(points: DataFrame, polygon: DataFrame) -> DataFrame:
    """``id, inside, shore_m`` of points: even-odd containment over all rings, and the distance to the nearest edge (null without a place)."""
    return inside(points, polygon).join(shore_distance(points, polygon), "id", "left")


def raster_mask(polygon: DataFrame, step: float) -> DataFrame:
    """``r, c``: the nodes (``c * step``, ``r * step``) inside the polygon, made row by row from the stretches between a row's crossings."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = polygon.withColumn("r", F.explode(F.sequence(F.floor(low / step), F.ceil(high / step))))
    level = F.col("r") * step
    met = rows.where((F.col("y0") > level) != (F.col("y1") > level)).select("r", _at(level).alias("x"))
    w = Window.partitionBy("r").orderBy("x")
    pairs = met.select("r", F.col("x").alias("from"), F.lead("x").over(w).alias("to"), F.row_number().over(w).alias("k")).where("k % 2 = 1 and to is not null")
    first, last = F.ceil(F.col("from") / step), F.ceil(F.col("to") / step) - 1
    return pairs.where(first <= last).select("r", F.explode(F.sequence(first, last)).alias("c")).distinct()


def eroded(polygon: DataFrame, step: float, shore: float) -> DataFrame:
    """``r, c, far``: the polygon's nodes, and whether they lie ``shore`` or more from its edges: the mask of the polygon less a strip along the shore."""
    nodes = raster_mask(polygon, step)
    points = nodes.select(F.struct("r", "c").alias("id"), (F.col("c") * step).alias("x"), (F.col("r") * step).alias("y"))
    return shore_distance(points, polygon).select("id.r", "id.c", (F.col("shore_m") >= shore).alias("far"))


def ring_edges(vertices: DataFrame) -> DataFrame:
    """``id, ring, seq, x0, y0, x1, y1`` of closed rings from ``vertices(id, ring, seq, x, y)``; ring 0 is the shell, others are holes."""
    w = Window.partitionBy("id", "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    then = F.coalesce(F.lead(F.struct("x", "y")).over(w), F.first(F.struct("x", "y")).over(whole))
    return vertices.withColumn("_t", then).select("id", "ring", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("_t.x").alias("x1"), F.col("_t.y").alias("y1"))


def measures(edges_: DataFrame) -> DataFrame:
    """``id, area, perimeter, cx, cy`` of polygons: shoelace area and centroid of the shell less the holes, the shell's length."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    ring = edges_.groupBy("id", "ring").agg(F.sum(cross).alias("a"), F.sum((F.col("x0") + F.col("x1")) * cross).alias("mx"), F.sum((F.col("y0") + F.col("y1")) * cross).alias("my"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("m"))
    sign = F.when(F.col("ring") == 0, F.signum("a")).otherwise(-F.signum("a"))
    total = ring.groupBy("id").agg(F.sum(sign * F.col("a")).alias("a"), F.sum(sign * F.col("mx")).alias("mx"), F.sum(sign * F.col("my")).alias("my"), F.max(F.when(F.col("ring") == 0, F.col("m"))).alias("perimeter"))
    return total.select("id", (F.col("a") / 2).alias("area"), "perimeter", (F.col("mx") / (3 * F.col("a"))).alias("cx"), (F.col("my") / (3 * F.col("a"))).alias("cy"))


def area_in_box(edges_: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """``id, area`` of each polygon's part in the box: every edge's integral of its height over the box's floor, cut at the box's sides, signed by its direction."""
    clip = lambda v, low, high: F.greatest(low, F.least(high, v))
    xa, xb = clip(F.col("x0"), x0, x1), clip(F.col("x1"), x0, x1)
    slope = (F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0))
    ya, yb = F.col("y0") + slope * (xa - F.col("x0")), F.col("y0") + slope * (xb - F.col("x0"))
    above = lambda y: F.when(y <= y0, 0.0).when(y <= y1, (y - y0) * (y - y0) / 2).otherwise((y1 - y0) * (y1 - y0) / 2 + (y - y1) * (y1 - y0))
    height = F.when(F.abs(yb - ya) < 1e-9, clip(ya, y0, y1) - y0).otherwise((above(yb) - above(ya)) / F.when(F.abs(yb - ya) < 1e-9, 1.0).otherwise(yb - ya))
    part = F.coalesce((xb - xa) * height, F.lit(0.0))
    ring = edges_.groupBy("id", "ring").agg(F.abs(F.sum(part)).alias("a"))
    return ring.groupBy("id").agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))


def polyline(spark: SparkSession, points: list[tuple[float, float]]) -> DataFrame:
    """``id, seq, x, y`` of one line, as small as its text."""
    return spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, seq int, x double, y double")


def densified(vertices: DataFrame, step: float) -> DataFrame:
    """``id, k, x, y``: max(2, length / step) + 1 points evenly along each line of ``vertices(id, seq, x, y)``, both ends included.

    A point at normalised length k / n lies on the segment whose stretch of length holds it; segments make their own points.
    """
    w = Window.partitionBy("id").orderBy("seq")
    s = vertices.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).where("x1 is not null").withColumn("m", F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")))
    s = s.withColumn("before", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).join(s.groupBy("id").agg(F.sum("m").alias("total"), F.max("seq").alias("last")), "id")
    s = s.withColumn("n", F.greatest(F.lit(2), F.floor(F.col("total") / step).cast("int"))).withColumn("unit", F.col("total") / F.col("n"))
    first, after = F.ceil(F.col("before") / F.col("unit") - 1e-9).cast("int"), F.ceil((F.col("before") + F.col("m")) / F.col("unit") - 1e-9).cast("int") - 1
    own = F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: (i >= first) & ((i <= after) | (F.col("seq") == F.col("last"))))
    k = s.withColumn("k", F.explode(own))
    along = (F.col("k") * F.col("unit") - F.col("before")) / F.col("m")
    return k.select("id", "k", (F.col("x") + (F.col("x1") - F.col("x")) * along).alias("x"), (F.col("y") + (F.col("y1") - F.col("y")) * along).alias("y"))


def placed_along(vertices: DataFrame, every: float) -> DataFrame:
    """``id, k, x, y``: points each ``every`` of length along the lines of ``vertices(id, seq, x, y)``, from the start and short of the end.

    A segment places those whose length falls on it, so a line's points are made where its segments are. Segments without length place none.
    """
    w = Window.partitionBy("id").orderBy("seq")
    s = vertices.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).where("x1 is not null").withColumn("m", F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")))
    s = s.withColumn("before", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where("m > 0")
    first, after = F.ceil(F.col("before") / every).cast("int"), F.ceil((F.col("before") + F.col("m")) / every).cast("int")
    k = s.where(after > first).withColumn("k", F.explode(F.sequence(first, after - 1)))
    along = (F.col("k") * every - F.col("before")) / F.col("m")
    return k.select("id", "k", (F.col("x") + (F.col("x1") - F.col("x")) * along).alias("x"), (F.col("y") + (F.col("y1") - F.col("y")) * along).alias("y"))


def representative_points(edges_: DataFrame) -> DataFrame:
    """``id, x, y``: a point inside each polygon, the middle of the widest stretch that half its shell's height has inside it; holes are left out."""
    middle = edges_.where("ring = 0").groupBy("id").agg(((F.min("y0") + F.max("y0")) / 2).alias("y"))
    met = edges_.join(middle, "id").where((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y")))
    met = met.select("id", "y", (F.col("x0") + (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).alias("x"))
    w = Window.partitionBy("id").orderBy("x")
    stretch = met.withColumn("to", F.lead("x").over(w)).withColumn("n", F.row_number().over(w)).where("n % 2 = 1 and to is not null")
    return stretch.groupBy("id").agg(F.max_by((F.col("x") + F.col("to")) / 2, F.struct(F.col("to") - F.col("x"), -F.col("x"))).alias("x"), F.first("y").alias("y"))


def meets_box(edges_: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """``id, meets``: whether each polygon and the closed box share a point: an edge runs through the box, or the box's corner lies inside."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def stretch(d: Column, a: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """The part of the edge, as shares of its length, that lies between the two."""
        one, two = (low - a) / F.nullif(d, F.lit(0.0)), (high - a) / F.nullif(d, F.lit(0.0))
        level = F.when((a >= low) & (a <= high), 0.0).otherwise(2.0)
        return F.when(d == 0, level).otherwise(F.least(one, two)), F.when(d == 0, 1.0).otherwise(F.greatest(one, two))

    (xa, xb), (ya, yb) = stretch(dx, F.col("x0"), x0, x1), stretch(dy, F.col("y0"), y0, y1)
    through = F.greatest(xa, ya, F.lit(0.0)) <= F.least(xb, yb, F.lit(1.0))
    crosses = ((F.col("y0") > y0) != (F.col("y1") > y0)) & (x0 < F.col("x0") + (y0 - F.col("y0")) * dx / F.nullif(dy, F.lit(0.0)))
    return edges_.groupBy("id").agg((F.bool_or(through) | (F.sum(F.coalesce(crosses, F.lit(False)).cast("int")) % 2 == 1)).alias("meets"))
