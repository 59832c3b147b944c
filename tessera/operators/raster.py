"""Raster operators over long tables of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import kept


def ndwi(green: Column, nir: Column) -> Column:
    return F.when(green + nir > 0, (green - nir) / F.when(green + nir > 0, green + nir).otherwise(1.0))


def otsu_thresholds(values: DataFrame, group: str, value: str, bins: int = 512, least: int = 100, fallback: float = -0.25) -> DataFrame:
    """``group, threshold``: the bin centre of the largest between-class variance of each group's histogram.

    ``bins`` equal bins from minimum to maximum, the last closed, the first of equal variances. Groups of fewer than
    ``least`` values or of one value only take the fallback. Nulls are left out. Pixels meet only as bin counts, at most
    ``bins`` rows a group.
    """
    v = values.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    span = v.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    counts = v.join(span, group).where("hi > lo").groupBy(group, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width * bins).cast("int")).alias("bin")).agg(F.count("*").alias("m"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    w = Window.partitionBy(group).orderBy("bin")
    run = counts.withColumn("w0", F.sum("m").over(w)).withColumn("s0", F.sum(F.col("m") * (2 * F.col("bin") + 1)).over(w))
    whole = Window.partitionBy(group)
    run = run.withColumn("w", F.sum("m").over(whole)).withColumn("s", F.sum(F.col("m") * (2 * F.col("bin") + 1)).over(whole))
    # in whole numbers of half bins up to the last division, so the order of sums doesn't matter
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.when(F.col("w") > F.col("w0"), F.col("w") - F.col("w0"))
    run = run.withColumn("between", F.round(F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap, 3)).where("between is not null")
    centre = F.col("lo") + (F.col("hi") - F.col("lo")) * (2 * F.col("bin") + 1) / (2 * bins)
    best = run.groupBy(group).agg(F.max_by(centre, F.struct("between", -F.col("bin"))).alias("cut"))
    return span.join(best, group, "left").select(group, F.when(F.col("n") >= least, F.col("cut")).alias("cut")).select(group, F.coalesce("cut", F.lit(fallback)).alias("threshold"))


def window_values(cells: DataFrame, value: str, k: int, rows: int, cols: int) -> DataFrame:
    """``r, c, v``: every known value of each cell's (2k+1)-square window, edges replicated.

    Each cell is sent to the windows that use it, as often as clamping repeats it; null values don't count.
    """
    d = list(range(-k, k + 1))
    targets = cells.where(F.col(value).isNotNull()).select("r", "c", F.col(value).alias("v"))
    # a window at w reads the clamped w + d; solved for w
    out = targets.withColumn("dr", F.explode(F.array(*map(F.lit, d)))).withColumn("dc", F.explode(F.array(*map(F.lit, d))))
    span = lambda c, size: F.when(F.col(c) == 0, F.expr(f"sequence(0, greatest(0, -d{c}))")).when(F.col(c) == size - 1, F.expr(f"sequence(least({size - 1}, {size - 1} - d{c}), {size - 1})")).otherwise(F.expr(f"filter(array({c} - d{c}), w -> w >= 0 and w < {size})"))
    ints = out.withColumn("r", F.col("r").cast("int")).withColumn("c", F.col("c").cast("int"))
    placed = ints.withColumn("wr", F.explode(span("r", rows))).withColumn("wc", F.explode(span("c", cols)))
    ok = (F.greatest(F.lit(0), F.least(F.lit(rows - 1), F.col("wr") + F.col("dr"))) == F.col("r")) & (F.greatest(F.lit(0), F.least(F.lit(cols - 1), F.col("wc") + F.col("dc"))) == F.col("c"))
    return placed.where(ok).select(F.col("wr").alias("r"), F.col("wc").alias("c"), "v")


def window_mean_sd(cells: DataFrame, value: str, k: int, rows: int, cols: int) -> DataFrame:
    """``r, c, n, mean, sd`` over the (2k+1)-square window; the variance is floored at 1e-6, and nothing is told of windows known to 5 % or less."""
    agg = window_values(cells, value, k, rows, cols).groupBy("r", "c").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("sq"))
    enough = F.col("n") > 0.05 * (2 * k + 1) ** 2
    return agg.select("r", "c", "n", F.when(enough, F.col("mean")).alias("mean"), F.when(enough, F.sqrt(F.greatest(F.lit(1e-6), F.col("sq") - F.col("mean") * F.col("mean")))).alias("sd"))


def marching_squares(grid: DataFrame, levels: list[float]) -> DataFrame:
    """Contour segments ``level, r, c, x0, y0, x1, y1`` of cells whose four corners are known; corners at or above a level are inside.

    Corners meet by a self-join on neighbouring keys; saddles give two segments.
    """
    corner = lambda dr, dc, name: grid.select((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("ft").alias(name))
    cells = corner(0, 0, "a").join(corner(0, 1, "b"), ["r", "c"]).join(corner(1, 1, "d"), ["r", "c"]).join(corner(1, 0, "e"), ["r", "c"]).dropna()
    lv = cells.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    inside = lambda n: (F.col(n) >= F.col("level")).cast("int")
    lv = lv.withColumn("code", inside("a") + 2 * inside("b") + 4 * inside("d") + 8 * inside("e")).where("code not in (0, 15)")
    cut = lambda p, q: f"(level - {p}) / ({q} - {p})"
    point = {"S": ("c + " + cut("a", "b"), "r"), "E": ("c + 1", "r + " + cut("b", "d")), "N": ("c + " + cut("e", "d"), "r + 1"), "W": ("c", "r + " + cut("a", "e"))}
    # The edges that each corner code joins.
    joins = {1: "WS", 2: "SE", 3: "WE", 4: "EN", 5: "WSEN", 6: "SN", 7: "WN", 8: "NW", 9: "NS", 10: "SENW", 11: "NE", 12: "EW", 13: "ES", 14: "SW"}
    seg = lambda a, b: "named_struct('x0', cast({} as double), 'y0', cast({} as double), 'x1', cast({} as double), 'y1', cast({} as double))".format(*point[a], *point[b])
    cases = " ".join(f"when {k} then array({', '.join(seg(v[i], v[i + 1]) for i in range(0, len(v), 2))})" for k, v in joins.items())
    return lv.withColumn("s", F.explode(F.expr(f"case code {cases} end"))).select("level", "r", "c", "s.x0", "s.y0", "s.x1", "s.y1")


def gradient(cells: DataFrame, value: str) -> DataFrame:
    """``r, c, g``: the gradient's magnitude, central differences inside, one-sided at the grid's borders; null beside an unknown value."""

    def slope(part: str, along: str):
        w = Window.partitionBy(part).orderBy(along)
        here = F.struct(F.col(along).alias("at"), F.col(value).alias("v"))
        after, before = F.lead(here).over(w), F.lag(here).over(w)
        has_after, has_before = F.coalesce(after["at"] == F.col(along) + 1, F.lit(False)), F.coalesce(before["at"] == F.col(along) - 1, F.lit(False))
        return F.when(has_after & has_before, (after["v"] - before["v"]) / 2).when(has_after, after["v"] - F.col(value)).when(has_before, F.col(value) - before["v"])

    return cells.withColumn("_dc", slope("r", "c")).withColumn("_dr", slope("c", "r")).select("r", "c", F.sqrt(F.col("_dc") ** 2 + F.col("_dr") ** 2).alias("g")).where("g is not null")


def smooth(cells: DataFrame, value: str, sigma: float) -> DataFrame:
    """``r, c, v``: a Gaussian of the known values, cut at four sigmas, borders mirrored; weights are those of the known cells in reach.

    Separable: each pass sends a cell to 2 * radius + 1 places along one axis, and places are combining sums.
    """
    radius = int(4 * sigma + 0.5)
    size = cells.agg((F.max("r") + 1).alias("_rows"), (F.max("c") + 1).alias("_cols"))
    now = cells.where(F.col(value).isNotNull()).select("r", "c", F.col(value).alias("_s"), F.lit(1.0).alias("_w")).join(F.broadcast(size))  # one row
    for axis, length, other in (("r", "_rows", "c"), ("c", "_cols", "r")):
        seen = F.explode(F.array(F.col(axis), -1 - F.col(axis), 2 * F.col(length) - 1 - F.col(axis)))  # itself and its two mirror images
        sent = now.withColumn("_p", seen).where(F.col("_p").between(-radius, F.col(length) - 1 + radius))
        sent = sent.withColumn("_to", F.explode(F.expr(f"sequence(greatest(0L, _p - {radius}), least({length} - 1, _p + {radius}))")))
        g = F.exp(-((F.col("_to") - F.col("_p")) ** 2) / (2 * sigma * sigma))
        now = sent.groupBy(F.col("_to").alias(axis), other, "_rows", "_cols").agg(F.sum(F.col("_s") * g).alias("_s"), F.sum(F.col("_w") * g).alias("_w"))
    return now.select("r", "c", (F.col("_s") / F.col("_w")).alias("v"))


def outlines(blobs: DataFrame) -> DataFrame:
    """Directed boundary edges ``blob, x0, y0, x1, y1`` of ``blobs(r, c, blob)``, the blob on the left; an edge where the neighbour is of another blob or none."""
    sides = [(0, 1, (1, 0), (1, 1)), (0, -1, (0, 1), (0, 0)), (1, 0, (1, 1), (0, 1)), (-1, 0, (0, 0), (1, 0))]  # neighbour's row and column, the edge's ends as x, y
    each = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(a[0]).alias("ax"), F.lit(a[1]).alias("ay"), F.lit(b[0]).alias("bx"), F.lit(b[1]).alias("by")) for dr, dc, a, b in sides]))
    sent = blobs.withColumn("s", each).select("blob", "r", "c", (F.col("r") + F.col("s.dr")).alias("nr"), (F.col("c") + F.col("s.dc")).alias("nc"), "s")
    same = blobs.select("blob", F.col("r").alias("nr"), F.col("c").alias("nc"))
    return sent.join(same, ["blob", "nr", "nc"], "left_anti").select("blob", (F.col("c") + F.col("s.ax")).alias("x0"), (F.col("r") + F.col("s.ay")).alias("y0"), (F.col("c") + F.col("s.bx")).alias("x1"), (F.col("r") + F.col("s.by")).alias("y1"))


def equalised(pixels: DataFrame, group: str, value: str, knots: int = 129, blend: float = 0.5) -> DataFrame:
    """Adds ``eq`` (rank by the group's quantile knots, linear between them) and ``mixed`` (blended with a stretch to the 99.9th percentile).

    A group is summed up as an array of knots, made monotone by a running maximum; rows meet only that array.
    """
    at = [i / (knots - 1) for i in range(knots)]
    k = pixels.groupBy(group).agg(F.percentile(value, F.array(*map(F.lit, at))).alias("_k"), F.percentile(value, F.lit(0.999)).alias("_top"))
    k = k.withColumn("_k", F.transform("_k", lambda x, i: F.array_max(F.slice("_k", 1, i + 1))))
    v = F.col(value)
    below = F.size(F.filter("_k", lambda x: x <= v))  # knots up to the value
    low, high = F.element_at("_k", F.greatest(below, F.lit(1))), F.element_at("_k", F.least(below + 1, F.lit(knots)))
    eq = F.when(below == 0, 0.0).when(below >= knots, 1.0).otherwise((below - 1 + (v - low) / F.when(high > low, high - low).otherwise(1.0)) / (knots - 1))
    out = pixels.join(F.broadcast(k), group).withColumn("eq", eq)  # an array for each group
    return out.withColumn("mixed", blend * F.col("eq") + (1 - blend) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.greatest(F.col("_top"), F.lit(1e-6))))).drop("_k", "_top")


def polylines(segments: DataFrame, keys: float) -> DataFrame:
    """``level, line, pos, x, y, step, closed``: contour segments chained to lines of more than two points, in order.

    Ends within 1 / ``keys`` (after rounding) are one point; ``step`` is the distance from the point before, null at the first. Segments have the
    inside on their right, so each leads to one next; where several begin at a point, the one of the smallest cell is next and the others begin
    lines of their own. Positions come by pointer jumping over all segments: rounds grow with the logarithm of the longest line,
    each written out, and no line is held in one task. A closed line begins at its smallest segment and ends where it began.
    """
    point = lambda x, y: F.concat_ws(":", "level", F.round(F.col(x) * keys).cast("long"), F.round(F.col(y) * keys).cast("long"))
    s = segments.withColumn("a", point("x0", "y0")).withColumn("b", point("x1", "y1")).where("a <> b")
    s = s.withColumn("_of_a", F.row_number().over(Window.partitionBy("a").orderBy("r", "c", "b"))).withColumn("_of_b", F.row_number().over(Window.partitionBy("b").orderBy("r", "c", "a")))
    s = kept(s.withColumn("id", F.concat_ws("|", "a", "b", "_of_a")), "segments")
    then = s.where("_of_a = 1").select(F.col("a").alias("b"), F.col("id").alias("next"))
    # the first that arrives goes on; what arrives later ends there
    now = kept(s.join(then, "b", "left").select("id", F.when(F.col("_of_b") == 1, F.col("next")).alias("next")), "chains")
    walked = _walk(now)
    rings = walked.where("next is not null").select("id", F.col("least").alias("line"))
    cut = kept(now.join(rings, "id").select("id", F.when(F.col("next") != F.col("line"), F.col("next")).alias("next"), "line"), "rings")
    round_ = _walk(cut.select("id", "next")).join(cut.select("id", "line"), "id").select("id", "line", "left", F.lit(True).alias("closed"))
    placed = walked.where("next is null").select("id", F.col("last").alias("line"), "left", F.lit(False).alias("closed")).unionByName(round_)
    size = placed.groupBy("line").agg((F.max("left") + 1).alias("n")).where("n > 1")
    placed = placed.join(size, "line").withColumn("pos", F.col("n") - F.col("left")).join(s, "id")
    ends = placed.select("level", "line", "pos", F.col("x1").alias("x"), F.col("y1").alias("y"), F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("step"), "closed")
    begins = placed.where("pos = 1").select("level", "line", F.lit(0).cast("long").alias("pos"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(None).cast("double").alias("step"), "closed")
    return ends.unionByName(begins)


def _walk(chains: DataFrame) -> DataFrame:
    """``id, next, last, left, least`` of ``chains(id, next)``, of which no two have one next: the last of each chain, the steps to it and, for
    those that go round, where next isn't null, the smallest id."""
    now = kept(chains.select("id", "next", F.coalesce("next", "id").alias("last"), F.col("next").isNotNull().cast("long").alias("left"), F.col("id").alias("least")), "walk")
    mark = None
    while True:
        far = now.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("last").alias("far_last"), F.col("left").alias("far_left"), F.col("least").alias("far_least"))
        # what has arrived keeps its place
        now = kept(now.join(far, "next", "left").select("id", F.col("far").alias("next"), F.coalesce("far_last", "last").alias("last"), (F.col("left") + F.coalesce("far_left", F.lit(0))).alias("left"), F.least("least", F.coalesce("far_least", "least")).alias("least")), "walk")
        seen = now.agg(F.count("next"), F.sum(F.xxhash64("least").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now
        mark = seen
