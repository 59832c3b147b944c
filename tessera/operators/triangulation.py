"""Delaunay triangulation of scattered points by tiles, and the linear surface over it.

Tiles are the undivided cells of a ``Pyramid``. A tile's points find their stars (the triangles around them) among the points of the nine cells
around it. A triangle stands if the part of its circumcircle inside the convex hull of all points lies in those cells: no point beyond them can be
in it. Points with a triangle that doesn't stand go to the next round with cells of four times the side; most are settled in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept
from .spatial import Pyramid

Point = tuple[float, float]


def _turn(a: Point, b: Point, c: Point) -> float:
    """Positive where a, b, c turn left; exact where the rounded value can't be trusted."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    if abs(left - right) > 1e-12 * (abs(left) + abs(right)):
        return left - right
    ax, ay, bx, by, cx, cy = (Fraction(v) for v in (*a, *b, *c))
    return float((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def convex_hull(points: list[Point]) -> list[Point]:
    """Corners in counter-clockwise order, without those on a side."""
    rest = sorted(set(points))
    if len(rest) < 3:
        return rest
    chains = []
    for row in (rest, rest[::-1]):
        chain: list[Point] = []
        for p in row:
            while len(chain) > 1 and _turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return chains[0] + chains[1]


def hull_of(points: DataFrame, most: int = 1_000_000) -> list[Point]:
    """The hull of ``points(x, y)``: each task sends the corners of its own; more than ``most`` of them raise."""

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corners: list[Point] = []
        for f in frames:
            corners = convex_hull([*corners, *zip(f["x"].tolist(), f["y"].tolist(), strict=True)])
        yield pd.DataFrame(corners, columns=["x", "y"])

    found = points.select("x", "y").mapInPandas(own, "x double, y double").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("the hulls of the tasks have more corners than the driver should hold")
    return convex_hull([(r.x, r.y) for r in found])


def _in_circle(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    """Whether d lies in the circle of the left turn a, b, c (each x, y, id). Of four points on one circle the one with the smallest id counts as lifted
    off it, so every set of points has one triangulation."""
    rows = [[Fraction(p[0]) - Fraction(d[0]), Fraction(p[1]) - Fraction(d[1])] for p in (a, b, c)]
    (ax, ay), (bx, by), (cx, cy) = rows
    det = (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx)
    if det:
        return det > 0
    first = min((a, b, c, d), key=lambda p: p[2])
    if first is d:
        return False
    other = [d if p is first else p for p in (a, b, c)]
    return _turn(*[p[:2] for p in other]) > 0


class Star:
    """Finds the triangles around points among those at hand, and whether points elsewhere could change them."""

    def __init__(self, xs: np.ndarray, ys: np.ndarray, ids: np.ndarray, box: tuple[float, float, float, float], hull: list[Point]):
        self.xs, self.ys, self.ids, self.box, self.hull = xs, ys, ids, box, hull
        self.hx, self.hy = np.array([p[0] for p in hull]), np.array([p[1] for p in hull])

    def _point(self, i: int) -> tuple:
        return self.xs[i], self.ys[i], self.ids[i]

    def _apex(self, p: int, q: int, side: int) -> int | None:
        """The point on the left (side 1) or right (-1) of p to q whose circle with them holds no other there."""
        dx, dy, ex, ey = self.xs - self.xs[p], self.ys - self.ys[p], self.xs - self.xs[q], self.ys - self.ys[q]
        vx, vy = self.xs[q] - self.xs[p], self.ys[q] - self.ys[p]
        one, two = vx * dy, vy * dx
        turn = side * (one - two)
        near = np.abs(turn) <= 1e-12 * (np.abs(one) + np.abs(two))
        for i in np.flatnonzero(near):
            turn[i] = side * _turn(self._point(p)[:2], self._point(q)[:2], self._point(i)[:2])
        at = np.flatnonzero(turn > 0)
        if not len(at):
            return None
        cot = (dx[at] * ex[at] + dy[at] * ey[at]) / turn[at]
        low = cot.min()
        best = at[cot <= low + 1e-9 * (1 + abs(low))]
        r = int(best[0])
        for s in best[1:].tolist():
            a, b = (p, q) if side > 0 else (q, p)
            if _in_circle(self._point(a), self._point(b), self._point(r), self._point(s)):
                r = s
        return r

    def _stands(self, a: int, b: int, c: int) -> bool:
        """Whether the circle's part inside the hull lies within the box."""
        (ax, ay), (bx, by), (cx, cy) = ((self.xs[i], self.ys[i]) for i in (a, b, c))
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if d == 0:
            return False
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        r, x, y = math.hypot(ux, uy) * (1 + 1e-9), ax + ux, ay + uy
        x0, x1, y0, y1 = self.box
        if x - r >= x0 and x + r < x1 and y - r >= y0 and y + r < y1:
            return True
        # the part's farthest points: ends of the circle inside the hull, corners inside the circle, sides that meet it
        px, py = [x - r, x + r, x, x], [y, y, y - r, y + r]
        hx, hy, nx, ny = self.hx, self.hy, np.roll(self.hx, -1), np.roll(self.hy, -1)
        held = [bool((((nx - hx) * (v - hy) - (ny - hy) * (u - hx)) >= 0).all()) for u, v in zip(px, py, strict=True)]
        xs, ys = [u for u, h in zip(px, held, strict=True) if h], [v for v, h in zip(py, held, strict=True) if h]
        inside = np.hypot(hx - x, hy - y) <= r
        sx, sy, fx, fy = nx - hx, ny - hy, hx - x, hy - y
        aa, bb, cc = sx * sx + sy * sy, 2 * (fx * sx + fy * sy), fx * fx + fy * fy - r * r
        root = bb * bb - 4 * aa * cc
        ok = np.flatnonzero(root >= 0)
        for sign in (-1, 1):
            t = (-bb[ok] + sign * np.sqrt(root[ok])) / (2 * aa[ok])
            t, k = t[(t >= 0) & (t <= 1)], ok[(t >= 0) & (t <= 1)]
            xs += (hx[k] + t * sx[k]).tolist()
            ys += (hy[k] + t * sy[k]).tolist()
        xs += hx[inside].tolist()
        ys += hy[inside].tolist()
        return not xs or (min(xs) >= x0 and max(xs) < x1 and min(ys) >= y0 and max(ys) < y1)

    def _outmost(self, p: int, q: int, side: int) -> bool:
        """Whether no point at all lies on that side of p to q."""
        a, b = self._point(p)[:2], self._point(q)[:2]
        return all(side * _turn(a, b, h) <= 0 for h in self.hull)

    def around(self, p: int) -> tuple[list[tuple[int, int]], bool]:
        """The pairs that make triangles with p, and whether all of them stand."""
        apart = (self.xs - self.xs[p]) ** 2 + (self.ys - self.ys[p]) ** 2
        apart[p] = np.inf
        if not np.isfinite(apart).any():
            return [], len(self.hull) < 2
        first = int(apart.argmin())
        found: list[tuple[int, int]] = []
        for side in (1, -1):
            q = first
            while (r := self._apex(p, q, side)) is not None:
                pair = (q, r) if side > 0 else (r, q)
                if not self._stands(p, *pair):
                    return [], False
                found.append(pair)
                q = r
                if q == first:
                    return found, True
                if len(found) > 2 * len(self.xs):
                    raise ArithmeticError("a star doesn't close")
            if not self._outmost(p, q, side):
                return [], False
        return found, True


def _stars(wider: int, x0: float, y0: float, side: float, hull: list[Point]):
    """The function of a tile and the points at hand: its stars, triangles under their smallest corner, and who must look farther."""

    def stars(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        level = max(0, key[0] - wider)
        size = side / 4.0**level
        step = 4 ** min(wider, key[0])
        u, v = key[1] // step, key[2] // step
        box = (x0 + (u - 1) * size, x0 + (u + 2) * size, y0 + (v - 1) * size, y0 + (v + 2) * size)
        if wider > key[0]:
            box = (-math.inf, math.inf, -math.inf, math.inf)
        f = f.sort_values("id")
        star = Star(f["x"].to_numpy(), f["y"].to_numpy(), f["id"].to_numpy(), box, hull)
        rows = []
        for p in np.flatnonzero(f["mine"].to_numpy()).tolist():
            pairs, done = star.around(p)
            name = int(star.ids[p])
            rows.append((name, done, None, None, None, *[None] * 6))
            for q, r in pairs:
                corners = sorted((p, q, r))
                if done and corners[0] == p:  # f is in order of id
                    rows.append((name, True, *(int(star.ids[i]) for i in corners), *(float(z) for i in corners for z in (star.xs[i], star.ys[i]))))
        return pd.DataFrame(rows, columns=["id", "done", "a", "b", "c", "ax", "ay", "bx", "by", "cx", "cy"]).astype({k: "Int64" for k in "abc"})

    return stars


def triangles(points: DataFrame, tile: int = 48) -> DataFrame:
    """``a, b, c, ax, ay, bx, by, cx, cy``: the Delaunay triangles of ``points(id, x, y)``, corners as ids in ascending order, each once.

    Points with equal coordinates are one, under the smallest id; rows without a coordinate are left out; fewer than three points, or points on one
    line, have no triangles. Where four points lie on a circle, the one with the smallest id decides.
    """
    tree = Pyramid(points.select(F.col("id").cast("long").alias("id"), "x", "y"), tile)
    fields = "a long, b long, c long, ax double, ay double, bx double, by double, cx double, cy double"
    if tree.empty:
        return points.sparkSession.createDataFrame([], fields)
    hull = hull_of(tree.all)
    x0, y0, side = tree.x0, tree.y0, tree.side
    open_ = tree.points.select(F.col("level").alias("tl"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), "id", "x", "y")
    out: list[DataFrame] = []
    for wider in range(len(tree.levels) + 1):
        near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        met = None
        for level in range(len(tree.levels)):  # tiles of one level look among points filed at one level
            at = max(0, level - wider)
            tiles = open_.where(F.col("tl") == level).select("tl", "tx", "ty").distinct()
            step = 4 ** min(wider, level)
            blocks = tiles.withColumn("n", near).select("tl", "tx", "ty", (F.floor(F.col("tx") / step) + F.col("n.i")).alias("cx"), (F.floor(F.col("ty") / step) + F.col("n.j")).alias("cy"))
            part = blocks.join(tree.keyed(tree.all, at).drop("level"), ["cx", "cy"]).select("tl", "tx", "ty", "id", "x", "y")
            met = part if met is None else met.unionByName(part)
        mine = open_.select("tl", "tx", "ty", "id", F.lit(True).alias("mine"))
        seen = met.join(mine, ["tl", "tx", "ty", "id"], "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
        found = kept(seen.groupBy("tl", "tx", "ty").applyInPandas(_stars(wider, x0, y0, side, hull), "id long, done boolean, " + fields), "stars")
        out.append(found.where("a is not null").drop("id", "done"))
        left = found.where("not done").select("id")
        if left.limit(1).count() == 0:
            break
        open_ = kept(open_.join(left, "id", "left_semi"), "open")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def interpolated(points: DataFrame, value: str, step: float) -> DataFrame:
    """``r, c, v``: the linear surface through ``points(id, x, y, value)`` at every node (``c * step``, ``r * step``) inside their hull.

    A triangle meets the nodes of each row between its sides there, so no node is tried in vain; a node on a common side takes the triangle that sorts first.
    Points without a value are left out.
    """
    held = points.where(F.col(value).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    known = held.groupBy("x", "y").agg(F.min("id").alias("id"), F.min_by(F.col(value), "id").cast("double").alias("v")).select("id", "v")
    t = triangles(held.select("id", "x", "y"))
    for k in "abc":
        t = t.join(known.select(F.col("id").alias(k), F.col("v").alias("v" + k)), k)
    corners = [(F.col(k + "x"), F.col(k + "y")) for k in "abc"]
    ys = [y for _, y in corners]
    rows = t.withColumn("r", F.explode(F.sequence(F.ceil(F.least(*ys) / step), F.floor(F.greatest(*ys) / step)))).where((F.col("r") * step >= F.least(*ys)) & (F.col("r") * step <= F.greatest(*ys)))
    y = F.col("r") * step
    ends = []
    for i, j in ((0, 1), (1, 2), (2, 0)):
        (xa, ya), (xb, yb) = corners[i], corners[j]
        on = (F.least(ya, yb) <= y) & (F.greatest(ya, yb) >= y)
        ends += [F.when(on & (ya != yb), xa + (xb - xa) * (y - ya) / F.nullif(yb - ya, F.lit(0.0))), F.when(on & (ya == yb), xa), F.when(on & (ya == yb), xb)]
    eps = 1e-9 * step
    rows = rows.withColumn("_w", F.ceil((F.least(*ends) - eps) / step)).withColumn("_e", F.floor((F.greatest(*ends) + eps) / step)).where("_w <= _e")
    nodes = rows.withColumn("c", F.explode(F.sequence("_w", "_e")))
    x = F.col("c") * step
    (ax, ay), (bx, by), (cx, cy) = corners
    det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    la, lb = ((by - cy) * (x - cx) + (cx - bx) * (y - cy)) / det, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / det
    v = la * F.col("va") + lb * F.col("vb") + (1 - la - lb) * F.col("vc")
    return nodes.select("r", "c", v.alias("v"), F.struct("a", "b", "c").alias("t")).groupBy("r", "c").agg(F.min_by("v", "t").alias("v"))
