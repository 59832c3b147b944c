"""Counts and sums over what lies around each point, without a row for each pair."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places and points of a tile that a task holds at once; a fuller tile is dealt to more.
PLACES, POINTS, BATCH = 250_000, 20_000, 2_048


def _sums(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, values: np.ndarray, radius: float, box: bool) -> np.ndarray:
    """For each point the sums of ``values`` (a row a place) over places within the radius.

    Places are cut into strips of x, each in order of y with running sums. A strip's places that are surely within come as a difference of running sums,
    those near the rim are tested one by one.
    """
    out = np.zeros((len(px), values.shape[1]))
    order = np.argsort(x, kind="stable")
    size = int(min(8_192, max(64, (40 * len(x)) ** 0.5)))
    for first in range(0, len(x), size):
        strip = order[first : first + size]
        low, high = x[strip[0]], x[strip[-1]]
        strip = strip[np.argsort(y[strip], kind="stable")]
        sx, sy, sv = x[strip], y[strip], values[strip]
        running = np.vstack([np.zeros(values.shape[1]), np.cumsum(sv, 0)])
        gap = np.maximum(0.0, np.maximum(low - px, px - high))
        near = np.flatnonzero(gap <= radius * (1 + 1e-9))
        for at in range(0, len(near), BATCH):
            q = near[at : at + BATCH]
            far = np.maximum(np.abs(px[q] - low), np.abs(px[q] - high))
            slack = 1e-9 * (radius + np.abs(py[q]))
            if box:
                reach, sure = np.full(len(q), radius), np.where(far <= radius * (1 - 1e-9), radius, -1.0)
            else:
                reach, sure = np.sqrt(np.maximum(0.0, radius**2 - gap[q] ** 2)), np.where(far < radius * (1 - 1e-9), np.sqrt(np.maximum(0.0, radius**2 - far**2)), -1.0)
            some = sure > slack
            o0, o1 = np.searchsorted(sy, py[q] - reach * (1 + 1e-9) - slack), np.searchsorted(sy, py[q] + reach * (1 + 1e-9) + slack, "right")
            i0 = np.where(some, np.searchsorted(sy, py[q] - sure + slack), o0)
            i1 = np.where(some, np.searchsorted(sy, py[q] + sure - slack, "right"), o0)
            i1 = np.maximum(i0, i1)
            got = running[i1] - running[i0]
            n = (i0 - o0) + (o1 - i1)
            of = np.repeat(np.arange(len(q)), n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            place = o0[of] + step + np.where(step >= (i0 - o0)[of], (i1 - i0)[of], 0)
            dx, dy = px[q][of] - sx[place], py[q][of] - sy[place]
            within = (np.abs(dx) <= radius) & (np.abs(dy) <= radius) if box else np.sqrt(dx * dx + dy * dy) <= radius
            for k in range(values.shape[1]):
                got[:, k] += np.bincount(of[within], sv[place[within], k], len(q))
            out[q] += got
    return out


def _tile(radii: list[float], sums: list[str], box: bool, names: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def tile(points: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        at = [points[c].to_numpy(float) for c in "xy"] + [places[c].to_numpy(float) for c in "xy"]
        values = places[["n", *sums]].to_numpy(float)
        found = np.hstack([_sums(*at, values, r, box) for r in radii])
        return pd.concat([points[["id"]].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    return tile


def sums_around(points: DataFrame, rows: DataFrame, radii: list[float], sums: tuple[str, ...] = (), box: bool = False) -> DataFrame:
    """``id, n_0, <sum>_0, n_1, ..``: for each of ``points(id, x, y)`` how many ``rows(x, y, ..)`` lie within each radius, and the sums of their columns ``sums``.

    ``box``: both coordinates differ by the radius at most. Points with no row within the largest radius may be absent or have zeros. Rows of one place
    are one from the start; tiles of twice the largest radius hold their points and the places around, so work grows with points times the rim, not the area.
    """
    reach = max(radii)
    side = 2 * reach
    names = [f"{c}_{k}" for k in range(len(radii)) for c in ("n", *sums)]
    known = lambda df: df.where("x is not null and y is not null").withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double"))
    tile = lambda c, off=0.0: F.floor((F.col(c) + off) / side)
    p = known(points.select("id", "x", "y")).withColumn("tx", tile("x")).withColumn("ty", tile("y"))
    places = known(rows.select("x", "y", *sums)).groupBy("x", "y").agg(F.count("*").cast("double").alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in sums])
    places = places.fillna(0.0, list(sums)).withColumn("tx", F.explode(F.sequence(tile("x", -reach * 1.001), tile("x", reach * 1.001))))
    places = places.withColumn("ty", F.explode(F.sequence(tile("y", -reach * 1.001), tile("y", reach * 1.001))))
    parts = p.groupBy("tx", "ty").agg(F.ceil(F.count("*") / POINTS).alias("lots")).join(places.groupBy("tx", "ty").agg(F.ceil(F.count("*") / PLACES).alias("shares")), ["tx", "ty"])
    lot, share = F.explode(F.expr("sequence(0, lots - 1)")), F.explode(F.expr("sequence(0, shares - 1)"))
    left = p.join(parts, ["tx", "ty"]).withColumn("lot", F.pmod(F.xxhash64("id"), "lots")).withColumn("share", share)
    right = places.join(parts, ["tx", "ty"]).withColumn("share", F.pmod(F.xxhash64("x", "y"), "shares")).withColumn("lot", lot)
    key = ["tx", "ty", "lot", "share"]
    schema = f"id {points.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names)
    left, right = left.select(*key, "id", "x", "y"), right.select(*key, "x", "y", "n", *sums)
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_tile(list(radii), list(sums), box, names), schema)
    return found.groupBy("id").agg(*[F.sum(n).cast("long" if n.startswith("n_") else "double").alias(n) for n in names])
