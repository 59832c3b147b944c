"""Connected components of graphs, raster masks and ways."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the ends of ``edges(a, b)``: the smallest node that edges reach.

    Labels sink to the smallest of each node's neighbours and then jump to their label's label, so rounds grow with the logarithm of a component's
    extent more than with the extent itself. Every round is written out, and they end when none changes.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = kept(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = kept(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        low = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        sunk = kept(now.join(low, "node").select("node", F.col("label").alias("before"), F.least("label", "low").alias("label")), "sunk")
        jumped = sunk.alias("s").join(sunk.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", "before", F.col("far").alias("label"))
        now = kept(jumped, "labels")
        changed = now.where("label <> before").limit(1).count()
        now = now.select("node", "label")
        if not changed:
            return now


def _labelled(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def label(f: pd.DataFrame) -> pd.DataFrame:
        """The smallest cell number that each cell of one tile reaches inside it."""
        f = f.sort_values(["r", "c"])
        r, c = f["r"].to_numpy(), f["c"].to_numpy()
        at = np.full((r.max() - r.min() + 2, c.max() - c.min() + 2), -1)
        at[r - r.min(), c - c.min()] = np.arange(len(f))
        pairs = [np.stack([a[ok], b[ok]]) for a, b in ((at[:-1, :], at[1:, :]), (at[:, :-1], at[:, 1:])) for ok in [(a >= 0) & (b >= 0)]]
        i, j = np.concatenate(pairs, 1)
        root = np.arange(len(f))  # in order of cell numbers
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, root[i], low)
            np.minimum.at(new, root[j], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"r": r, "c": c, "root": r[root] * width + c[root]})

    return label


def grid_components(cells: DataFrame, width: int, tile: int = 256) -> DataFrame:
    """``r, c, blob`` of mask cells ``r, c`` under 4-neighbourhood; a blob is named by its smallest cell number ``r * width + c``.

    Each tile finds its own components; where two tiles' cells touch, their names are an edge, and only those edges go through rounds, so what is
    written there grows with the seams and not with the raster. Null and repeated cells count once or not at all.
    """
    at = lambda c: F.floor(F.col(c) / tile)
    once = cells.where("r is not null and c is not null").select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    local = kept(once.groupBy(at("r"), at("c")).applyInPandas(_labelled(width), "r long, c long, root long"), "tiles")
    seams = None
    for dr, dc, along in ((1, 0, "r"), (0, 1, "c")):
        last = local.where(F.pmod(F.col(along), F.lit(tile)) == tile - 1).select((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.col("root").alias("a"))
        first = local.where(F.pmod(F.col(along), F.lit(tile)) == 0).select("r", "c", F.col("root").alias("b"))
        part = last.join(first, ["r", "c"]).select("a", "b")
        seams = part if seams is None else seams.unionByName(part)
    named = components(seams.distinct()).select(F.col("node").alias("root"), "label")
    return local.join(named, "root", "left").select("r", "c", F.coalesce("label", "root").alias("blob"))


def lines_of(ways: DataFrame) -> DataFrame:
    """``id, line`` of ``ways(id, a, b)``: ways that share an end, whichever way round, are one line, named by its smallest id."""
    ends = kept(ways.select("id", F.explode(F.array("a", "b")).alias("p")), "ends")
    first = ends.groupBy("p").agg(F.min("id").alias("b"))
    named = components(ends.join(first, "p").select(F.col("id").alias("a"), "b"))
    return ways.select("id").join(named.select(F.col("node").alias("id"), F.col("label").alias("line")), "id", "left").select("id", F.coalesce("line", "id").alias("line"))
