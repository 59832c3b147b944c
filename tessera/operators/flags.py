"""Reports of the same thing: clusters in order of arrival, and the queue for review."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: reports within so many metres of a cluster's centroid are of the same thing.
SAME_THING_M = 40.0


def clustered(flags: DataFrame, radius: float = SAME_THING_M) -> DataFrame:
    """``lake, id, cluster`` of ``flags(lake, id, t, x, y)``: each flag, by time and id, joins the first cluster of its lake whose centroid
    lies within the radius, and moves that centroid; else it opens the next cluster.

    The order decides, so a lake is one fold; lakes are side by side. Centroids are filed under cells, so a flag meets only those near it. Flags
    without a position are left out; those without a time come last.
    """

    def fold(_: tuple, chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks)).sort_values(["t", "id"])
        sums: list[list[float]] = []
        cells: dict[tuple[int, int], set[int]] = {}
        place = lambda k: (int(sums[k][0] / sums[k][2] // radius), int(sums[k][1] / sums[k][2] // radius))
        out = []
        for x, y in zip(rows["x"].tolist(), rows["y"].tolist(), strict=True):
            cx, cy = int(x // radius), int(y // radius)
            near = sorted(k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in cells.get((cx + i, cy + j), ()))
            hit = next((k for k in near if ((sums[k][0] / sums[k][2] - x) ** 2 + (sums[k][1] / sums[k][2] - y) ** 2) ** 0.5 <= radius), None)
            if hit is None:
                hit = len(sums)
                sums.append([x, y, 1])
            else:
                cells[place(hit)].discard(hit)
                s = sums[hit]
                s[0], s[1], s[2] = s[0] + x, s[1] + y, s[2] + 1
            cells.setdefault(place(hit), set()).add(hit)
            out.append(hit + 1)
        yield pd.DataFrame({"lake": rows["lake"], "id": rows["id"], "cluster": out})

    return flags.select("lake", "id", "t", "x", "y").where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("lake").applyInPandas(fold, "lake long, id long, cluster long")


def cluster_stats(flags: DataFrame, radius: float = SAME_THING_M) -> DataFrame:
    """``lake, cluster, n, reporters, best, newest, x, y`` of the pending flags' clusters; ``best`` is the smallest known accuracy."""
    pending = flags.where("status = 'pending'")
    joined = pending.join(clustered(pending, radius), ["lake", "id"])
    return joined.groupBy("lake", "cluster").agg(F.count("*").alias("n"), F.countDistinct("reporter").alias("reporters"), F.min("accuracy").alias("best"), F.max("t").alias("newest"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def review_queue(stats: DataFrame) -> DataFrame:
    """Adds ``place`` within a lake: most reporters, then most reports, then the best position (unknown last), then the newest."""
    order = [F.desc("reporters"), F.desc("n"), F.coalesce("best", F.lit(999.0)), F.desc("newest"), "cluster"]
    return stats.withColumn("place", F.row_number().over(Window.partitionBy("lake").orderBy(*order)))
