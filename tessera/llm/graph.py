"""Connected components of a distributed edge list: stars are drawn in first, what is left takes alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import salted_join, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node that links reach.

    Loops and rows with a null end are ignored; repeated edges count once; no edges give no rows. ``b`` is the side on which many edges
    may meet, as where copies point at one of them: each ``a`` is drawn in to its smallest ``b``, the rounds run on
    the ``b`` nodes alone, and the others take their component by a salted join. So no round sees a star's leaves, and no
    join deals a star to one task. Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
    """
    e = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    drawn = stored(e.groupBy("a").agg(F.min("b").alias("p")), "drawn")
    targets = e.select(F.col("b").alias("a")).distinct()
    between = e.join(drawn, "a").where("b <> p").select(F.col("b").alias("x"), F.col("p").alias("y"))
    between = between.unionByName(drawn.join(targets, "a", "left_semi").select(F.col("a").alias("x"), F.col("p").alias("y")))
    core = _star_rounds(between)
    named = targets.select(F.col("a").alias("p")).join(core.withColumnRenamed("node", "p"), "p", "left").select("p", F.coalesce("component", "p").alias("c"))
    # a drawn-in node may be smaller than all targets of its component
    leaves = stored(salted_join(drawn, named, ["p"], by="a").select(F.col("a").alias("node"), "c"), "leaves")
    nodes = leaves.unionByName(named.select(F.col("p").alias("node"), "c")).distinct()
    least = nodes.groupBy("c").agg(F.min("node").alias("component"))
    return salted_join(nodes, least, ["c"], by="node").select("node", "component")


def _are_stars(e: DataFrame) -> bool:
    """Whether each component of the distinct edges ``e(a, b)``, a > b, is its smallest node and edges to it: then no round is left to do."""
    ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def _star_rounds(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of ``edges(x, y)``."""
    e = stored(edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a > b").distinct(), "edges")
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b")).distinct()
        e = stored(small, "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
