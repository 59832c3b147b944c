"""The look-ahead hazard scan: what lies in the corridor ahead, most urgent first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import cell

#: Severity of a class, weight of a tier, tiers and limits of the scan.
CLASS_SEVERITY = {"shoal": 4.0, "drawdown": 3.0, "rock": 2.0, "exposed": 1.0, "island": 1.0}
TIER_WEIGHT = {"confirmed": 1.0, "likely": 0.75, "unverified": 0.4}
CELL, CORRIDOR, RADIUS, SLOW = 200.0, 35.0, 60.0, 1.5


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def severity(cls: Column, tier: Column) -> Column:
    return lookup(CLASS_SEVERITY, cls, 1.0) * lookup(TIER_WEIGHT, tier, 0.4)


def reach(speed: Column) -> Column:
    return F.greatest(F.lit(60.0), F.least(F.lit(600.0), speed * 20))


def alert_level(range_m: Column, ttc: Column) -> Column:
    return F.when((ttc <= 6) | (range_m <= 40), "danger").when((ttc <= 15) | (range_m <= 120), "caution").otherwise("clear")


def corridor_scan(fixes: DataFrame, hazards: DataFrame) -> DataFrame:
    """Every hazard in reach of every fix: ``seq, hazard_id, range_m, ttc, severity, confirmed``.

    With speed and heading: within the corridor's half width of the way ahead; else within a radius of the position. Hazards
    lie in one cell, fixes are repeated into the cells that their reach can touch, and the exact test follows the cell join.
    """
    moving = F.coalesce(F.col("heading").isNotNull() & (F.col("speed") >= SLOW), F.lit(False))
    f = fixes.withColumn("moving", moving).withColumn("ahead_m", F.when(moving, reach(F.col("speed"))).otherwise(0.0))
    f = f.withColumn("ux", F.when(moving, F.cos("heading")).otherwise(0.0)).withColumn("uy", F.when(moving, F.sin("heading")).otherwise(0.0))
    # the cells that the box around the way ahead touches
    side = F.when(F.col("moving"), CORRIDOR).otherwise(RADIUS)
    low = lambda p, u: F.floor((F.col(p) + F.least(F.lit(0.0), F.col(u) * F.col("ahead_m")) - side) / CELL).cast("long")
    high = lambda p, u: F.floor((F.col(p) + F.greatest(F.lit(0.0), F.col(u) * F.col("ahead_m")) + side) / CELL).cast("long")
    f = f.withColumn("cx", F.explode(F.sequence(low("x", "ux"), high("x", "ux")))).withColumn("cy", F.explode(F.sequence(low("y", "uy"), high("y", "uy"))))
    h = hazards.select(F.col("id").alias("hazard_id"), F.col("x").alias("hx"), F.col("y").alias("hy"), severity(F.col("cls"), F.col("tier")).alias("severity"), (F.col("tier") == "confirmed").alias("confirmed"))
    h = h.withColumn("cx", cell(F.col("hx"), CELL)).withColumn("cy", cell(F.col("hy"), CELL))
    dx, dy = F.col("hx") - F.col("x"), F.col("hy") - F.col("y")
    along = F.greatest(F.lit(0.0), F.least(F.col("ahead_m"), dx * F.col("ux") + dy * F.col("uy")))
    met = f.join(h, ["cx", "cy"]).withColumn("along", along)
    off = F.sqrt((dx - F.col("along") * F.col("ux")) ** 2 + (dy - F.col("along") * F.col("uy")) ** 2)
    hit = met.where(off <= F.when(F.col("moving"), CORRIDOR).otherwise(RADIUS)).withColumn("range_m", F.sqrt(dx * dx + dy * dy))
    ttc = F.when(F.col("moving"), F.col("range_m") / F.col("speed")).otherwise(F.expr("double('Infinity')"))
    return hit.withColumn("ttc", ttc).select("seq", "hazard_id", "range_m", "ttc", "severity", "confirmed")


def most_urgent(hits: DataFrame) -> DataFrame:
    """The first hit of each fix by time to contact, severity, confirmation, range and id, with its alert level."""
    w = Window.partitionBy("seq").orderBy("ttc", F.desc("severity"), F.desc("confirmed"), "range_m", "hazard_id")
    return hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").withColumn("level", alert_level(F.col("range_m"), F.col("ttc")))


def held_alerts(levels: DataFrame, hold: int = 4000) -> DataFrame:
    """Adds ``shown`` to ``levels(trip, t_ms, seq, level)``: a clear level within ``hold`` of the trip's last other level still shows caution."""
    w = Window.partitionBy("trip").orderBy("t_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("level") != "clear", F.col("t_ms")), ignorenulls=True).over(w)
    return levels.withColumn("shown", F.when(F.col("level") != "clear", F.col("level")).when(F.col("t_ms") - last < hold, "caution").otherwise("clear"))
