"""Classes of a stack of scenes: the local water background, anomalies that hold over scenes, and class masks in order of precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def box_sums(cells: DataFrame, scene: str, values: list[str], k: int, rows: int, cols: int) -> DataFrame:
    """``scene, r, c``, the ``values`` and ``box_<value>``, their sums over the (2k+1)-square box, of every cell of each scene's raster.

    Edges are replicated. Nulls and cells that aren't there count as 0, repeated cells add up; rows without a scene or
    beyond the raster are left out. Separable: sums along each row, then along each column, so two exchanges; a window
    is one line of one raster. Cells carry their own values along, so nothing is joined back.
    """
    at = [F.col(c).cast("int").alias(c) for c in ("r", "c")]
    here = cells.where(F.col(scene).isNotNull() & F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1)).select(scene, *at, *[F.col(v).cast("double").alias(v) for v in values])
    lines = here.select(scene).distinct().select(scene, F.explode(F.expr(f"sequence(0, {rows - 1})")).alias("r"))
    blank = lines.select(scene, "r", F.explode(F.expr(f"sequence(0, {cols - 1})")).alias("c"), *[F.lit(None).cast("double").alias(v) for v in values])
    grid = here.unionByName(blank).repartition(scene, "r").groupBy(scene, "r", "c").agg(*[F.sum(v).alias(v) for v in values])

    def along(df: DataFrame, line: str, place: str, last: int, names: dict[str, str]) -> DataFrame:
        whole = Window.partitionBy(scene, line)
        near = whole.orderBy(place).rangeBetween(-k, k)
        known = lambda x: F.coalesce(x, F.lit(0.0))
        end = lambda v, i: known(F.sum(F.when(F.col(place) == i, F.col(v))).over(whole))
        beyond = lambda n: F.greatest(F.lit(0), n)
        total = lambda v: known(F.sum(v).over(near)) + beyond(k - F.col(place)) * end(v, 0) + beyond(F.col(place) + k - last) * end(v, last)
        return df.select(scene, "r", "c", *values, *[total(v).alias(name) for v, name in names.items()])

    across = along(grid, "r", "c", cols - 1, {v: f"box_{v}" for v in values})
    return along(across, "c", "r", rows - 1, {f"box_{v}": f"box_{v}" for v in values})


def local_z(pixels: DataFrame, scene: str, values: list[str], k: int, rows: int, cols: int, least_wet: int = 1000, cover: float = 0.05, floor: float = 1e-6) -> DataFrame:
    """``scene, r, c`` and ``z_<value>`` of every row of ``pixels(scene, r, c, <values>)``: its distance from the box's mean in standard deviations.

    ``pixels`` holds water only, one row a cell; those with a null value don't count. Scenes of fewer than ``least_wet``
    pixels give nothing. Where pixels cover at most ``cover`` of the box z is null; the variance is at least ``floor``.
    """
    known = pixels.dropna(subset=[scene, "r", "c", *values]).select(scene, "r", "c", *values)
    enough = known.groupBy(scene).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_wet).select(scene)
    squares = [(F.col(v) * F.col(v)).alias(f"{v}_sq") for v in values]
    sums = box_sums(known.join(enough, scene).select("*", F.lit(1.0).alias("_m"), *squares), scene, ["_m", *values, *[f"{v}_sq" for v in values]], k, rows, cols)

    def z(v: str):
        n = F.when(F.col("box__m") > cover * (2 * k + 1) ** 2, F.col("box__m"))
        mean = F.col(f"box_{v}") / n
        return (F.col(v) - mean) / F.sqrt(F.greatest(F.lit(floor), F.col(f"box_{v}_sq") / n - mean * mean))

    # greatest passes over a null, but the mean is null with it
    return sums.where("_m is not null").select(scene, "r", "c", *[z(v).alias(f"z_{v}") for v in values])


def anomalies(scores: DataFrame, bright_z: float = 1.8) -> DataFrame:
    """``r, c, obs, hits, frac, nir_z`` of ``scores(r, c, z_green, z_nir)``: how often a pixel is brighter than the water around it, and its mean z in near infrared.

    A null z is no hit and adds 0.
    """
    out = scores.groupBy("r", "c").agg(F.count("*").alias("obs"), F.count(F.when(F.col("z_green") > bright_z, 1)).alias("hits"), F.sum(F.coalesce("z_nir", F.lit(0.0))).alias("_nir"))
    return out.select("r", "c", "obs", "hits", (F.col("hits") / F.col("obs")).alias("frac"), (F.col("_nir") / F.col("obs")).alias("nir_z"))


def class_masks(looks: DataFrame, found: DataFrame, least_seen: int = 12, least_end: int = 4, exposed: float = 0.6, drawdown: float = 0.35, held: float = 0.55, dry_z: float = 1.0) -> DataFrame:
    """``r, c, cls, conf`` of the pixels that are exposed, drawdown, rock or shoal, the first that holds, and the statistic that made them so.

    ``looks(r, c, land, low, high)`` has a row for each valid look of a pixel: whether it is land, and whether its scene is
    of low or high stage; ``found`` is of ``anomalies``. Exposed: land in at least ``exposed`` of the looks. Drawdown: drier by
    ``drawdown`` at low than at high stage, with ``least_end`` looks at each. Bright in ``held`` of its water looks: rock from
    ``dry_z`` in near infrared, else shoal. Nothing is told of pixels with fewer than ``least_seen`` looks.
    """
    count = lambda c: F.count(F.when(c, 1))
    land, low, high = F.col("land"), F.col("low"), F.col("high")
    seen = looks.groupBy("r", "c").agg(F.count("*").alias("seen"), count(land).alias("land"), count(low).alias("n_low"), count(low & land).alias("land_low"), count(high).alias("n_high"), count(high & land).alias("land_high"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = seen.where(F.col("seen") >= least_seen).select("r", "c", share("land", "seen").alias("all"), share("land_low", "n_low").alias("dry_low"), share("land_high", "n_high").alias("dry_high"), "n_low", "n_high")
    rows = rows.join(found, ["r", "c"], "left").withColumn("delta", F.col("dry_low") - F.col("dry_high"))
    falls = (F.col("delta") >= drawdown) & (F.col("dry_high") < exposed) & (F.col("n_low") >= least_end) & (F.col("n_high") >= least_end)
    bright = (F.col("frac") >= held) & (F.col("obs") >= least_seen)
    cls = F.when(F.col("all") >= exposed, "exposed").when(falls, "drawdown").when(bright & (F.col("nir_z") >= dry_z), "rock").when(bright, "shoal")
    conf = F.when(F.col("cls") == "exposed", F.col("all")).when(F.col("cls") == "drawdown", F.col("delta")).otherwise(F.col("frac"))
    return rows.withColumn("cls", cls).where("cls is not null").select("r", "c", "cls", conf.alias("conf"))
