"""Shared lakes: boats upload swept cells and flags, each lake is merged on its own, and every upload gets an answer.

Marks are kept the same way: put and deleted by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import VersionedTable

#: Bounds of an upload and of a lake, and what a lake's code looks like.
MAX_CELLS, MAX_FLAGS, CODE = 400_000, 5_000, "^[A-Z0-9]{4,12}$"
ROWS = "what string, cx long, cy long, id long, t_ms long, seq long, planing boolean, status string, reviewed_t long, upload long, lake string"
ANSWERS = "upload long, lake string, answer int, merged long"


def _merged(rows: DataFrame) -> DataFrame:
    """The strongest claim on each cell and the weightiest copy of each flag: reviewed before pending, the later review, the earlier upload, the first of equals."""
    cells = rows.where("what = 'cell'")
    claim = F.struct((~F.col("planing")).alias("slow"), "t_ms", (-F.col("seq")).alias("first"))
    fields = [c.split()[0] for c in ROWS.split(", ") if c.split()[0] not in ("lake", "cx", "cy", "id")]
    best = cells.groupBy("lake", "cx", "cy").agg(F.max_by(F.struct(*fields), claim).alias("b")).select("lake", "cx", "cy", F.lit(None).cast("long").alias("id"), "b.*")
    reviewed = F.col("status") != "pending"
    weight = F.struct(reviewed.alias("r"), F.when(reviewed, F.coalesce("reviewed_t", F.lit(0))).otherwise(0).alias("t"), (-F.col("upload")).alias("u"), (-F.col("seq")).alias("first"))
    kept = rows.where("what = 'flag'").groupBy("lake", "id").agg(F.max_by(F.struct(*fields), weight).alias("b")).select("lake", F.lit(None).cast("long").alias("cx"), F.lit(None).cast("long").alias("cy"), "id", "b.*")
    return best.unionByName(kept)


class Lakes:
    """Merges batches of uploads; lakes that a batch doesn't name keep their files. A bound that is None doesn't bind."""

    def __init__(self, spark: SparkSession, base: str, max_cells: int | None = MAX_CELLS, max_flags: int | None = MAX_FLAGS):
        self.spark, self.base, self.max_cells, self.max_flags = spark, base, max_cells, max_flags
        self.table = VersionedTable(spark, f"{base}/lakes", ROWS, "lake")

    def merge(self, uploads: DataFrame, n: int) -> None:
        """Batch n of ``uploads(upload, code, what, cx, cy, id, t_ms, seq, planing, status, reviewed_t)``, a row a cell or flag; writes its answers.

        200: merged; 400: a code that isn't one; 413: more cells or flags than an upload may hold; 507: the batch would leave the lake with too
        many cells, so the lake stays as it was. Nothing is cut: an upload counts whole or not at all. A batch that is tried again does the same again.
        """
        uploads = uploads.withColumn("lake", F.upper("code")).persist()
        count = lambda what: F.count_if(F.col("what") == what)
        each = uploads.groupBy("upload", "lake").agg(count("cell").alias("cells"), count("flag").alias("flags"))
        asked = each.withColumn("answer", F.when(~F.coalesce(F.col("lake").rlike(CODE), F.lit(False)), 400).when(self._over("cells", self.max_cells) | self._over("flags", self.max_flags), 413).otherwise(200))
        fit = uploads.join(asked.where("answer = 200").select("upload", "lake"), ["upload", "lake"], "left_semi")
        names = [c.split()[0] for c in ROWS.split(", ")]

        def merge(held: DataFrame) -> DataFrame:
            merged = _merged(held.unionByName(fit.select(*names)))
            if self.max_cells is None:
                return merged
            full = merged.where("what = 'cell'").groupBy("lake").count().where(F.col("count") > self.max_cells).select("lake")
            stays = held.join(full, "lake", "left_semi")
            return merged.join(full, "lake", "left_anti").unionByName(stays)

        self.table.update(n, fit.select("lake"), merge)
        after = self.table.read().withColumn("mine", F.lit(True))
        size = after.where("what = 'cell'").groupBy("lake").agg(F.count("*").alias("merged"))
        # a lake whose rows don't hold any of the batch's cells though it had some was full
        sent = fit.where("what = 'cell'").select("lake", "cx", "cy").distinct()
        lost = sent.join(after.select("lake", "cx", "cy"), ["lake", "cx", "cy"], "left_anti").select("lake").distinct().withColumn("full", F.lit(True))
        if self.max_cells is None:
            lost = lost.limit(0)
        answers = asked.join(size, "lake", "left").join(lost, "lake", "left")
        answer = F.when((F.col("answer") == 200) & F.coalesce("full", F.lit(False)), 507).otherwise(F.col("answer"))
        answers.select("upload", "lake", answer.cast("int").alias("answer"), F.when(answer == 200, F.coalesce("merged", F.lit(0))).cast("long").alias("merged")).write.mode("overwrite").parquet(f"{self.base}/answers/{n}")
        uploads.unpersist()

    @staticmethod
    def _over(column: str, bound: int | None) -> Column:
        return F.lit(False) if bound is None else F.col(column) > bound

    def rows(self) -> DataFrame:
        return self.table.read()

    def answers(self) -> DataFrame:
        found = [f"{self.base}/answers/{n}" for n in VersionedTable(self.spark, self.base, ANSWERS, "lake")._numbers("answers")]
        return self.spark.read.schema(ANSWERS).parquet(*found) if found else self.spark.createDataFrame([], ANSWERS)


class Marks:
    """Marks put and deleted by key, in any order of arrival: the latest by time and seq stands. A delete stays as a tombstone, so an older put that comes later doesn't bring a mark back."""

    SCHEMA = "id long, t long, seq long, gone boolean, status string, lake string"

    def __init__(self, spark: SparkSession, base: str):
        self.table = VersionedTable(spark, base, self.SCHEMA, "lake")

    def apply(self, changes: DataFrame, n: int) -> None:
        """Batch n of ``changes(lake, id, t, seq, gone, status)``."""
        names = [c.split()[0] for c in self.SCHEMA.split(", ")]
        rows = changes.select(*names)
        fields = F.struct(*[c for c in names if c not in ("lake", "id")])
        latest = lambda df: df.groupBy("lake", "id").agg(F.max_by(fields, F.struct("t", "seq")).alias("b")).select("lake", "id", "b.*")
        self.table.update(n, rows, lambda held: latest(held.unionByName(rows)))

    def rows(self) -> DataFrame:
        return self.table.read().where("not gone").drop("gone")
