"""A table kept in versions by partition: an update writes the partitions that it touches and then a manifest that says where each one lies."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """Rows of ``schema`` in partitions of the string column ``by``, under ``base``.

    Version n is the folder ``data/n`` with the partitions that update n rewrote, and the manifest ``manifest/n`` (partition, version), which is
    written last. A reader takes the latest complete manifest, so it sees an update whole or not at all; an update that is tried again starts from the manifest
    before it. Versions that neither of the last two manifests names are removed.
    """

    def __init__(self, spark: SparkSession, base: str, schema: str, by: str):
        self.spark, self.base, self.by = spark, base, by
        self.schema = spark.createDataFrame([], schema).schema
        self.files, self.root = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)

    def _numbers(self, folder: str) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.type == fs.FileType.Directory and f.base_name.isdigit())

    def versions(self, before: int | None = None) -> list[int]:
        """Numbers of complete manifests, below ``before``."""
        done = [n for n in self._numbers("manifest") if self.files.get_file_info(f"{self.root}/manifest/{n}/_SUCCESS").type == fs.FileType.File]
        return [n for n in done if before is None or n < before]

    def manifest(self, n: int | None) -> DataFrame:
        kind = f"{self.by} string, version int"
        return self.spark.createDataFrame([], kind) if n is None else self.spark.read.schema(kind).parquet(f"{self.base}/manifest/{n}")

    def _rows(self, manifest: DataFrame) -> DataFrame:
        held = [r[0] for r in manifest.select("version").distinct().collect()]  # live versions only
        if not held:
            return self.spark.createDataFrame([], self.schema)
        every = None
        for n in sorted(held):
            part = self.spark.read.schema(self.schema).parquet(f"{self.base}/data/{n}").withColumn("version", F.lit(n))
            every = part if every is None else every.unionByName(part)
        return every.join(manifest, [self.by, "version"], "left_semi").select(*self.schema.names)

    def read(self) -> DataFrame:
        """All rows of the latest version; none before the first."""
        return self._rows(self.manifest((self.versions() or [None])[-1]))

    def update(self, n: int, touched: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Version n: the partitions named in ``touched`` (one string column ``by``) become ``merge`` of their rows; a partition that ``merge`` leaves without rows goes."""
        before = (self.versions(n) or [None])[-1]
        old = self.manifest(before)
        names = touched.select(self.by).distinct()
        merged = merge(self._rows(old.join(names, self.by, "left_semi")))
        merged.select(*self.schema.names).repartition(self.by).write.mode("overwrite").partitionBy(self.by).parquet(f"{self.base}/data/{n}")
        fresh = self.spark.read.schema(self.schema).parquet(f"{self.base}/data/{n}").select(self.by).distinct().withColumn("version", F.lit(n))
        old.join(names, self.by, "left_anti").unionByName(fresh).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest/{n}")
        live = {r[0] for m in (before, n) if m is not None for r in self.manifest(m).select("version").distinct().collect()}
        for folder, wanted in (("data", live | {n}), ("manifest", {before, n})):
            for old_n in self._numbers(folder):
                if old_n < n and old_n not in wanted:
                    self.files.delete_dir(f"{self.root}/{folder}/{old_n}")
