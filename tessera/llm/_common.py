"""What several operators of this subpackage share: the shared folder, stored tables, word splitting."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; own temporary folder in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, whose session now sends Python at most ``rows`` rows at a time where it has Spark's own 10,000: texts are long, and the JVM,
    its pipes and the worker hold a batch each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(rows))
    return df


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut and it survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """``left.join(right, on, how)`` where one key may hold most rows of ``left``: they are dealt to ``salts`` places by the column ``by``.

    ``right`` has few rows a key and is copied only to the places that ``left`` has of that key, found by a combining
    aggregate; a key with one row of ``left`` is copied once. ``left`` is read twice.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    places = salted.select(*on, "_salt").distinct()
    return salted.join(places.join(right, on), [*on, "_salt"], how).drop("_salt")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever case."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a URI, for byte access inside tasks."""
    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_bucket(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def id_text(doc_id):
    """The id as text; a null id is empty."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


class Bloom:
    """A fixed-size bit array over 64-bit keys, so that it may be broadcast whatever it has seen; false positives only."""

    def __init__(self, bits: int = 26, data: bytes | None = None):
        self.bits = bits
        self.data = np.frombuffer(data, np.uint8).copy() if data is not None else np.zeros(1 << bits >> 3, np.uint8)

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        k = keys.astype(np.int64).view(np.uint64)
        return [(k * np.uint64(m)) >> np.uint64(64 - self.bits) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

    def add(self, keys: np.ndarray) -> None:
        for p in self._places(keys):
            np.bitwise_or.at(self.data, (p >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self._places(keys):
            out &= (self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bloom_of(keys: DataFrame, bits: int = 26) -> Bloom:
    """The Bloom filter of a one-column frame of longs; each task sends its non-empty blocks, Spark merges them by block."""
    block = 1 << 16  # bytes

    def own(batches):
        b = Bloom(bits)
        for x in batches:
            b.add(x.column(0).to_numpy(zero_copy_only=False))
        for i in range(0, len(b.data), block):
            part = b.data[i : i + block]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([i // block], pa.int32()), "blob": pa.array([part.tobytes()], pa.binary())})

    def merged(batches):
        sums: dict[int, np.ndarray] = {}
        for x in batches:
            for i, blob in zip(x["block"].to_pylist(), x["blob"].to_pylist(), strict=True):
                part = np.frombuffer(blob, np.uint8)
                sums[i] = sums[i] | part if i in sums else part
        for i, part in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "blob": pa.array([part.tobytes()], pa.binary())})

    schema = "block int, blob binary"
    rows = keys.mapInArrow(own, schema).repartition(partitions(keys.sparkSession), "block").mapInArrow(merged, schema).collect()
    out = Bloom(bits)
    for r in rows:
        out.data[r.block * block : r.block * block + len(r.blob)] = np.frombuffer(r.blob, np.uint8)
    return out


def ceil_share(n: int, percent: int) -> int:
    """The smallest whole number of at least ``percent`` hundredths of n."""
    return math.ceil(n * percent / 100) if n < 1 << 40 else -(-n * percent // 100)
