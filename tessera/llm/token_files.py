"""Token-id files: every document compressed by itself with one shared zstandard dictionary, found through an offset index.

A file: ``MAGIC``, bytes of an id (1 byte), the dictionary's sha256 (32 bytes); the documents' frames; the index: for n
documents n ids (int64), n null marks of the ids (1 byte), n token counts (uint64), n + 1 frame offsets (uint64), all
little-endian; n and the index's offset (uint64 each); ``MAGIC``. Documents stand in ascending doc_id order, within files
and from file to file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import filesystem, partitions, scratch, stored
from .tokenizing import encoder

MAGIC = b"TOKIDS01"
HEAD = len(MAGIC) + 1 + 32
FILE_BYTES = 64 << 20
#: Word pieces that a worker remembers while it writes.
REMEMBER = 1_500_000


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample: int = 1000, chars: int = 4000, size: int = 64 << 10, added: bool = False) -> bytes:
    """A dictionary from the serialized ids of at most ``sample`` documents' first ``chars`` characters, those of the smallest hashes.

    Only compression depends on it. Too few samples: their ids as they are; none: no bytes.
    """

    def train(batches):
        enc = encoder(tokenizer, REMEMBER, added)
        end = np.array([end_id], enc.dtype).tobytes()
        bits = [x + end for b in batches for x in enc.encode_many(b["text"].to_pylist())]
        try:
            data = zstandard.train_dictionary(size, bits).as_bytes()
        except (zstandard.ZstdError, ValueError):
            data = b"".join(bits)[:size]
        yield pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})

    picked = docs.select(F.substring("text", 1, chars).alias("text"), F.xxhash64("doc_id", "text").alias("h")).orderBy("h").limit(sample)
    return next((bytes(r.data) for r in picked.coalesce(1).mapInArrow(train, "data binary").collect()), b"")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class _Writer:
    def __init__(self, uri: str, item: int, dictionary: bytes):
        where, path = filesystem(uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out = uri, where.open_output_stream(path, compression=None)
        self.out.write(MAGIC + bytes([item]) + hashlib.sha256(dictionary).digest())
        self.at, self.ids, self.null, self.counts, self.offsets = HEAD, [], [], [], [HEAD]

    def add(self, doc_id: int | None, frame: bytes, n: int) -> None:
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.counts.append(n)
        self.offsets.append(self.at)

    def close(self) -> tuple[str, int, int]:
        n = len(self.ids)
        self.out.write(np.array(self.ids, "<i8").tobytes() + np.array(self.null, "u1").tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes() + struct.pack("<QQ", n, self.at) + MAGIC)
        self.out.close()
        return self.uri, n, sum(self.counts)


class TokenFile:
    """Opens one file; ``document(i)`` reads and decompresses the i-th document alone."""

    def __init__(self, uri: str, dictionary: bytes):
        where, path = filesystem(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        head, tail = self.file.read_at(HEAD, 0), self.file.read_at(16 + len(MAGIC), size - 16 - len(MAGIC))
        if head[: len(MAGIC)] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        if head[len(MAGIC) + 1 :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.dtype = np.dtype(f"<u{head[len(MAGIC)]}")
        n, at = struct.unpack("<QQ", tail[:16])
        raw = self.file.read_at(size - 16 - len(MAGIC) - at, at)
        self.ids, self.null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n)
        self.counts, self.offsets = np.frombuffer(raw, "<u8", n, 9 * n), np.frombuffer(raw, "<u8", n + 1, 17 * n)
        self.unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(self.unzip.decompress(self.file.read_at(b - a, a)), self.dtype)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, file_bytes: int = FILE_BYTES, level: int = 3, added: bool = False) -> tuple[DataFrame, bytes]:
    """Writes ``docs(doc_id, text)``; returns the files (``part, file, uri, docs, tokens``, in order of part and file) and the dictionary.

    Documents are dealt by ranges of doc_id, null first; rows that share an id keep together by text and may lie in several
    parts, so that no id is too large for a task. A file name holds a fresh id: a repeated task writes new files, and only those of
    the attempt that Spark took are listed. Null texts are empty and have the end id alone. Empty table: no files.
    ``added``: the strings of added tokens get those tokens' ids, as ``Tokenizer.encode`` gives them; else they are ordinary text.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(source, tokenizer, end_id, added=added)
    folder = scratch(spark, "token-files")

    def write(batches):
        enc = encoder(tokenizer, REMEMBER, added)
        end = np.array([end_id], enc.dtype).tobytes()
        zipper = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))
        part, file, out, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), enc.encode_many(batch["text"].to_pylist()), strict=True):
                if out is None:
                    out = _Writer(f"{folder}/part-{part:06d}-{file:05d}-{uuid.uuid4().hex}.tok", enc.dtype.itemsize, dictionary)
                data = ids + end
                out.add(doc_id, zipper.compress(data), len(data) // enc.dtype.itemsize)
                if out.at >= file_bytes:
                    done.append((part, file, *out.close()))
                    file, out = file + 1, None
        if out is not None:
            done.append((part, file, *out.close()))
        names = ("part", "file", "uri", "docs", "tokens")
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in done], pa.string() if n == "uri" else pa.int64()) for i, n in enumerate(names)})

    dealt = source.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(dealt.mapInArrow(write, "part long, file long, uri string, docs long, tokens long"), "token-manifest"), dictionary


def running_start(files: DataFrame, chunk: int = 1000) -> DataFrame:
    """Adds ``start``: the tokens of all files before, by sums over runs of parts, then over the runs."""
    runs = files.withColumn("run", F.expr(f"part div {chunk}"))
    inside = F.sum("tokens").over(Window.partitionBy("run").orderBy("part", "file")) - F.col("tokens")
    totals = runs.groupBy("run").agg(F.sum("tokens").alias("t"))
    before = totals.select("run", (F.sum("t").over(Window.orderBy("run")) - F.col("t")).alias("before"))
    return runs.withColumn("inside", inside).join(before, "run").withColumn("start", F.col("inside") + F.col("before")).drop("run", "inside", "before")


def read_token_files(spark: SparkSession, files: DataFrame, dictionary: bytes, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32[, ids]`` of every document, a file to a task at a time; ``start``: the ids of all documents before it."""
    fields = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * ids

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist(), strict=True):
                f, rows, held = TokenFile(uri, dictionary), [], 0
                for i in range(len(f)):
                    x = f.document(i)
                    rows.append((None if f.null[i] else int(f.ids[i]), start, len(x), zlib.crc32(x.astype("<u4").tobytes()), x.astype(np.int64))[: len(fields)])
                    start, held = start + len(x), held + len(x)
                    if held > 1_000_000 or i + 1 == len(f):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)
                        rows, held = [], 0

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return running_start(files).select("uri", "start").repartition(partitions(spark), "uri").mapInArrow(read, schema)
