"""WARC archives: writing with revisit records for equal payloads, and parallel reading by boundary chains.

An archive is cut into byte ranges. A task takes every place of its range that looks like the start of a record, magic
inside payloads included, and works out where such a record would end. Only offsets that the chain from the file's start
reaches are records; pointer jumping over the ranges' entries finds them in as many rounds as the logarithm of the ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import filesystem, partitions, scratch, stored, texts

GZIP, PLAIN = b"\x1f\x8b\x08", b"WARC/1."
VERSION = b"WARC/1.1\r\n"
OPENING, OPENS = rb"WARC/1\.\d\r\n", 8
#: A header ends with a blank line; none has a second version line, so a false one is given up at the next.
HEADER_END = re.compile(rb"\r\n(?:\r\n|WARC/1\.\d\r\n)")
#: HEADER_BYTES are read first of a plain record; a longer header is read on.
FILE_BYTES, RANGE_BYTES, HEADER_BYTES = 64 << 20, 4 << 20, 1 << 16
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str | None]], block: bytes, compress: bool) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    data = VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    if not compress:
        return data
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(parts).encode()).digest()[:16])}>"


def response(page_id: int | None, row: int, url: str | None, payload: bytes, compress: bool = True) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", _id(page_id, row)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("X-Page-ID", None if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, http + payload, compress)


def revisit(page_id: int | None, row: int, url: str | None, digest: str, size: int, refers_to: int | None, refers_row: int, compress: bool = True) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", _id(page_id, row)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to, refers_row)), ("X-Refers-To-Page-ID", None if refers_to is None else str(refers_to)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", None if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, http, compress)


def write_warc(pages: DataFrame, least_bytes: int = 0, compress: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages(page_id, url, html)``; returns the archives as ``uri, bytes, records``.

    Of the rows with equal payloads of at least ``least_bytes``, the one with the smallest page_id (null last; repeated
    ids: the first row) is a response and the others revisit it. Null html: an empty payload; null url: no target. Records
    are compressed before they move, responses only once each. A repeated task writes new files; those listed are of the attempt that Spark took.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")

    def make(batches):
        for batch in batches:
            ids, rows, urls = (batch[c].to_pylist() for c in ("page_id", "row", "url"))
            payloads = texts(batch["html"])
            for at in range(0, len(ids), 200):
                part = slice(at, at + 200)
                made = [response(i, r, u, p, compress) for i, r, u, p in zip(ids[part], rows[part], urls[part], payloads[part], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "page_id": pa.array(ids[part], pa.int64()), "row": pa.array(rows[part], pa.int64()), "url": pa.array(urls[part], pa.string()),
                    "size": pa.array([len(p) for p in payloads[part]], pa.int64()), "digest": pa.array([payload_digest(p) for p in payloads[part]], pa.string()), "record": pa.array(made, pa.binary()),
                })

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("row", F.monotonically_increasing_id())
    records = stored(source.select("page_id", "row", "url", "html").mapInArrow(make, "page_id long, row long, url string, size long, digest string, record binary"), "records")
    same = records.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("head"), F.count("*").alias("n"))
    same = same.where("n > 1").select("digest", "size", F.col("head.page_id").alias("head_id"), F.col("head.row").alias("head_row"))
    typed = records.join(same, ["digest", "size"], "left").withColumn("again", F.expr("head_row is not null and head_row <> row")).withColumn("record", F.expr("if(again, null, record)"))

    def write(batches):
        out, uri, done, n, size = None, "", [], 0, 0
        for batch in batches:
            for x in batch.to_pylist():
                data = revisit(x["page_id"], x["row"], x["url"], x["digest"], x["size"], x["head_id"], x["head_row"], compress) if x["again"] else x["record"]
                if out is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' * compress}"
                    where, path = filesystem(uri)
                    where.create_dir(path.rpartition("/")[0], recursive=True)
                    out, n = where.open_output_stream(path, compression=None), 0
                    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id(uri)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", compress)
                    out.write(info)
                    size = len(info)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((uri, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((uri, size, n))
        yield pa.RecordBatch.from_pydict({"uri": pa.array([d[0] for d in done], pa.string()), "bytes": pa.array([d[1] for d in done], pa.int64()), "records": pa.array([d[2] for d in done], pa.int64())})

    return stored(typed.select("page_id", "row", "url", "size", "digest", "head_id", "head_row", "again", "record").mapInArrow(write, "uri string, bytes long, records long"), "archives")


class Archive:
    """Random access to one archive's bytes, in steps."""

    def __init__(self, uri: str, step: int = 1 << 20):
        where, path = filesystem(uri)
        self.file, self.step, self.at, self.data = where.open_input_file(path), step, 0, b""
        self.size = self.file.size()

    def bytes_at(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.at, self.data = at, self.file.read_at(max(0, min(max(n, self.step), self.size - at)), at)
        return self.data[at - self.at : at - self.at + n]

    def candidates(self, start: int, end: int) -> list[int]:
        """Offsets in [start, end) where a record's magic stands."""
        data = self.file.read_at(min(end + len(PLAIN), self.size) - start, start)
        return [start + m.start() for m in re.finditer(b"(?=" + re.escape(GZIP) + b"|" + re.escape(PLAIN) + b")", data) if start + m.start() < end]

    def record(self, at: int) -> tuple[bytes, int] | None:
        """The record that would start here, and its successor's offset; None if there can't be one."""
        if self.bytes_at(at, len(GZIP)) == GZIP:
            z, out, p = zlib.decompressobj(31), [], at
            try:
                while not z.eof:
                    part = self.bytes_at(p, min(self.step, self.size - p))
                    if not part:
                        return None
                    out.append(z.decompress(part))
                    p += len(part)
                    if out and not b"".join(out[:2]).startswith(PLAIN[: sum(map(len, out[:2]))]):
                        return None
            except zlib.error:
                return None
            data = b"".join(out)
            return (data, p - len(z.unused_data)) if _length(data) == len(data) else None
        n, seen = HEADER_BYTES, 0
        while True:  # a header may be of any length
            head = self.bytes_at(at, min(n, self.size - at))
            if not re.match(OPENING, head) or HEADER_END.search(head, max(OPENS, seen)) or n >= self.size - at:
                break
            n, seen = 4 * n, len(head) - OPENS - 4
        n = _length(head)
        return (self.bytes_at(at, n), at + n) if n is not None and at + n <= self.size else None


def _length(head: bytes) -> int | None:
    """A record's whole length by its header, the blank lines after it included."""
    last = HEADER_END.search(head, OPENS) if re.match(OPENING, head) else None
    end = last.start() if last and last[0] == b"\r\n\r\n" else -1
    m = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)", head[: end + 2], re.I) if end >= 0 else None
    return None if m is None else end + 4 + int(m[1]) + 4


def parse_record(data: bytes) -> dict:
    """Headers by lower-cased name, and the block."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode(errors="replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers | {"": data[end + 4 : end + 4 + int(headers["content-length"])]}


def record_entries(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``uri, at, to``: the verified first record of each byte range that has one, and where its chain leaves the range."""
    spark = archives.sparkSession
    ranges = archives.select("uri", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {range_bytes}L)")).alias("start")).where("bytes > 0")

    def emit(batches):
        for batch in batches:
            for uri, size, start in zip(*(batch[c].to_pylist() for c in ("uri", "bytes", "start")), strict=True):
                end = min(start + range_bytes, size)
                f = Archive(uri)
                successor = {at: r[1] for at in f.candidates(start, end) if (r := f.record(at)) is not None}
                leave: dict[int, int] = {}
                for at in sorted(successor, reverse=True):
                    leave[at] = leave.get(successor[at], successor[at])
                at = sorted(successor)
                yield pa.RecordBatch.from_pydict({"uri": pa.array([uri] * len(at), pa.string()), "at": pa.array(at, pa.int64()), "next": pa.array([successor[x] for x in at], pa.int64()), "to": pa.array([leave[x] for x in at], pa.int64())})

    found = stored(ranges.repartition(partitions(spark), "uri", "start").mapInArrow(emit, "uri string, at long, next long, to long"), "candidates")
    # only offsets that some range's chain leads to, and file starts, can be entries
    targets = found.select("uri", F.col("to").alias("at")).union(archives.select("uri", F.lit(0).cast("long"))).distinct()
    entries = stored(found.select("uri", "at", "to").join(targets, ["uri", "at"], "left_semi"), "entries")
    jump, reached, n = entries, stored(entries.where("at = 0").select("uri", "at"), "reached"), -1
    while (now := reached.count()) != n:
        n = now
        ahead = reached.join(jump, ["uri", "at"]).select("uri", F.col("to").alias("at"))
        reached = stored(reached.union(ahead).distinct(), "reached")
        jump = stored(jump.join(jump.select("uri", F.col("at").alias("to"), F.col("to").alias("far")), ["uri", "to"], "left").select("uri", "at", F.coalesce("far", "to").alias("to")), "jump")
    return stored(entries.join(reached, ["uri", "at"]).unionByName(reached.join(archives.select("uri", F.col("bytes").alias("at")), ["uri", "at"]).withColumn("to", F.lit(None).cast("long"))), "entries")


def read_warc(archives: DataFrame, range_bytes: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]`` of every response and revisit record of ``archives(uri, bytes)``.

    Raises where an archive's chain doesn't end at the file's end, or a payload doesn't have its digest.
    """
    entries = record_entries(archives, range_bytes)
    broken = archives.where("bytes > 0").join(entries.where("to is null"), "uri", "left_anti").limit(1).collect()
    if broken:
        raise ValueError(f"the records of {broken[0]['uri']} don't lead to its end")
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(fields)]

    def read(batches):
        for batch in batches:
            for uri, at, to in zip(*(batch[c].to_pylist() for c in ("uri", "at", "to")), strict=True):
                f, rows = Archive(uri), []
                while at < to:
                    data, at = f.record(at)
                    x = parse_record(data)
                    kind = x["warc-type"]
                    if kind in ("response", "revisit"):
                        head, _, body = x[""].partition(b"\r\n\r\n")
                        digest = x["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and payload_digest(body) != digest:
                            raise ValueError(f"a payload of {uri} doesn't have its digest")
                        size = len(body) if kind == "response" else int(re.search(rb"Content-Length: (\d+)", head)[1])
                        number = lambda name, x=x: int(x[name]) if name in x else None
                        rows.append((number("x-page-id"), x.get("warc-target-uri"), size, digest, kind, number("x-refers-to-page-id"), body if kind == "response" else None)[: len(fields)])
                    if rows and (len(rows) >= 200 or at >= to):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return entries.where("to is not null").repartition(partitions(archives.sparkSession), "uri", "at").mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """What the archives of ``pages`` hold when read back."""
    return read_warc(write_warc(pages)).drop("url")


#: What ``round_trip`` gives in DuckDB's SQL; five hexadecimal digits are four of base32.
ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select *, upper(sha1(body)) as h, min(page_id) over (partition by body) as least from p)
select page_id, octet_length(encode(body))::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - i % 4 * 5)) & 31) + 1)::int, 1)), '') as payload_digest,
  case when page_id = least then 'response' else 'revisit' end as record_type, case when page_id <> least then least end as refers_to
from d"""
