"""Fill-in-middle: a document is cut at two token boundaries and put in another order around markers.

The boundaries of a text's tokens are a set of code-point offsets held as containers of 65,536 offsets each: sorted arrays,
bitmaps or runs, whichever is smallest, with cumulative cardinalities. The offset after k tokens is a search for the container and a
select inside it, so a set takes at most 8 KB for 65,536 code points, however the tokens lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LOW = 1 << 16
WORDS = LOW // 64


class _Array:
    """Few offsets: their low halves in order."""

    def __init__(self, low: np.ndarray):
        self.low = low

    def select(self, k: int) -> int:
        return int(self.low[k])


class _Runs:
    """Offsets in stretches: first offset of each and how many lie before it."""

    def __init__(self, first: np.ndarray, before: np.ndarray):
        self.first, self.before = first, before

    def select(self, k: int) -> int:
        i = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[i]) + k - int(self.before[i])


class _Bitmap:
    """Many offsets: a bit each, and how many lie before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(LOW, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))[:-1]].astype(np.int32)

    def select(self, k: int) -> int:
        i = int(np.searchsorted(self.before, k, "right")) - 1
        inside = np.unpackbits(self.words[i : i + 1].view(np.uint8), bitorder="little")
        return i * 64 + int(np.flatnonzero(inside)[k - int(self.before[i])])


def _container(low: np.ndarray):
    starts = np.r_[0, np.flatnonzero(np.diff(low) != 1) + 1]
    if 4 * len(starts) < min(2 * len(low), 8 * WORDS):
        return _Runs(low[starts].astype(np.uint16), starts.astype(np.int32))
    return _Array(low.astype(np.uint16)) if 2 * len(low) <= 8 * WORDS else _Bitmap(low)


class BoundarySet:
    """An ascending set of offsets with ``select``."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        at = np.r_[0, np.flatnonzero(np.diff(high)) + 1]
        self.keys = high[at]
        self.before = at
        self.size = len(offsets)
        self.containers = [_container(part & (LOW - 1)) for part in np.split(offsets, at[1:])]

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        i = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[i]) << 16) + self.containers[i].select(k - int(self.before[i]))


def token_boundaries(text: str) -> BoundarySet:
    """0 and the end of each token ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, in code points."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = (points == 0x20) | (points - np.uint32(9) < 5)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return BoundarySet(np.r_[0, ends, [len(points)] if len(points) else []].astype(np.int64))


def _number(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs(doc_id, text)``.

    ``n`` counts tokens; ``form`` is plain, psm or spm, drawn for each document from the sha256 of ``seed:doc_id`` (``rate``: hundredths that are cut;
    ``spm``: hundredths of those that are spm). Empty texts and texts that hold a marker stay plain, with null counts and the text as
    output. Null text: empty; null doc_id: drawn as an empty id. Repeated rows give equal results, an empty table none, other columns are
    ignored. Rows never move; texts of any length are cut whole.
    """

    @F.arrow_udf("n long, prefix long, upto long")
    def cut(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        out = np.empty((3, len(text)), np.int64)
        for i, (t, h1, h2) in enumerate(zip(text, first.to_numpy(), second.to_numpy(), strict=True)):
            bounds = token_boundaries(t.as_py())
            a, b = sorted((int(h1) % bounds.size, int(h2) % bounds.size))
            out[:, i] = bounds.size - 1, bounds.select(a), bounds.select(b)
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "prefix", "upto"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text("doc_id")).cast("binary"), 256)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_h", digest)
    rows = rows.withColumn("_cut", cut("text", _number(F.col("_h"), 0), _number(F.col("_h"), 1)))
    text = F.col("text")
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (_number(F.col("_h"), 2) % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(_number(F.col("_h"), 3) % 100 < spm, "spm").otherwise("psm"))
    a, b = F.col("_cut.prefix").cast("int"), F.col("_cut.upto").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.length(text))
    moved = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    moved = moved.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(text)
    counted = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return rows.select("doc_id", F.col("_cut.n").alias("n"), "form", counted(a).alias("prefix_chars"), counted(b - a).alias("middle_chars"), moved.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; markers stand nowhere else in it."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """``made`` with output_sha256 and restored_sha256 in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    made = made.withColumn("_back", restored(F.col("output"), F.col("form")))
    return made.withColumn("output_sha256", sha(F.col("output"))).withColumn("restored_sha256", sha(F.col("_back"))).drop("output", "_back")


ORACLE_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens from documents
), g as (
  select *, len(tokens) as n, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2, ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4 from t
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from g
), p as (
  select *, array_to_string(tokens[1:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle, array_to_string(tokens[b + 1:n], '') as suffix from c
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p"""
