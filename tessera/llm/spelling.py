"""Spelling variants: words of a corpus that differ by one code point, each led to its commonest neighbour.

Every word's edits are generated from one side (a letter less, or a letter replaced by a later one, so each pair of words is met once) as
rolling hashes, without strings. They probe blocked Bloom filters of the vocabulary, one for each length, which are broadcast: 512-bit blocks in
which a word sets a bit in each of eight lanes. Only hits become strings and are shuffled to an exact join with the vocabulary, which removes
false positives. Filters are cut into passes of fixed size, so what is broadcast doesn't grow with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_text, salted_join, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
#: What a letter may be replaced by: a to z and U+00C0 to U+00FF.
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint64)
BASE = 0x9E3779B97F4A7C15
LANES = 8
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)  # odd multipliers, one a lane
CHUNK = 1 << 20


def words_of(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """``word`` for each run of letters in ``docs(doc_id, text)`` that has ``least`` code points or more after A-Z are lowered and, where ``every`` divides the
    crc32 ``h`` of ``doc_id:run``, the code point ``h % length`` is deleted."""
    # a run of too few letters can't gain any, and the pattern takes runs whole
    runs = docs.select(id_text("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    p = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), p), F.substring(F.col("run"), p + 2, F.length("run")))
    return h.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def _powers(n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i], x = x, x * BASE & (1 << 64) - 1
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _lane_bits(h: np.ndarray, lane: int) -> np.ndarray:
    return np.uint64(1) << ((((h & np.uint64(0xFFFFFFFF)) * SALTS[lane]) & np.uint64(0xFFFFFFFF)) >> np.uint64(26))


def bucket_of(length: int) -> int:
    """The filter of words of a length: their own up to 63, one for each doubling beyond."""
    return length if length < 64 else 58 + length.bit_length()


def _bits_a_word(bucket: int) -> int:
    """Longer words have more edits, so fewer of them may be false hits."""
    return 16 if bucket < 32 else 32 if bucket < 69 else 64


class Piece:
    """Blocks ``low`` to ``high`` of a bucket's ``blocks``, from row ``start`` of a pass's filter."""

    def __init__(self, bucket: int, blocks: int, low: int, high: int, start: int):
        self.bucket, self.blocks, self.low, self.high, self.start = bucket, blocks, low, high, start


def passes_of(counts: dict[int, int], limit: int) -> list[dict[int, Piece]]:
    """Buckets' filters dealt to passes of ``limit`` blocks at most; a bucket with more is cut."""
    out: list[dict[int, Piece]] = []
    room = 0
    for bucket, n in sorted(counts.items()):
        blocks = max(1, -(-n * _bits_a_word(bucket) // 512))
        low = 0
        while low < blocks:
            if room == 0:
                out.append({})
                room = limit
            high = min(blocks, low + room)
            out[-1][bucket] = Piece(bucket, blocks, low, high, limit - room)
            room -= high - low
            low = high
    return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of the words of each length, in chunks."""
    size = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    start = np.r_[0, np.cumsum(size)[:-1]]
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        step = max(1, CHUNK // (length * len(ALPHABET)))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, points[start[part, None] + np.arange(length)].astype(np.uint64)


def _filter(vocabulary: DataFrame, pieces: dict[int, Piece]) -> np.ndarray:
    """The filter of a pass, a row of eight lanes for each block."""

    def own(batches):
        powers = _powers(16)
        for batch in batches:
            keys, hashes = [], []
            for _, w in _by_length(batch.column(0).to_pylist()):
                piece = pieces.get(bucket_of(w.shape[1]))
                if piece is None:
                    continue
                if w.shape[1] > len(powers):
                    powers = _powers(2 * w.shape[1])
                h = _mixed(w @ powers[: w.shape[1]])
                b = _block(h, piece.blocks)
                mine = (b >= piece.low) & (b < piece.high)
                keys.append(b[mine] - piece.low + piece.start)
                hashes.append(h[mine])
            if not sum(map(len, keys)):
                continue
            key, h = np.concatenate(keys), np.concatenate(hashes)
            order = np.argsort(key)
            key, h = key[order], h[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lanes = {f"m{i}": np.bitwise_or.reduceat(_lane_bits(h, i), first).view(np.int64) for i in range(LANES)}
            yield pa.RecordBatch.from_pydict({"block": key[first], **lanes})

    schema = "block long, " + ", ".join(f"m{i} long" for i in range(LANES))
    got = vocabulary.select("word").mapInArrow(own, schema).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"m{i}") for i in range(LANES)]).toArrow()
    out = np.zeros((max((p.start + p.high - p.low for p in pieces.values()), default=0), LANES), np.uint64)
    for i in range(LANES):
        out[got["block"].to_numpy(), i] = got[f"m{i}"].to_numpy().view(np.uint64)
    return out


def _held(h: np.ndarray, piece: Piece, lanes: np.ndarray) -> np.ndarray:
    """Places in ``h`` (mixed) of keys that the piece's blocks may hold."""
    b = _block(h, piece.blocks)
    at = np.flatnonzero((b >= piece.low) & (b < piece.high)) if piece.low or piece.high < piece.blocks else np.arange(len(h))
    row = b[at] - piece.low + piece.start
    for i in range(LANES):
        ok = np.flatnonzero(lanes[row, i] & _lane_bits(h[at], i))
        at, row = at[ok], row[ok]
    return at


def _edits(w: np.ndarray, powers: np.ndarray, pieces: dict[int, Piece], lanes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """``row, position, letter`` (no letter: deleted) of the edits of equally long words ``w`` that the pass may hold."""
    n, size = w.shape
    t = w * powers[:size]
    whole = t.sum(1, dtype=np.uint64)
    if (piece := pieces.get(bucket_of(size))) is not None:
        step = max(1, CHUNK // (n * len(ALPHABET)))
        for low in range(0, size, step):
            part = w[:, low : low + step]
            row, at, letter = np.nonzero(ALPHABET > part[:, :, None])
            h = whole[row] + (ALPHABET[letter] - part[row, at]) * powers[low + at]
            hit = _held(_mixed(h), piece, lanes)
            yield row[hit], at[hit] + low, ALPHABET[letter[hit]]
    if size > 1 and (piece := pieces.get(bucket_of(size - 1))) is not None:
        before = np.cumsum(t, 1, dtype=np.uint64) - t
        moved = w[:, 1:] * powers[: size - 1]
        after = np.zeros_like(w)
        after[:, :-1] = np.cumsum(moved[:, ::-1], 1, dtype=np.uint64)[:, ::-1]
        row, at = np.nonzero(np.c_[w[:, 1:] != w[:, :-1], np.ones(n, bool)])  # of a run of equal letters only the last
        hit = _held(_mixed((before + after)[row, at]), piece, lanes)
        yield row[hit], at[hit], None


def _candidates(vocabulary: DataFrame, pieces: dict[int, Piece]) -> DataFrame:
    """``word, n, other``: edits of vocabulary words that a pass's filter holds, false hits among them, written out."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(_filter(vocabulary, pieces))

    def probe(batches):
        lanes, powers = sent.value, _powers(16)
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for places, w in _by_length(words):
                if w.shape[1] > len(powers):
                    powers = _powers(2 * w.shape[1])
                for row, at, letter in _edits(w, powers, pieces, lanes):
                    if not len(row):
                        continue
                    source = places[row]
                    new = [""] * len(row) if letter is None else list(map(chr, letter.tolist()))
                    other = [words[s][:i] + x + words[s][i + 1 :] for s, i, x in zip(source.tolist(), at.tolist(), new, strict=True)]
                    yield pa.RecordBatch.from_pydict({"word": [words[s] for s in source.tolist()], "n": counts[source], "other": other})

    made = stored(vocabulary.select("word", "n").mapInArrow(probe, "word string, n long, other string"), "edits")
    sent.destroy()
    return made


def near_words(vocabulary: DataFrame, blocks: int = 1 << 18) -> DataFrame:
    """``word, n, other, other_n``: each unordered pair of words of ``vocabulary(word, n)`` (no repeats) that differ by exactly one inserted, deleted or replaced code point, once."""
    length = F.char_length("word")
    bucket = F.when(length < 64, length).otherwise(F.length(F.bin(length)) + 58)  # as bucket_of
    counts = {r["bucket"]: r["count"] for r in vocabulary.groupBy(bucket.cast("int").alias("bucket")).count().collect()}  # 90 rows at most
    found = None
    for pieces in passes_of(counts, blocks):
        part = _candidates(vocabulary, pieces)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vocabulary.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).where(F.lit(False))
    return found.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: pointers are doubled until none moves; counts grow along them, so a handful of rounds do."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = stored(salted_join(now, ahead, ["root"], by="word", how="left"), "jumps")
        if moved.where("far is not null").limit(1).count() == 0:
            return now
        now = moved.select("word", F.coalesce("far", "root").alias("root"))


def spelling_variants(docs: DataFrame, least: int = 7, seen: int = 2, ratio: int = 10, every: int = 31, blocks: int = 1 << 18) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``docs(doc_id, text)`` that occurs ``seen`` times or more.

    Words are those of ``words_of``. ``form``: the near word of largest count (ties: the smallest in code-point order) if that is at least ``ratio``
    times the word's own, else null; ``root``: the last word that forms lead to; ``n_near``: how many near words there are. Null texts hold no words, a
    null doc_id counts as empty text, repeated rows count again, words of any length are compared whole. An empty table gives no rows; other
    columns are ignored. ``blocks``: 64-byte blocks of filter that are broadcast at once.
    """
    vocabulary = stored(words_of(docs, least, every).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen), "words")
    pairs = near_words(vocabulary, blocks)
    both = F.array(F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    ends = pairs.select(F.explode(both).alias("e")).select("e.*")
    best = F.min_by(F.struct("other", "other_n"), F.struct((-F.col("other_n")).alias("m"), "other"))
    near = ends.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = F.col("best.other_n") >= ratio * F.col("n")
    formed = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, F.col("best.other_n")).alias("form_n"))
    formed = stored(formed, "forms")
    out = formed.join(_roots(formed.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _nibbles() -> list[int]:
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: crc32 goes over half bytes, the lower first; near words meet under a wildcard for each position and under their deletions.
ORACLE_SQL = f"""
with recursive runs as (
  select coalesce(doc_id::varchar, '') || ':' as id, unnest(regexp_extract_all(text, '[{LETTERS}]{{7,}}')) as run from documents
), low as (
  select id, translate(run, '{UPPER}', '{LOWER}') as run, count(*) as m from runs group by all
), hexed as (
  select *, hex(encode(id || run)) as x from low
), summed as (
  select run, m, xor(4294967295::ubigint, list_reduce(list_concat([4294967295::ubigint], list_transform(range(len(x)), lambda i: (instr('0123456789ABCDEF', x[case when i % 2 = 0 then i + 2 else i end]) - 1)::ubigint)),
    lambda c, b: xor(cast({_nibbles()} as ubigint[])[(xor(c, b) & 15)::bigint + 1], c >> 4)))::bigint as h from hexed
), edited as (
  select case when h % 31 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word, m from summed
), v as (
  select word, sum(m)::bigint as n from edited where length(word) >= 7 group by word having sum(m) >= 2
), places as (
  select word, n, unnest(range(1, length(word) + 1)) as i from v
), wild as (
  select word, n, word[1:i - 1] || '*' || word[i + 1:] as k from places
), less as (
  select distinct word, n, word[1:i - 1] || word[i + 1:] as k from places
), near as (
  select a.word, b.word as other, b.n as other_n from wild a join wild b on a.k = b.k and a.word <> b.word
  union all select a.word, b.word, b.n from less a join v b on a.k = b.word
  union all select b.word, a.word, a.n from less a join v b on a.k = b.word
), ranked as (
  select *, row_number() over (partition by word order by other_n desc, other) as rn, count(*) over (partition by word) as n_near from near
), formed as (
  select v.word, v.n, coalesce(r.n_near, 0)::bigint as n_near, case when r.other_n >= 10 * v.n then r.other end as form, case when r.other_n >= 10 * v.n then r.other_n end as form_n
  from v left join ranked r on v.word = r.word and r.rn = 1
), walk as (
  select word, form as last from formed where form is not null
  union all
  select w.word, f.form from walk w join formed f on w.last = f.word where f.form is not null
), ends as (
  select w.word, w.last from walk w join formed f on w.last = f.word where f.form is null
)
select f.word, f.form, coalesce(e.last, f.word) as root, f.n, f.n_near, f.form_n from formed f left join ends e on f.word = e.word"""
