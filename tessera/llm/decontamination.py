"""Benchmark decontamination by a BM25 inverted index of test items with block-max bounds.

Impacts are BM25 weights divided by the item's score against itself, so one threshold serves all items and a passage
that holds a whole item scores 1. Every passage of every text is a query, its width that of the item's length up to a doubling. Postings are grouped into blocks of items with their
largest impact. As in WAND, an item's commonest terms, whose impacts together stay below a share of the threshold, open
nothing; for the others the block maxima of a passage's terms add up to a bound, and only blocks that reach the
threshold with it are scored. What scores is verified: word runs of both the item's question and its answer must stand in the passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, stored, texts

WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
K1, B = 1.2, 0.75
BLOCK = 4
#: Words of a text that are searched at once.
STRETCH = 1 << 18


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def runs(words: list[bytes], k: int = 3) -> set[tuple[bytes, ...]]:
    """Distinct runs of k words; with fewer words, the whole."""
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last sentence, a third of the item's words at least; the question is what stands before, or the whole if nothing does."""
    words = words_of(text)
    last = words_of(re.split(rb"[.!?\n]+\s*", text.strip().rstrip(b".!?\n"))[-1])
    cut = len(words) - max(len(last), -(-len(words) // 3))
    return words[:cut] or words, words[cut:]


@dataclass
class Hit:
    item_id: int | None
    start: int
    score: float
    question: float
    answer: float


@dataclass
class ItemStatistics:
    """Of the whole table of items that aren't blank: how many hold a word, how many there are, their words."""

    held: dict[bytes, int]
    items: int
    words: int


@dataclass
class ItemIndex:
    """The index of a slice of items; ``search(words)`` gives the best verified passage of each item.

    Items are shelved by length, a doubling each, so how wide an item's passages are depends on that item alone. ``whole`` are the statistics of
    the table that the slice is of (of the slice's words, at least); without them the slice is the table.
    """

    items: list[tuple[int | None, bytes]]
    threshold: float = 0.6
    overlap: float = 0.5
    common: float = 0.25
    whole: ItemStatistics | None = None

    def __post_init__(self):
        # blank items match nothing
        split = [(i, t, w) for i, t in self.items if (w := words_of(t))]
        whole = self.whole or ItemStatistics(Counter(x for *_, w in split for x in set(w)), len(split), sum(len(w) for *_, w in split))
        by: dict[int, list] = {}
        for row in split:
            by.setdefault(1 << (len(row[2]) - 1).bit_length(), []).append(row)
        self.shelves = [Shelf(rows, step, self.threshold, self.overlap, self.common, whole) for step, rows in sorted(by.items())]
        self.items, self.whole = [], None  # not to be broadcast

    def search(self, words: list[bytes]) -> list[Hit]:
        return [h for shelf in self.shelves for h in shelf.search(words)]


@dataclass
class Shelf:
    """Items ``split`` (id, text, words) of up to ``step`` words: passages of two steps, one step apart, hold any of them whole."""

    split: list[tuple[int | None, bytes, list[bytes]]]
    step: int
    threshold: float
    overlap: float
    common: float
    whole: ItemStatistics | None
    terms: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        split, whole = self.split, self.whole
        self.names = [i for i, _, _ in split]
        self.parts = [tuple(map(runs, question_and_answer(t))) for _, t, _ in split]
        for x in sorted({x for *_, w in split for x in w}):
            self.terms[x] = len(self.terms)
        self.split, self.whole = [], None  # not to be broadcast
        held, all_items, mean = whole.held, whole.items, whole.words / max(1, whole.items)
        n = len(split)
        self.impacts: list[dict[int, float]] = []
        self.needed = np.full(-(-n // BLOCK), np.inf)
        best: dict[tuple[int, int], float] = {}
        for i, (*_, w) in enumerate(split):
            tf = Counter(w)
            weight = {x: math.log(1 + (all_items - held[x] + 0.5) / (held[x] + 0.5)) * m * (K1 + 1) / (m + K1 * (1 - B + B * len(w) / mean)) for x, m in tf.items()}
            most = sum(weight.values())
            self.impacts.append({self.terms[x]: v / most for x, v in weight.items()})
            mass = 0.0
            for x in sorted(weight, key=lambda x: (-held[x], x)):
                share = weight[x] / most
                if mass + share <= self.common:  # opens nothing by itself
                    mass += share
                    continue
                key = (self.terms[x], i // BLOCK)
                best[key] = max(best.get(key, 0.0), share)
            self.needed[i // BLOCK] = min(self.needed[i // BLOCK], self.threshold - mass - 1e-9)
        order = sorted(best)
        self.block = np.array([b for _, b in order], np.int64)
        self.largest = np.array([best[k] for k in order])
        self.first = np.searchsorted(np.array([t for t, _ in order], np.int64), np.arange(len(self.terms) + 1))

    def search(self, words: list[bytes]) -> list[Hit]:
        best: dict[int, Hit] = {}
        for at in range(0, max(1, len(words)), max(self.step, STRETCH // self.step * self.step)):
            for i, h in self._stretch(words, at, min(len(words), at + max(self.step, STRETCH // self.step * self.step) + self.step)):
                if i not in best or (h.score, -h.start) > (best[i].score, -best[i].start):
                    best[i] = h
        return [best[i] for i in sorted(best)]

    def _stretch(self, words: list[bytes], low: int, high: int):
        part = words[low:high]
        find = self.terms.get
        tid = np.array([find(w, -1) for w in part], np.int64)
        at = np.flatnonzero(tid >= 0)
        t = tid[at]
        many = self.first[t + 1] - self.first[t]
        if not many.any():
            return
        rep = np.repeat(np.arange(len(t)), many)
        entry = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many) + self.first[t][rep]
        window, term, block, largest = at[rep] // self.step, t[rep], self.block[entry], self.largest[entry]
        # a word lies in the passage that starts in its step and in the one before
        window, term, block, largest = np.r_[window, window - 1], np.r_[term, term], np.r_[block, block], np.r_[largest, largest]
        blocks = len(self.needed)
        _, once = np.unique((np.maximum(window, 0) * blocks + block) * len(self.terms) + term, return_index=True)
        place, inverse = np.unique(np.maximum(window[once], 0) * blocks + block[once], return_inverse=True)
        bound = np.bincount(inverse, largest[once])
        for p in place[bound >= self.needed[place % blocks]].tolist():
            start, b = p // blocks * self.step, p % blocks
            inside = set(tid[start : start + 2 * self.step].tolist())
            found = None
            for i in range(b * BLOCK, min((b + 1) * BLOCK, len(self.names))):
                score = sum(v for x, v in self.impacts[i].items() if x in inside)
                if score < self.threshold:
                    continue
                if found is None:
                    found = runs(part[start : start + 2 * self.step])
                q, a = (len(x & found) / len(x) for x in self.parts[i])
                if q >= self.overlap and a >= self.overlap:
                    yield i, Hit(self.names[i], low + start, score, q, a)


def _words(parts: DataFrame) -> DataFrame:
    """``part, word, items, words`` of ``parts(part, text)``: the items that hold each word; for the null word, of all items, and their words."""

    def count(batches):
        for batch in batches:
            found: dict[tuple[int, bytes | None], list[int]] = {}
            for part, t in zip(batch["part"].to_pylist(), texts(batch["text"]), strict=True):
                if w := words_of(t):
                    for x in (None, *set(w)):
                        row = found.setdefault((part, x), [0, 0])
                        row[:] = row[0] + 1, row[1] + len(w)
            keys, rows = list(found), list(found.values())
            columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(2))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "word", "items", "words"])

    counted = parts.select("part", "text").mapInArrow(count, "part long, word binary, items long, words long")
    return counted.groupBy("part", "word").agg(F.sum("items").alias("items"), F.sum("words").alias("words"))


def indexes(items: DataFrame, slice_items: int = 20_000, **options) -> Iterator[ItemIndex]:
    """Indexes of ``items(item_id, text)`` in slices of about ``slice_items``, each small enough to be broadcast; null texts match nothing.

    Statistics are of the whole table, so a score doesn't depend on the slices.
    """
    rows = bounded_batches(items).select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = -(-rows.count() // slice_items)
    if n > 1:  # dealt once, repeated items too
        rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(n))), "items")
        by_part = stored(_words(rows), "item-words")
        by_word = stored(by_part.groupBy("word").agg(F.sum("items").alias("items"), F.sum("words").alias("words")), "item-words")
        top = by_word.where("word is null").first()
    for k in range(n):
        own, whole = rows, None
        if n > 1:
            own = rows.where(F.col("part") == k)
            held = by_word.join(by_part.where((F.col("part") == k) & F.col("word").isNotNull()).select("word"), "word").select("word", "items").collect()
            whole = None if top is None else ItemStatistics({bytes(r["word"]): r["items"] for r in held}, top["items"], top["words"])
        yield ItemIndex([(r["item_id"], r["text"].encode()) for r in own.orderBy("item_id", "text").collect()], whole=whole, **options)


def contaminated_passages(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, passage_start, score, question_overlap, answer_overlap``: each document's best verified passage for each item it leaks.

    ``passage_start`` counts words. Rows of ``docs(doc_id, text)`` without a leak don't appear, so null and empty texts
    and an empty table give no rows, nor do null and blank items. Repeated documents and repeated items appear each, null ids are kept, other
    columns are ignored. The table of test items is read in slices, a pass over the texts for each, which ends before the next but one is built; no text moves.
    """
    fields = ["doc_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"]
    schema = "doc_id long, item_id long, passage_start long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    done: list[DataFrame] = []
    built = indexes(items, **options)
    index = next(built, None)
    while index is not None:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                rows = [(d, h.item_id, h.start, h.score, h.question, h.answer) for d, t in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True) for h in held.value.search(words_of(t))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.float64()) for i, c in enumerate(zip(*rows, strict=True))], names=fields)

        found, index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), next(built, None)
        if index is None and not done:  # all in one slice
            return found
        done.append(stored(found, "passages"))
        held.destroy()
    for found in done:
        out = out.unionByName(found)
    return out


def _leaks(held):
    @F.arrow_udf("boolean")
    def leaks(rows: pa.Array) -> pa.Array:
        return pa.array([bool(held.value.search(words_of(t))) for i in range(0, len(rows), 500) for t in texts(rows.slice(i, 500))], pa.bool_())

    return leaks


def is_contaminated(text: Column, items: DataFrame, **options) -> Column:
    """Whether a text leaks an item; for filters that keep all columns."""
    out = F.lit(False)
    for index in indexes(items, **options):
        out = out | _leaks(items.sparkSession.sparkContext.broadcast(index))(text)
    return out
