"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words, toxic and ordinary, have their own counts at the highest order and share all lower orders:
where a class has not seen a context, both fall back to the same continuation counts, and a rare expression says
little. A text is judged by its length-normalised log-likelihood ratio and that of its most telling word; a logistic curve,
fitted on labelled texts that the models have not seen, turns both into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, crc_bucket, texts

WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
DISCOUNT, SYMBOLS = 0.75, 1 << 16


def words_of(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased."""
    return text.translate(WORDS).split()


def grams_of(word: bytes, order: int) -> list[str]:
    """Each character of ``^word$`` after the first with up to ``order - 1`` characters before it."""
    w = "^" + word.decode(errors="replace") + "$"
    return [w[max(0, i - order + 1) : i + 1] for i in range(1, len(w))]


def _codes(joined: str, ends: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """For each end in the joined text its last characters, the last one first, mixed to 64 bits; 0 beyond its size."""
    c = (np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    c = (c ^ (c >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([np.where(sizes > r, c[np.maximum(ends - 1 - r, 0)], np.uint64(0)) for r in range(order)], 1)


class _Table:
    """Sums of number columns by 64-bit key, in sorted arrays."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.columns = [np.bincount(inverse, c, len(self.keys)) for c in columns]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys)) for _ in self.columns]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return [np.where(self.keys[at] == keys, c[at], 0.0) for c in self.columns]


class KneserNey:
    """Interpolated Kneser-Ney: ``grams`` are (gram, ordinary count, toxic count) of the highest order, or shorter at a word's start.

    Grams are 64-bit hashes in sorted arrays, some 100 bytes for a gram with all its contexts, so none has to be dropped.
    """

    def __init__(self, grams: list[tuple[str, int, int]], order: int):
        self._build([g for g, *_ in grams], np.array([c for _, *c in grams], np.float64).reshape(-1, 2).T, order)

    @classmethod
    def of(cls, names: list[str], counts: np.ndarray, order: int) -> KneserNey:
        """From distinct grams and their counts, a row for each class."""
        out = cls.__new__(cls)
        out._build(names, counts, order)
        return out

    def _build(self, names: list[str], counts: np.ndarray, order: int):
        self.order, self.weights = order, np.random.default_rng(5).integers(1 << 63, 1 << 64, order, np.uint64) | np.uint64(1)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        codes = _codes("".join(names), np.cumsum(sizes), sizes, order)
        whole, context = self._hashes(codes)
        self.top = _Table(whole[:, -1], *counts)
        self.contexts = _Table(context[:, -1], *counts, *(counts > 0).astype(float))
        # from the longest down: what stands before each shorter gram, counted once a distinct extension
        follow, follow_context, follow_n = [], [], []
        level = codes[:0]
        for n in range(order, 1, -1):
            level = np.r_[level, codes[sizes == n]]
            level = level[np.unique(self._hashes(level)[0][:, n - 1], return_index=True)[1]]
            level[:, n - 1] = 0
            whole, context = self._hashes(level)
            _, first, many = np.unique(whole[:, n - 2], return_index=True, return_counts=True)
            level = level[first]
            follow.append(whole[first, n - 2])
            follow_context.append(context[first, n - 2])
            follow_n.append(many)
        n = np.concatenate(follow_n).astype(float)
        self.follow = _Table(np.concatenate(follow), n)
        self.follow_contexts = _Table(np.concatenate(follow_context), n, np.ones(len(n)))

    def _hashes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the last 1, 2, ... characters: the hash, and that of all but the last of them."""
        context = np.zeros_like(codes)
        np.cumsum(codes[:, 1:] * self.weights[:-1], 1, out=context[:, 1:])
        return np.cumsum(codes * self.weights, 1), context

    def _shared(self, whole: np.ndarray, context: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        p = np.full(len(sizes), 1 / SYMBOLS)
        for i in range(self.order):
            total, types = self.follow_contexts.find(context[:, i])
            (n,) = self.follow.find(whole[:, i])
            p = np.where((sizes > i) & (total > 0), (np.maximum(n - DISCOUNT, 0) + DISCOUNT * types * p) / np.maximum(total, 1), p)
        return p

    def _ratios(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        whole, context = self._hashes(codes)
        low = self._shared(whole, context, sizes - 1)
        found = self.contexts.find(context[:, -1])
        out = [np.where(n > 0, (np.maximum(top - DISCOUNT, 0) + DISCOUNT * types * low) / np.maximum(n, 1), low) for top, n, types in zip(self.top.find(whole[:, -1]), found[:2], found[2:], strict=True)]
        return np.log(out[1] / out[0])

    def shared(self, gram: str) -> float:
        """The probability of the last character after those before, from both classes' continuation counts."""
        size = np.array([len(gram)])
        return float(self._shared(*self._hashes(_codes(gram, size, size, self.order)), size)[0])

    def ratio(self, gram: str) -> float:
        """log P(toxic) - log P(ordinary) of the last character after those before."""
        size = np.array([len(gram)])
        return float(self._ratios(_codes(gram, size, size, self.order), size)[0])

    def word_ratios(self, words: list[bytes], step: int = 1 << 16) -> np.ndarray:
        """The sum over each word's grams, at most ``step`` grams at a time."""
        marked = ["^" + w.decode(errors="replace") + "$" for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        joined = "".join(marked)
        word = np.repeat(np.arange(len(words)), sizes - 1)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1) + 2  # characters up to the gram's end
        start = np.cumsum(sizes) - sizes
        out = np.zeros(len(words))
        for i in range(0, len(word), step):
            w, n = word[i : i + step], place[i : i + step]
            low = int(start[w[0]] + max(0, n[0] - self.order))
            ends, many = start[w] + n - low, np.minimum(n, self.order)
            codes = _codes(joined[low : int(ends[-1]) + low], ends, many, self.order)
            _, first, same = np.unique(self._hashes(codes)[0][:, -1], return_index=True, return_inverse=True)
            out += np.bincount(w, self._ratios(codes[first], many[first])[same], len(words))
        return out


class _Ratios(dict):
    """Log-likelihood ratios of words, kept up to a bound."""

    def __init__(self, model: KneserNey):
        super().__init__()
        self.model = model

    def of(self, words: list[bytes]) -> np.ndarray:
        """Of each word, in stretches."""
        out = np.empty(len(words))
        for i in range(0, len(words), 1 << 16):
            part = words[i : i + (1 << 16)]
            if len(self) > 250_000:
                self.clear()
            new = list({w for w in part if w not in self})
            if new:
                self.update(zip(new, self.model.word_ratios(new).tolist(), strict=True))
            out[i : i + len(part)] = np.fromiter(map(self.__getitem__, part), np.float64, len(part))
        return out


def features(rows: Iterable[bytes], ratios: _Ratios) -> np.ndarray:
    """For each text the ratio a character of the whole, and the largest ratio of a word; (0, 0) without words."""
    out: list[tuple[float, float]] = []

    def add(group: list[list[bytes]]):
        r, at = ratios.of([w for words in group for w in words]), 0
        for words in group:
            part = r[at : at + len(words)]
            at += len(words)
            out.append((float(part.sum() / (sum(map(len, words)) + len(words))), float(part.max())) if words else (0.0, 0.0))

    group, n = [], 0
    for t in rows:
        group.append(words_of(t))
        n += len(group[-1])
        if n >= 1 << 14:
            add(group)
            group, n = [], 0
    add(group)
    return np.array(out).reshape(-1, 2)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of standardised features and the intercept, by Newton steps; returned for raw features."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        penalty = ridge * np.r_[np.ones(x.shape[1]), 0]
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (weight * (y - p)) - penalty * b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[b[:-1] / sd, b[-1] - (b[:-1] * mean / sd).sum()]


class ToxicityModel:
    """A Kneser-Ney pair and its curve; ``column(text)`` scores in Spark."""

    def __init__(self, pair: KneserNey | None, curve: np.ndarray):
        self.pair, self.curve = pair, curve

    def scores(self, rows: Iterable[bytes], ratios: _Ratios | None) -> np.ndarray:
        x = np.zeros((sum(1 for _ in rows), 2)) if ratios is None else features(rows, ratios)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:2] + self.curve[2], -700, 700)))

    def column(self, text: Column, spark) -> Column:
        held = spark.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ratios = None if held.value.pair is None else _Ratios(held.value.pair)  # freed with the task
            for rows in batches:
                parts = [held.value.scores(texts(rows.slice(i, 500)), ratios) for i in range(0, len(rows), 500)]
                yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

        return score(text)


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 10_000, order: int = 5) -> ToxicityModel:
    """Learns from ``labels(doc_id, toxic)`` joined to ``docs(doc_id, text)``.

    At most ``per_class`` labelled ids of each class are taken, those of the smallest hashes, so the sample may be broadcast and
    no text moves to meet its label; ids labelled both ways are toxic, null ids and labels are left out. A fifth of
    the sample is kept from the counts for the curve, which weighs classes as all labels have them. All grams of
    the sample are the model. Without texts of both classes every score is the share of toxic labels.
    """
    spark = bounded_batches(docs).sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    picked = spark.createDataFrame([(r["doc_id"], r["toxic"]) for p in picked for r in p.collect()], "id long, toxic int")
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(picked), "id").withColumn("curve", F.pmod(F.xxhash64(F.lit("curve"), "id"), F.lit(5)) == 0)

    def grams(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for t, k in zip(texts(batch["text"]), batch["toxic"].to_pylist(), strict=True):
                found[k].update(words_of(t))
            out: tuple[Counter, Counter] = (Counter(), Counter())
            for k in (0, 1):
                for w, n in found[k].items():
                    for g in grams_of(w, order):
                        out[k][g] += n
            names = list(out[0] | out[1])
            yield pa.RecordBatch.from_pydict({"gram": pa.array(names, pa.string()), "a": pa.array([out[0][g] for g in names], pa.int64()), "b": pa.array([out[1][g] for g in names], pa.int64())})

    counted = sample.where("not curve").select("text", "toxic").mapInArrow(grams, "gram string, a long, b long").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = counted.toArrow()
    counts = np.stack([found[c].to_numpy().astype(np.float64) for c in ("a", "b")])
    share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    flat = np.array([0.0, 0.0, math.log(share / (1 - share))])
    if not all(counts.sum(1)):
        return ToxicityModel(None, flat)
    pair = KneserNey.of(found["gram"].to_pylist(), counts, order)
    held = spark.sparkContext.broadcast(pair)

    def curve_rows(batches):
        ratios = _Ratios(held.value)
        for batch in batches:
            x = features(texts(batch["text"]), ratios).tolist()
            yield pa.RecordBatch.from_pydict({"x": pa.array([a for a, _ in x], pa.float64()), "y": pa.array([b for _, b in x], pa.float64()), "toxic": batch["toxic"].cast(pa.int32())})

    seen = np.array([(r["x"], r["y"], r["toxic"]) for r in sample.where("curve").select("text", "toxic").mapInArrow(curve_rows, "x double, y double, toxic int").collect()]).reshape(-1, 3)
    y = seen[:, 2]
    if not 0 < y.sum() < len(y):
        return ToxicityModel(pair, np.array([20.0, 1.0, flat[2]]))
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    return ToxicityModel(pair, fit_logistic(seen[:, :2], y, weight))


def score_toxicity(docs: DataFrame, model: ToxicityModel, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``, whole texts, nothing moved.

    ``held_out``: the id's crc32 is a multiple of ``folds``. Null and empty texts score what the curve gives for no evidence. Repeated rows and null
    ids (counted as empty text) are kept; other columns are ignored; an empty table gives no rows.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_bucket("doc_id", folds) == 0).alias("held_out"), model.column(F.col("text"), docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def training_labels(labels: DataFrame, folds: int = 5) -> DataFrame:
    """The labels that may be learned from."""
    return labels.where(crc_bucket("doc_id", folds) != 0)
