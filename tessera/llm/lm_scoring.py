"""Language-model scores by subword lattices.

The vocabulary is an existing one; its scores give the first weights of its pieces, which one round of expected counts over all
training words turns into probabilities. A text's probability is the product over its words and its end; a word's
is the sum over all its segmentations into pieces, by a forward recursion in log space, with bytes for what no piece covers.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_bucket, stored, texts

MARK = "▁"  # opens a word
MULTIPLIER, SLOTS = np.uint64(0x9E3779B97F4A7C15), 22
#: Characters of short words that are handled at once, and of a long word; words from ``LONG`` characters on are walked one by one; no character.
STRETCH, LONG, PAD = 1 << 16, 256, 0xFFFFFFFF


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Lattice:
    """Pieces by text, each with an id; ``logs[id]`` is its natural log probability.

    Pieces are found by rolling hashes of all substrings up to the longest piece, looked up in one sorted array and then
    compared letter by letter, so that Python sees no substring.
    """

    def __init__(self, ids: dict[str, int], byte_ids: list[int], logs: np.ndarray):
        self.ids, self.byte_ids = ids, byte_ids
        self.longest = max(map(len, ids), default=1)
        self.logs = np.append(logs, -np.inf)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        letters = np.zeros((len(ids), self.longest), np.uint32)
        row = np.repeat(np.arange(len(ids)), sizes)
        letters[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = _codes("".join(ids))
        h = np.zeros(len(ids), np.uint64)
        for i in range(self.longest):
            h = np.where(sizes > i, h * MULTIPLIER + _mixed(letters[:, i]), h)
        order = np.argsort(h)
        self.keys, self.letters, self.sizes = h[order], letters[order], sizes[order]
        self.names = np.fromiter(ids.values(), np.int64, len(ids))[order]
        self.maybe = np.zeros(1 << SLOTS, bool)
        self.maybe[(h >> np.uint64(64 - SLOTS)).astype(np.int64)] = True
        self.spelt: dict[int, float] = {}

    @classmethod
    def from_vocabulary(cls, path: str) -> Lattice:
        """The vocabulary's own weights: a piece of score -r weighs 1 / (r + 10), a byte as much as the last piece."""
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, byte_ids, weights = {}, [0] * 256, np.zeros(sp.get_piece_size())
        least = min(sp.get_score(i) for i in range(len(weights)))
        for i in range(len(weights)):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
                weights[i] = 1 / (10 - least)
            elif not sp.is_control(i) and not sp.is_unknown(i):
                ids[sp.id_to_piece(i)] = i
                weights[i] = 1 / (10 - sp.get_score(i))
        with np.errstate(divide="ignore"):
            return cls(ids, byte_ids, np.log(weights / weights.sum()))

    def _pieces(self, codes: np.ndarray, step: int = 1):
        """Lengths, ends and ids of all pieces in ``codes``, a word's letters ``step`` apart, by length."""
        v, h = _mixed(codes), np.zeros(len(codes), np.uint64)
        for k in range(1, min(self.longest, len(codes) // step) + 1):
            h[step:] = h[:-step] * MULTIPLIER
            h[:step] = 0
            h += v
            low = (k - 1) * step
            at = np.flatnonzero(self.maybe[(h[low:] >> np.uint64(64 - SLOTS)).view(np.int64)]) + low
            found = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            good = (self.keys[found] == h[at]) & (self.sizes[found] == k)
            at, found = at[good], found[good]
            good = (codes[at[:, None] + step * np.arange(1 - k, 1)] == self.letters[found, :k]).all(1)
            yield k, at[good], self.names[found[good]]

    def _spelt(self, letter: int) -> float:
        """The log weight of a character spelt in bytes."""
        if letter not in self.spelt:
            self.spelt[letter] = float(sum(self.logs[self.byte_ids[b]] for b in chr(letter).encode()))
        return self.spelt[letter]

    def _count(self, total: np.ndarray, letters: np.ndarray, share: np.ndarray) -> None:
        """Adds what is expected of letters spelt in bytes."""
        for c, x in zip(letters.tolist(), share.tolist(), strict=True):
            if c != PAD and x:
                for b in chr(c).encode():
                    total[self.byte_ids[b]] += x

    def _batches(self, words: list[str]):
        """Indices of short marked words in ascending length and batches of bounded size, and of long ones alone."""
        batch: list[int] = []
        for i in sorted(range(len(words)), key=lambda i: len(words[i])):
            if batch and (len(words[i]) >= LONG or len(words[i]) * (len(batch) + 1) > STRETCH):
                yield batch
                batch = []
            batch.append(i)
        if batch:
            yield batch

    def _short(self, words: list[str], counts: np.ndarray | None, total: np.ndarray | None) -> np.ndarray:
        """Log probabilities of short words in ascending length; with counts, adds the expected uses of pieces to ``total``.

        Letters, and the nodes between them, are rows of a matrix with a column for each word, padded at the end.
        """
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        rows = int(sizes[-1])
        word = np.repeat(np.arange(n), sizes)
        grid = np.full((rows, n), PAD, np.uint32)
        grid[np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes), word] = _codes("".join(words))
        codes = grid.ravel()
        letters, same = np.unique(codes, return_inverse=True)
        spelt = np.array([0.0 if c == PAD else self._spelt(c) for c in letters.tolist()])[same].reshape(rows, n)
        first = np.searchsorted(sizes, np.arange(rows), side="right").tolist()  # the first word that has a letter there
        pieces = [(k, at, self.logs[ids], ids, np.searchsorted(at, np.arange(rows + 1) * n).tolist()) for k, at, ids in self._pieces(codes, n)]
        alpha = np.full((rows + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(rows):
            row, w = alpha[j + 1], first[j]
            row[w:] = alpha[j, w:] + spelt[j, w:]
            for k, at, weight, _, cut in pieces[: j + 1]:
                low, high = cut[j], cut[j + 1]
                if low < high:
                    t = at[low:high] - j * n
                    row[t] = np.logaddexp(row[t], alpha[j + 1 - k, t] + weight[low:high])
        out = alpha[sizes, np.arange(n)]
        if counts is None:
            return out
        beta = np.full((rows + 1, n), -np.inf)
        beta[sizes, np.arange(n)] = 0
        for j in range(rows - 1, -1, -1):
            row, w = beta[j], first[j]
            row[w:] = beta[j + 1, w:] + spelt[j, w:]
            for k, at, weight, _, cut in pieces[: rows - j]:
                low, high = cut[j + k - 1], cut[j + k]
                if low < high:
                    t = at[low:high] - (j + k - 1) * n
                    row[t] = np.logaddexp(row[t], beta[j + k, t] + weight[low:high])
        before, after = alpha.ravel(), beta.ravel()
        for k, at, weight, ids, _ in pieces:
            w = at % n
            total += np.bincount(ids, np.exp(before[at + (1 - k) * n] + weight + after[at + n] - out[w]) * counts[w], len(total))
        share = np.exp(alpha[:-1] + spelt + beta[1:] - out) * counts
        self._count(total, letters, np.bincount(same, share.ravel(), len(letters)))
        return out

    def _long(self, word: str, count: float, total: np.ndarray | None) -> float:
        """As ``_short`` for one word of any length, a stretch at a time; kept are the values at the stretches' edges."""
        reach, size = self.longest, len(word)
        carried = [np.r_[np.full(reach, -np.inf), 0.0]]  # the forward values of the last nodes before each stretch
        edges = lambda at: self._stretch_edges(word, at, min(size, at + STRETCH))
        for at in range(0, size, STRETCH):
            carried.append(self._walk(carried[-1], *edges(at)[:3])[-reach - 1 :])
        whole = float(carried[-1][-1])
        if total is None:
            return whole
        after = np.r_[np.full(reach, -np.inf), 0.0]  # the backward values of the nodes up to the stretch's end
        for i, at in reversed(list(enumerate(range(0, size, STRETCH)))):
            to, source, weight, ids, codes = edges(at)
            alpha = self._walk(carried[i], to, source, weight)
            last = len(alpha) - 1
            beta = self._walk(after[::-1], last - source, last - to, weight, last + 1)[::-1]
            share = np.exp(alpha[source] + weight + beta[to] - whole) * count
            total += np.bincount(ids[ids >= 0], share[ids >= 0], len(total))
            letters, same = np.unique(codes, return_inverse=True)
            self._count(total, letters, np.bincount(same, share[ids < 0], len(letters)))
            after = beta[: reach + 1]
        return whole

    def _stretch_edges(self, word: str, at: int, end: int):
        """Edges that end in a stretch of a word, between nodes counted from ``longest`` before it, pieces' before those spelt in bytes (id -1); its letters."""
        before = min(at, self.longest)
        codes = _codes(word[at - before : end])
        found = [(e[e >= before], k, ids[e >= before]) for k, e, ids in self._pieces(codes)]
        own = np.arange(before, len(codes))
        letters, same = np.unique(codes[before:], return_inverse=True)
        stop = np.concatenate([*(e for e, _, _ in found), own])
        k = np.concatenate([*(np.full(len(e), k) for e, k, _ in found), np.ones(len(own), np.int64)])
        ids = np.concatenate([*(i for *_, i in found), np.full(len(own), -1)])
        weight = np.r_[self.logs[ids[ids >= 0]], np.array([self._spelt(c) for c in letters.tolist()])[same]]
        to = stop - before + self.longest + 1
        return to, to - k, weight, ids, codes[before:]

    @staticmethod
    def _walk(known: np.ndarray, to: np.ndarray, source: np.ndarray, weight: np.ndarray, nodes: int | None = None) -> np.ndarray:
        """Forward values of a stretch's nodes after the ``known`` ones, edge by edge."""
        value = np.full(int(to.max()) + 1 if nodes is None else nodes, -np.inf).tolist()
        value[: len(known)] = known.tolist()
        exp, log1p, low = math.exp, math.log1p, -math.inf
        order = np.lexsort((source, to))
        for t, s, w in zip(to[order].tolist(), source[order].tolist(), weight[order].tolist(), strict=True):
            x, y = value[s] + w, value[t]
            if x == low:
                continue
            if y > x:
                x, y = y, x
            value[t] = x + log1p(exp(y - x))
        return np.array(value)

    def _all(self, words: list[str], counts: np.ndarray | None, total: np.ndarray | None) -> np.ndarray:
        marked, out = [MARK + w for w in words], np.empty(len(words))
        for at in self._batches(marked):
            if len(marked[at[0]]) >= LONG:
                out[at[0]] = self._long(marked[at[0]], 0.0 if counts is None else counts[at[0]], total)
            else:
                out[at] = self._short([marked[i] for i in at], None if counts is None else counts[at], total)
        return out

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability over all segmentations."""
        return self._all(words, None, None)

    def expected_counts(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words' segmentations, each word counted so many times."""
        total = np.zeros(len(self.logs) - 1)
        self._all(words, counts, total)
        return total


def word_counts(docs: DataFrame, train: str) -> DataFrame:
    """``word, n`` of all words of ``docs``; n counts those of rows where the boolean column ``train`` holds."""

    def count(batches):
        learned: Counter = Counter()
        seen: set[bytes] = set()

        def out():
            words = list(learned) + [w for w in seen if w not in learned]
            made = pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()).cast(pa.string()), "n": pa.array([learned.get(w, 0) for w in words], pa.int64())})
            learned.clear()
            seen.clear()
            return made

        for batch in batches:
            for t, known in zip(texts(batch["text"]), batch[train].to_pylist(), strict=True):
                (learned if known else seen).update(t.lower().split())
            if len(learned) + len(seen) > 300_000:
                yield out()
        yield out()

    return docs.select("text", train).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, vocabulary: str, modulus: int = 7, held: int = 2, hot_words: int = 400_000, smoothing: float = 0.1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``.

    Tokens: A-Z lower-cased words split at ASCII white space, then one end. Learned from rows whose id's crc32 leaves
    another remainder than ``held``. ``base_score``: add-one unigram log10 probability; ``score``: log10 of the marginal
    lattice probability, piece counts smoothed by ``smoothing``. Null and empty texts are their end alone. Repeated rows and null ids
    (counted as empty text) are kept; other columns are ignored; an empty table gives no rows.

    Words are counted over all rows. The ``hot_words`` commonest travel to the tasks as one table of that size; the others
    are joined by a shuffle, where none is frequent enough to matter, and summed up again by row.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_bucket("doc_id", modulus) == held).alias("held_out"), "text").withColumn("train", ~F.col("held_out"))
    counts = stored(word_counts(source, "train"), "counts")
    ends = source.where("train").count()
    known = counts.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    total, distinct = (known["n"] or 0) + ends, known["v"] + (ends > 0)

    first = Lattice.from_vocabulary(vocabulary)
    given = spark.sparkContext.broadcast((first.ids, first.byte_ids, first.logs[:-1]))

    def expect(batches):
        lattice, sums = Lattice(*given.value), None
        for batch in batches:
            x = lattice.expected_counts(batch["word"].to_pylist(), batch["n"].to_numpy().astype(np.float64))
            sums = x if sums is None else sums + x
        if sums is not None:
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(at, pa.int32()), "x": pa.array(sums[at], pa.float64())})

    # summed as whole numbers of 2 ** -20, so that the order of tasks doesn't matter
    found = counts.where("n > 0").mapInArrow(expect, "piece int, x double").groupBy("piece").agg(F.sum(F.round(F.col("x") * (1 << 20)).cast("decimal(38,0)")).alias("x")).collect()
    pieces = np.zeros(len(first.logs) - 1)
    for r in found:
        pieces[r["piece"]] = float(r["x"]) / (1 << 20)
    usable = np.isfinite(first.logs[:-1])
    if not pieces.any():
        pieces = np.exp(first.logs[:-1])
    mass = pieces.sum() + ends + smoothing * (usable.sum() + 1)
    with np.errstate(divide="ignore"):
        logs = np.log(np.where(usable, pieces + smoothing, 0) / mass)
    end_score = math.log10((ends + smoothing) / mass)
    learned = spark.sparkContext.broadcast((first.ids, first.byte_ids, logs))

    def lattice_scores(batches):
        lattice = Lattice(*learned.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(lattice.log_probabilities(batch["word"].to_pylist()) / math.log(10), pa.float64())], names=["word", "n", "s"])

    words = stored(counts.mapInArrow(lattice_scores, "word string, n long, s double"), "words")
    hot = words.orderBy(F.desc("n"), "word").limit(hot_words).toArrow()
    table = spark.sparkContext.broadcast((hot["word"].cast(pa.binary()).to_pylist(), np.log10(hot["n"].to_numpy() + 1.0), hot["n"].to_numpy() > 0, hot["s"].to_numpy()))
    unit = math.log10(total + distinct + 1)

    def own(batches):
        names, base, seen, score = table.value
        place = {w: i for i, w in enumerate(names)}
        task, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            rows = []
            for t in texts(batch["text"]):
                found = t.lower().split()
                at = list(map(place.get, found))
                rare = Counter(w for w, i in zip(found, at, strict=True) if i is None) if None in at else {}
                i = np.array([x for x in at if x is not None], np.int64)
                rows.append((task + row, len(found) + 1, int(seen[i].sum()) + (ends > 0), float(base[i].sum()) + math.log10(ends + 1), float(score[i].sum()) + end_score, [w.decode() for w in rare], list(rare.values())))
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "b", "s", "rare", "times"])

    part = stored(source.select("doc_id", "held_out", "text").mapInArrow(own, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, b double, s double, rare array<string>, times array<long>"), "scores")
    rare = part.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("m"))
    rest = rare.join(words.withColumnRenamed("s", "word_score"), "word").groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("more_known"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("more_b"), F.sum(F.col("m") * F.col("word_score")).alias("more_s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return part.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("b") + zero("more_b") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("s") + zero("more_s")).alias("score"),
    )
