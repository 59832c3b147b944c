import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import lm_scoring
from tessera.llm.lm_scoring import MARK, Lattice, score_documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(lattice, text):
    """Sums over all ways, one by one."""
    if not text:
        return [((), 0.0)]
    out = []
    for k in range(1, len(text) + 1):
        heads = []
        if text[:k] in lattice.ids:
            i = lattice.ids[text[:k]]
            heads.append(((i,), lattice.logs[i]))
        if k == 1:
            b = tuple(lattice.byte_ids[x] for x in text[0].encode())
            heads.append((b, sum(lattice.logs[i] for i in b)))
        out += [(h + t, x + y) for h, x in heads for t, y in segmentations(lattice, text[k:])]
    return out


def test_lattice_against_all_segmentations():
    lattice = Lattice.from_vocabulary(PIECES)
    words = ["the", "a", "straße", "漢", "zq", "\x00", "being", "x" * 6]
    for w, got in zip(words, lattice.log_probabilities(words), strict=True):
        assert got == pytest.approx(math.log(sum(math.exp(x) for _, x in segmentations(lattice, MARK + w))))
    expected = np.zeros(len(lattice.logs) - 1)
    for w, n in zip(words, range(1, 9), strict=True):
        ways = segmentations(lattice, MARK + w)
        whole = sum(math.exp(x) for _, x in ways)
        for ids, x in ways:
            for i in ids:
                expected[i] += n * math.exp(x) / whole
    assert lattice.expected_counts(words, np.arange(1.0, 9)) == pytest.approx(expected)


def test_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = ["The", "cat", "étude", "reading", "zzqx", "漢字", "of", "und"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(40))), 0.5) for i in range(120)]
    rows += [(None, None, 1.0), (4, rows[4][1], 2.0), (500, "", 1.0), (501, "only here\tTWICE twice", 1.0), (502, "long " * 30_000, 1.0)]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string, score double"), PIECES, hot_words=20).collect()

    def held(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2

    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for d, t, _ in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    first = Lattice.from_vocabulary(PIECES)
    inner = [w for w in counts if w is not None]
    pieces = first.expected_counts([w.decode() for w in inner], np.array([float(counts[w]) for w in inner]))
    usable = np.isfinite(first.logs[:-1])
    mass = pieces.sum() + counts[None] + 0.1 * (usable.sum() + 1)
    with np.errstate(divide="ignore"):
        model = Lattice(first.ids, first.byte_ids, np.log(np.where(usable, pieces + 0.1, 0) / mass))
    assert np.exp(model.logs[:-1]).sum() + (counts[None] + 0.1) / mass == pytest.approx(1)
    expected = []
    for d, t, _ in rows:
        x = tokens(t)
        s = sum(model.log_probabilities([w.decode() for w in x if w is not None])) / math.log(10) + math.log10((counts[None] + 0.1) / mass)
        expected.append((d, held(d), len(x), sum(counts[w] > 0 for w in x), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), s))
    key = lambda r: (str(r[0]), r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_empty_table_and_nothing_to_learn(spark):
    schema = "doc_id long, text string"
    assert score_documents(spark.createDataFrame([], schema), PIECES).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = score_documents(spark.createDataFrame([(held, "word")], schema), PIECES).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0) and -40 < r.score < 0


def test_words_of_any_length(spark, monkeypatch):
    rnd = random.Random(3)
    lattice = Lattice.from_vocabulary(PIECES)
    words = ["".join(rnd.choice("etaoin shrdlué漢".replace(" ", "")) for _ in range(n)) for n in (1, 40, 255, 256, 300, 700)]
    counts = np.arange(1.0, 7)
    whole, expected = lattice.log_probabilities(words), lattice.expected_counts(words, counts)
    monkeypatch.setattr(lm_scoring, "LONG", 8)
    monkeypatch.setattr(lm_scoring, "STRETCH", 50)  # stretches shorter than words
    assert lattice.log_probabilities(words) == pytest.approx(whole)
    assert lattice.expected_counts(words, counts) == pytest.approx(expected)


def test_one_word_of_a_million_characters(spark):
    docs = spark.createDataFrame([(1, "Q2FmZQ" * 170_000), (2, "short")], "doc_id long, text string")
    rows = {r.doc_id: r for r in score_documents(docs, PIECES).collect()}
    assert rows[1].n_tokens == 2 and -5e6 < rows[1].score < -1e6 and -40 < rows[2].score < 0
