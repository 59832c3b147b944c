import random

import numpy as np
import pytest

from tessera.llm.toxicity import KneserNey, fit_logistic, grams_of, score_toxicity, train_toxicity, training_labels


def corpus(n, seed):
    rnd = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to io le is ou ar as de".split()
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 120))]
        if toxic:
            for _ in range(1 + len(words) // 40):
                words.insert(rnd.randrange(len(words)), "zux" + rnd.choice(syllables) + rnd.choice(syllables))
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500, 1)
    docs = spark.createDataFrame(rows + [(None, None, None), (5000, "", 0.1), (7, rows[7][1], 0.2)], "doc_id long, text string, score double")
    marked = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, train_toxicity(docs, training_labels(marked))).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) + 3 and 200 < len(held) < 400
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert [r.predicted for r in got if r.doc_id in (None, 5000)] == [0, 0]
    assert len({r.score for r in got if r.doc_id == 7}) == 1


def test_empty_tables_and_one_class(spark):
    docs = spark.createDataFrame([(1, "word"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score_toxicity(docs, train_toxicity(docs, none)).collect()] == pytest.approx([0.5, 0.5])
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in score_toxicity(docs, train_toxicity(docs, one)).collect())
    assert score_toxicity(docs.limit(0), train_toxicity(docs.limit(0), none)).collect() == []


def test_long_text(spark):
    rows, labels = corpus(300, 2)
    model = train_toxicity(spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    docs = spark.createDataFrame([(1, "thererin " * 200_000)], "doc_id long, text string")
    assert score_toxicity(docs, model).first().predicted == 0


def test_shared_probabilities_sum_to_one():
    counts = {}
    for word in (b"abab", b"abba", b"cab"):
        for g in grams_of(word, 4):
            counts[g] = counts.get(g, 0) + 1
    m = KneserNey([(g, n, n % 2) for g, n in counts.items()], 4)
    for context in ("", "a", "ab", "zz"):
        known = sum(m.shared(context + c) for c in "abc$")
        assert known == pytest.approx(1 - (2**16 - 4) * m.shared(context + "一"))
    assert m.ratio("zzzz") == 0


def brute(counted, order, discount=0.75):
    """log P(toxic) - log P(ordinary) of a gram by sums over all grams, from ``counted(gram -> (ordinary, toxic))``."""
    seen = {g[-n:] for g in counted for n in range(2, len(g) + 1)}
    before = {}
    for s in seen:
        before[s[1:]] = before.get(s[1:], 0) + 1

    def shared(gram):
        p = 1 / 65536
        for n in range(1, len(gram) + 1):
            s = gram[-n:]
            same = [m for x, m in before.items() if len(x) == n and x[:-1] == s[:-1]]
            if same:
                p = (max(before.get(s, 0) - discount, 0) + discount * len(same) * p) / sum(same)
        return p

    def of(gram, k):
        low = shared(gram[1:])
        same = [c[k] for x, c in counted.items() if x[:-1] == gram[:-1] and c[k]]
        return (max(counted.get(gram, (0, 0))[k] - discount, 0) + discount * len(same) * low) / sum(same) if same else low

    return shared, lambda gram: np.log(of(gram, 1) / of(gram, 0))


def test_ratios_against_brute_force():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 9))).encode()
    for order in (2, 3, 5):
        counted = {}
        for _ in range(60):
            k = rnd.randrange(2)
            for g in grams_of(word(), order):
                now = counted.setdefault(g, [0, 0])
                now[k] += 1
        m = KneserNey([(g, *c) for g, c in counted.items()], order)
        shared, ratio = brute(counted, order)
        words = [word() for _ in range(40)] + [b"zz", b"abz", b"a"]
        for g in {g for w in words for g in grams_of(w, order)}:
            assert m.ratio(g) == pytest.approx(ratio(g), abs=1e-9)
            assert m.shared(g[1:]) == pytest.approx(shared(g[1:]))
        assert m.word_ratios(words) == pytest.approx([sum(map(ratio, grams_of(w, order))) for w in words], abs=1e-9)


def test_logistic():
    x = np.array([[0.0, 1], [1, 0], [2, 1], [3, 0]])
    b = fit_logistic(x, np.array([0, 0, 1, 1.0]), np.ones(4))
    assert (x @ b[:2] + b[2] > 0).tolist() == [False, False, True, True]


def test_no_gram_of_the_sample_is_dropped(spark):
    rnd = random.Random(3)
    ordinary, toxic = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(210_000)), "毒性表現例"
    rows = [(i, ordinary if i < 14 else toxic) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = train_toxicity(docs, spark.createDataFrame([(i, int(i >= 14)) for i, _ in rows], "doc_id long, toxic int"))
    assert model.pair.ratio(toxic) > 0 > model.pair.ratio(ordinary[-5:])
    assert {r.doc_id: r.predicted for r in score_toxicity(docs, model).collect()} == {i: int(i >= 14) for i, _ in rows}
