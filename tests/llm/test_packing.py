import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import best_fit_decreasing, bin_completion, exact_fills, lower_bound, pack, pack_documents, undominated_fillings

WORD = public_tokenizers.path("word_bpe_49k.json")


def fewest(sizes, capacity):
    """By trying everything."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def check_plan(plan, counts, capacity):
    seen = dict.fromkeys(counts, 0)
    for pattern, times in plan:
        assert sum(x * k for x, k in pattern) <= capacity and times > 0
        for x, k in pattern:
            seen[x] += k * times
    assert seen == counts


def test_plans_reach_the_optimum():
    rnd = random.Random(5)
    beaten = 0
    for _ in range(150):
        capacity = rnd.randrange(10, 40)
        sizes = [rnd.randrange(max(1, capacity // 6), capacity + 1) for _ in range(rnd.randrange(1, 11))]
        counts = {x: sizes.count(x) for x in set(sizes)}
        plan = bin_completion(counts, capacity)
        check_plan(plan, counts, capacity)
        check_plan(best_fit_decreasing(counts, capacity), counts, capacity)
        n, best = sum(t for _, t in plan), fewest(sizes, capacity)
        assert lower_bound(counts, capacity) <= best == n
        beaten += n < sum(t for _, t in best_fit_decreasing(counts, capacity))
    assert bin_completion({}, 10) == []


def test_completion_beats_best_fit_decreasing():
    counts = {44: 1, 24: 2, 22: 1, 21: 1, 17: 2, 8: 2, 6: 2}  # total 191 of two sequences of 100
    assert sum(t for _, t in bin_completion(counts, 100)) <= sum(t for _, t in best_fit_decreasing(counts, 100))
    assert undominated_fillings(10, {4: 1, 6: 1, 5: 1, 9: 1, 3: 1}, 5, 6)[0] == (6, 4)


def test_large_counts():
    rnd = random.Random(1)
    counts = {x: rnd.randrange(1, 4000) for x in range(1, 4097)}
    plan = bin_completion(counts, 4096)
    check_plan(plan, counts, 4096)
    assert sum(t for _, t in plan) <= lower_bound(counts, 4096) * 1.005 + 1


def test_documents(spark):
    rnd = random.Random(2)
    words = "the of and reading longest packing ê ß 12 , .".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice((1, 5, 30, 60, 200)))), 0) for i in range(200)]
    rows += [(None, None, 1), (None, None, 1), (5, rows[5][1], 2), (7, "", 3), (300, "long " * 5000, 4)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, offset int"), WORD, capacity=64, ids=True).collect()
    t = Tokenizer.from_file(WORD)
    expected = []
    for d, text, _ in rows:
        x = t.encode(text or "", add_special_tokens=False).ids + [1]
        expected += [(d, i // 64, i, x[i : i + 64]) for i in range(0, len(x), 64)]
    assert sorted(((r.doc_id, r.piece, r.start, r.ids) for r in got), key=str) == sorted(expected, key=str)
    bins = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    counts = {}
    for *_, x in expected:
        counts[len(x)] = counts.get(len(x), 0) + 1
    assert len(bins) == sum(n for _, n in bin_completion(counts, 64))


def test_empty_and_refused(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORD).collect() == []
    with pytest.raises(Exception, match="longer than a sequence"):
        pack(spark.createDataFrame([(9,)], "length long"), 8).collect()


def test_search_goes_on_beyond_a_few_hundred_nodes():
    counts = Counter(np.random.default_rng(5).integers(200, 481, 120).tolist())
    plan = bin_completion(counts, 1000)
    assert sum(n for _, n in plan) == lower_bound(counts, 1000) == 41  # 300 nodes and a width of 16 leave 42
    assert Counter({x: m for x, m in Counter(x for p, n in plan for x, k in p for _ in range(k * n)).items()}) == counts


def test_large_mixes_meet_the_bound_without_a_search():
    beaten = 0
    for seed in range(8):
        counts = Counter(np.minimum(np.random.default_rng(seed).lognormal(5.2, 1.2, 6000).astype(int) + 1, 1000).tolist())
        check_plan(plan := exact_fills(counts, 1000), counts, 1000)
        assert sum(n for _, n in plan) == sum(n for _, n in bin_completion(counts, 1000, effort=0)) == lower_bound(counts, 1000)
        beaten += lower_bound(counts, 1000) < sum(n for _, n in best_fit_decreasing(counts, 1000))
    assert beaten
    for counts in ({1: 100_000}, {4096: 3, 1: 1}, {2048: 5}, {1500: 7, 1366: 4, 1365: 9}):
        check_plan(exact_fills(counts, 4096), counts, 4096)
    assert exact_fills({}, 10) == []


def test_fillings_without_a_gap_reach_spark(spark):
    sizes = [6, 7, 9, 11, 12, 18, 18, 19, 20, 21, 28, 28]  # best-fit decreasing takes 5 sequences; a gap is closed by another piece than the longest
    plan = exact_fills(Counter(sizes), 50)
    assert all(type(v) is int for pattern, times in plan for v in (times, *(y for x in pattern for y in x)))
    got = pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long"), 50).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(sizes))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(bins) == 4
    for b in bins.values():
        ends = [0, *(o + n for o, n in sorted(b))]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 50
