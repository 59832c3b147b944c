import math

import numpy as np
import pytest

from tessera.llm.maxscore import Shard, _index, top_inner_products

SCHEMA = "vec_id long, embedding array<double>, label int, v string, shard int, score string"


def brute(rows, k=5):
    held = {}
    for name, v, *_ in rows:
        if name is not None and v is not None and all(x is not None and math.isfinite(x * 256) for x in v):
            held[name] = min(held.get(name, v), v)
    ints = {n: [math.floor(256 * x) for x in v] for n, v in held.items()}
    out = []
    for n in ints:
        if n % 50 == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(ints[n], w, strict=False)))), m) for m, w in ints.items() if m != n)[:k]
            out += [(n, i + 1, m, -s) for i, (s, m) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)
    return sorted(map(tuple, top_inner_products(df, **more).collect()))


@pytest.mark.parametrize("kind", ["dense", "sparse", "wide"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        v = rng.normal(size=12) * 0.2
        if kind == "sparse":
            v = np.where(rng.random(12) < 0.8, 0, np.abs(v))
        if kind == "wide":
            v = v * rng.choice([1, 1e5, 1e9, 1e13])
        rows.append((i, [float(x) for x in np.round(v, 2)][: int(rng.integers(8, 13))]))
    rows += [(1000, None), (1050, []), (1100, [None, 1.0]), (1150, [float("nan")]), (1200, [float("inf")]), (None, [1.0] * 12), (1250, [1e306] * 12), (-50, rows[3][1]), (1300, [0.0] * 12)]
    rows += [rows[50], rows[51], (50, [9.0]), (1301, rows[100][1]), (1302, rows[100][1])]
    for more in ({"cells": 700, "slice_cells": 60, "seeds": 20}, {}):
        assert run(spark, rows, **more) == brute(rows)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0])]) == []
    rows = [(0, [1.0, 2.0]), (50, [2.0]), (7, [-1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_rows_outside_essential_lists_are_never_visited():
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.where(rng.random((4000, 40)) < 0.93, 0, np.abs(rng.normal(size=(4000, 40)))))
    shard = Shard(np.arange(4000), x, **_index(x))
    for n in range(0, 200, 10):
        scores = x @ x[n]
        scores[n] = -1
        least = float(np.sort(scores)[-5])
        ids, found = shard.top(n, x[n], 5, least)
        assert set(np.flatnonzero(scores >= least)) <= set(ids.tolist()) | set(np.flatnonzero(scores < max(least, np.sort(found)[-5])))
        assert sorted(found)[-5:] == sorted(scores)[-5:]
    assert shard.skipped > 5 * shard.visited
