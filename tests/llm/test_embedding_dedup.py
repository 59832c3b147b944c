import numpy as np

from tessera.llm.embedding_dedup import near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, nid string, m int"


def brute(rows):
    def good(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v, label, *_) in enumerate(rows):
        for j, (_, w, other, *_) in enumerate(rows[:i]):
            if good(v, label) and good(w, other) and label == other and len(v) == len(w):
                a, b = np.array(v, np.float64), np.array(w, np.float64)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    root[find(i)] = find(j)
    out = []
    for i, (d, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, links[i], c, d is not None and d == c))
    return sorted(out, key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), leading=3).collect()), key=str)


def as32(x):
    return [float(v) for v in np.asarray(x, np.float32)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for family in range(25):
        centre = rng.normal(size=12)
        for _ in range(int(rng.integers(1, 30))):
            v = centre + rng.normal(size=12) * rng.choice([0, 0.1, 0.25, 0.4])
            rows.append((len(rows), as32(v * rng.choice([1, 1e-20, 1e15])), int(family % 3), "x", 1))
    rows += [(900, None, 1, "x", 1), (901, [], 1, "x", 1), (902, [0.0] * 12, 1, "x", 1), (903, [None] + [1.0] * 11, 1, "x", 1), (904, [float("nan")] * 12, 1, "x", 1), (905, [float("inf")] * 12, 1, "x", 1)]
    rows += [(906, rows[0][1], None, "x", 1), (None, rows[0][1], 0, "x", 1), (None, None, None, None, None), (3, rows[3][1], rows[3][2], "y", 2), (907, [1.0], 0, "x", 1), (908, [2.0], 0, "x", 1), (909, [-2.0], 0, "x", 1), (910, [-0.0, 1.0], 0, "x", 1), (911, [0.0, 1.0], 0, "x", 1)]
    assert run(spark, rows) == brute(rows)


def test_many_copies_over_several_blocks(spark):
    rng = np.random.default_rng(6)
    same, near = rng.normal(size=16), rng.normal(size=16)
    rows = [(i, as32(same), 1, "x", 1) for i in range(700)] + [(1000 + i, as32(near + rng.normal(size=16) * 0.05), 1, "x", 1) for i in range(1300)]
    got = run(spark, rows)
    assert all(r[1:] == (699, 0, r[0] == 0) for r in got if r[0] < 1000)
    assert {r[2] for r in got if r[0] >= 1000} == {1000} and all(r[1] > 0 for r in got)


def test_empty_and_alone(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0, 2.0], 1, "x", 1)]) == [(5, 0, 5, True)]
    assert run(spark, [(5, None, 1, "x", 1)]) == [(5, 0, 5, True)]
