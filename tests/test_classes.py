"""Box sums, local z-scores, anomalies and class masks against plain loops."""

import math
import random

from tessera.operators.classes import anomalies, box_sums, class_masks, local_z

SCHEMA = "t int, r int, c int, green double, nir double"


def window(cells, k, rows, cols, r, c):
    """The values of a box with replicated edges; what isn't known is left out."""
    return [cells[x] for dr in range(-k, k + 1) for dc in range(-k, k + 1) if (x := (min(max(r + dr, 0), rows - 1), min(max(c + dc, 0), cols - 1))) in cells]


def test_box_sums_with_gaps_edges_and_a_box_wider_than_the_raster(spark):
    rnd = random.Random(5)
    for rows, cols, k in ((6, 4, 1), (5, 7, 2), (3, 2, 4), (1, 1, 1)):
        cells = {(t, r, c): float(rnd.randrange(100)) for t in (1, 2) for r in range(rows) for c in range(cols) if rnd.random() < 0.7} | {(3, 0, 0): 7.0}
        rows_in = [(*x, v, None) for x, v in cells.items()] + [(None, 0, 0, 1.0, 1.0), (1, -1, 0, 5.0, 5.0), (1, 0, cols, 5.0, 5.0), (2, None, 0, 5.0, 5.0)]
        got = {(x.t, x.r, x.c): (x.box_green, x.box_nir) for x in box_sums(spark.createDataFrame(rows_in, SCHEMA), "t", ["green", "nir"], k, rows, cols).collect()}
        for t in {t for t, _, _ in cells}:
            mine = {(r, c): v for (u, r, c), v in cells.items() if u == t}
            for r in range(rows):
                for c in range(cols):
                    assert got.pop((t, r, c)) == (sum(window(mine, k, rows, cols, r, c)), 0.0)
        assert not got


def test_local_z_against_loops(spark):
    rnd = random.Random(6)
    cells = {(r, c): rnd.uniform(0, 50) for r in range(9) for c in range(8) if rnd.random() < 0.6}
    data = [(1, r, c, v, v) for (r, c), v in cells.items()] + [(1, 8, 8, None, 1.0), (2, 0, 0, 1.0, 1.0)]  # a null value, a scene too dry
    got = {(x.r, x.c): x.z_green for x in local_z(spark.createDataFrame(data, SCHEMA), "t", ["green", "nir"], 2, 9, 9, least_wet=2).collect()}
    assert got.keys() == cells.keys()
    for (r, c), v in cells.items():
        near = window(cells, 2, 9, 9, r, c)
        if len(near) <= 0.05 * 25:
            assert got[r, c] is None
        else:
            mean = sum(near) / len(near)
            assert math.isclose(got[r, c], (v - mean) / math.sqrt(max(1e-6, sum(x * x for x in near) / len(near) - mean * mean)), abs_tol=1e-6)


def test_a_lone_pixel_has_no_background_and_is_no_hit(spark):
    z = local_z(spark.createDataFrame([(1, 5, 5, 90.0, 90.0), (1, 0, 0, 1.0, 1.0)], SCHEMA), "t", ["green", "nir"], 4, 11, 11, least_wet=1)
    assert [(x.r, x.c) for x in z.where("z_green is null").collect()] == [(5, 5)]  # the other is repeated by the edges
    assert {tuple(x) for x in anomalies(z.where("z_green is null")).collect()} == {(5, 5, 1, 0, 0.0, 0.0)}


def test_classes_in_order_of_precedence(spark):
    def looks(r, lows, highs):
        return [(r, 0, x, True, False) for x in lows] + [(r, 0, x, False, True) for x in highs]

    data = looks(0, [True] * 4, [True] * 2 + [False] * 2)  # 6 of 8: exposed before drawdown
    data += looks(1, [True] * 4, [False] * 4)  # drawdown before rock
    data += looks(2, [True] * 3, [False] * 5)  # three looks at low stage are too few
    data += looks(3, [False] * 4, [False] * 4) + looks(4, [False] * 4, [False] * 4) + looks(5, [False] * 4, [False] * 4)
    data += looks(6, [True], [True])  # seldom seen
    found = [(r, 0, 8, 6, 0.75, z) for r, z in ((1, 3.0), (2, 3.0), (3, 0.99), (4, 1.0))] + [(5, 0, 7, 7, 1.0, 2.0)]  # the last: too few water looks
    out = class_masks(spark.createDataFrame(data, "r int, c int, land boolean, low boolean, high boolean"), spark.createDataFrame(found, "r int, c int, obs long, hits long, frac double, nir_z double"), least_seen=8)
    assert sorted((x.r, x.cls, x.conf) for x in out.collect()) == [(0, "exposed", 0.75), (1, "drawdown", 1.0), (2, "rock", 0.75), (3, "shoal", 0.75), (4, "rock", 0.75)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    z = local_z(none, "t", ["green", "nir"], 2, 5, 5)
    assert z.count() == 0 and anomalies(z).count() == 0
    assert class_masks(spark.createDataFrame([], "r int, c int, land boolean, low boolean, high boolean"), anomalies(z)).count() == 0
