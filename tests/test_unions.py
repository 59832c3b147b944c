"""Unions of boxes against cells of a small raster."""

import random

import pytest

from tessera.operators.unions import bare_sides, box_union


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2


def rings_of(spark, boxes):
    got = {}
    for r in box_union(spark.createDataFrame(boxes, "x0 double, y0 double, x1 double, y1 double, way string")).orderBy("ring", "pos").collect():
        got.setdefault((r.ring, r.hole), []).append((r.x, r.y))
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_random_boxes(spark, seed):
    rnd = random.Random(seed)
    boxes = [(float(x), float(y), float(x + rnd.randint(1, 6)), float(y + rnd.randint(1, 6)), "w") for x, y in ((rnd.randint(0, 24), rnd.randint(0, 24)) for _ in range(45))]
    boxes += boxes[:5]
    covered = {(x, y) for x0, y0, x1, y1, _ in boxes for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))}
    got = rings_of(spark, boxes)
    assert sum(area(p) for p in got.values()) == len(covered)
    assert all((area(p) < 0) == hole for (_, hole), p in got.items())
    length = sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for p in got.values() for a, b in zip(p, p[1:] + p[:1], strict=True))
    assert length == sum((x + dx, y + dy) not in covered for x, y in covered for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0)))


def test_a_frame_has_a_hole_and_unknown_boxes_none(spark):
    frame = [(0.0, 0.0, 9.0, 1.0, ""), (0.0, 8.0, 9.0, 9.0, ""), (0.0, 0.0, 1.0, 9.0, ""), (8.0, 1.0, 9.0, 8.0, ""), (3.0, 3.0, 3.0, 9.0, ""), (None, 0.0, 1.0, 1.0, "")]
    got = rings_of(spark, frame)
    assert sorted((hole, len(p), area(p)) for (_, hole), p in got.items()) == [(False, 4, 81.0), (True, 4, -49.0)]
    assert rings_of(spark, frame[4:]) == {}


def test_pieces_of_one_box(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2.0, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, bare_sides(df).collect())) == [(0, 0.0, 0.0, 2.0, 0.0), (1, 2.0, 0.0, 2.0, 1.0), (2, 2.0, 1.0, 0.0, 1.0), (3, 0.0, 1.0, 0.0, 0.0)]


def test_crowded_boxes_meet_only_along_the_rim(spark, tmp_path, monkeypatch):
    from tessera.operators import unions

    rnd = random.Random(4)
    boxes = [(float(x), float(y), float(x + rnd.randint(20, 30)), float(y + rnd.randint(20, 30)), "w") for x, y in ((rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(500)) if not (10 < x < 45 and 15 < y < 44)]
    written = {}
    monkeypatch.setattr(unions, "kept", lambda df, label, keep=unions.kept: written.setdefault(label, keep(df, label)))
    got = rings_of(spark, boxes)
    covered = {(x, y) for x0, y0, x1, y1, _ in boxes for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))}
    assert sum(area(p) for p in got.values()) == len(covered)
    assert written["hidden"].count() < 4 * len(boxes) * 40  # sides times boxes near them are more than four times that
