"""Counts and sums around points against brute force."""

import random

import pytest

from tessera.operators import ranges


@pytest.mark.parametrize("box", [False, True])
def test_sums_against_every_pair(spark, monkeypatch, box):
    monkeypatch.setattr(ranges, "PLACES", 60)
    monkeypatch.setattr(ranges, "POINTS", 20)
    rnd = random.Random(2)
    rows = [(float(rnd.randint(-60, 60)), float(rnd.randint(0, 90)), i % 7, None if i % 11 == 0 else i * 0.5) for i in range(900)] + [(rnd.uniform(0, 5), rnd.uniform(0, 5), 1, 1.0) for _ in range(200)] + [(None, 1.0, 1, 1.0)]
    points = [(i, float(rnd.randint(-70, 70)), float(rnd.randint(-20, 99))) for i in range(120)] + [(500, None, 1.0), (501, 1e7, 0.0)]
    got = ranges.sums_around(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(rows, "x double, y double, a long, b double"), [5.0, 13.0, 25.0], ("a", "b"), box)
    got = {r.id: r for r in got.collect()}
    for i, x, y in points:
        for k, radius in enumerate((5.0, 13.0, 25.0)):
            met = [r for r in rows if None not in (x, r[0]) and (max(abs(x - r[0]), abs(y - r[1])) if box else ((x - r[0]) ** 2 + (y - r[1]) ** 2) ** 0.5) <= radius]
            want = (len(met), sum(r[2] for r in met), sum(r[3] or 0 for r in met))
            assert (want == (0, 0, 0) and i not in got) or (got[i][f"n_{k}"], got[i][f"a_{k}"], pytest.approx(got[i][f"b_{k}"])) == want
