"""The hazard scan's rules, one by one."""

import math

import pytest

from tessera.operators.alerts import corridor_scan, most_urgent

FIX = "seq long, x double, y double, speed double, heading double"
HAZARD = "id long, x double, y double, cls string, tier string"


def scan(spark, fix, hazards):
    f = spark.createDataFrame([(1, 0.0, 0.0, *fix)], FIX)
    h = spark.createDataFrame([(i, *x) for i, x in enumerate(hazards)], HAZARD)
    return corridor_scan(f, h)


@pytest.mark.parametrize(
    ("fix", "at", "hit"),
    [
        ((10.0, 0.0), (200.0, 0.0), True),
        ((10.0, 0.0), (-200.0, 0.0), False),
        ((10.0, 0.0), (-30.0, 0.0), True),  # behind, within the half width
        ((10.0, 0.0), (100.0, 30.0), True),
        ((10.0, 0.0), (100.0, 60.0), False),
        ((3.0, 0.0), (500.0, 0.0), False),
        ((30.0, 0.0), (500.0, 0.0), True),
        ((30.0, math.pi / 2), (0.0, -500.0), False),
        ((0.5, 0.0), (0.0, 55.0), True),  # drifting: a radius
        ((10.0, None), (0.0, 55.0), True),
        ((10.0, None), (0.0, 65.0), False),
    ],
)
def test_corridor(spark, fix, at, hit):
    assert (scan(spark, fix, [(*at, "rock", "likely")]).count() == 1) is hit


def test_order(spark):
    hits = scan(spark, (10.0, 0.0), [(190.0, 0.0, "shoal", "confirmed"), (100.0, 0.0, "exposed", "unverified"), (100.0, 0.0, "shoal", None)])
    assert most_urgent(hits).first().hazard_id == 2
    assert {r.hazard_id: r.severity for r in hits.collect()} == pytest.approx({0: 4.0, 1: 0.4, 2: 1.6})


@pytest.mark.parametrize(("at", "level"), [(30.0, "danger"), (59.0, "danger"), (110.0, "caution"), (149.0, "caution"), (190.0, "clear")])
def test_levels(spark, at, level):
    assert most_urgent(scan(spark, (10.0, 0.0), [(at, 0.0, "rock", "likely")])).first().level == level


def test_empty(spark):
    assert scan(spark, (10.0, 0.0), []).count() == 0
