"""Checks that must raise, and rows without values where they used to break."""

import pytest

from tessera.operators.flags import clustered
from tessera.plans.rules import scene_gate


def test_too_few_scenes_raise(spark):
    takes = spark.createDataFrame([(i, 60.0, 0.9) for i in range(12)] + [(99, 20.0, 0.9), (98, None, 1.0)], "id long, elevation double, usable double")
    assert scene_gate(takes).count() == 12
    with pytest.raises(Exception, match="too few scenes"):
        scene_gate(takes.where("id > 0")).collect()
    with pytest.raises(Exception, match="too few scenes"):
        scene_gate(takes.limit(0)).select("id").collect()


def test_flags_without_position_are_left_out(spark):
    rows = [(1, 1, 1, 0.0, 0.0), (1, 2, 2, None, 0.0), (1, 3, 3, float("nan"), 0.0), (1, 4, None, 10.0, 0.0), (1, 5, 4, 500.0, 0.0), (2, 6, 1, None, None)]
    got = clustered(spark.createDataFrame(rows, "lake long, id long, t long, x double, y double")).collect()
    assert sorted((r.id, r.cluster) for r in got) == [(1, 1), (4, 1), (5, 2)]
