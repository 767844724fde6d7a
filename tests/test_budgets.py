"""Registered queries run over the budgets of their operators' defaults."""

import pytest

from roomfold.config import FrameConfig, GeometryConfig, StitchConfig
from roomfold.operators import folds, matching, planes
from roomfold.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, module, function, budgets", [
    ("room_geometry", planes, "room_geometry", {"max_planes": GeometryConfig().max_planes, "ransac_iterations": GeometryConfig().ransac_iterations}),
    ("robust_planar_fit", matching, "robust_se2", {"ransac_iterations": StitchConfig().ransac_iterations}),
    ("drift_correction", folds, "motion_keyframes", {"max_frames": FrameConfig().max_frames}),
])
def test_default_budgets(spark, monkeypatch, name, module, function, budgets):
    def stop(rows, keys, cfg):
        assert {k: getattr(cfg, k) for k in budgets} == budgets
        raise Seen

    monkeypatch.setattr(module, function, stop)
    with pytest.raises(Seen):
        QUERIES[name](spark, SMALL)
