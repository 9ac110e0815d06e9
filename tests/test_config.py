"""Options from files and explicit values."""

from __future__ import annotations

import pytest

from tessella import config

GOOD = {"palette": "set", "palette_version": 1, "region_complexity_reduction_enabled": True, "max_regions": 350, "maximum_merge_cost": 0.3, "minimum_region_size_mm": 2.0, "color_distance": "delta_e_2000", "outline_simplification_enabled": False, "outline_simplification_tolerance_px": 1.0, "merge_cost_color_weight": 0.4, "merge_cost_affected_area_weight": 0.25, "merge_cost_border_weight": 0.15, "merge_cost_geometry_weight": 0.2, "merge_cost_enclosure_strength": 0.5, "merge_cost_compactness_strength": 0.15, "page": "A4", "orientation": "landscape", "placement": "fit", "margin_mm": 5, "line_width_pt": 0.1, "line_color": "#000000", "output_pdf": "x.pdf"}


def test_explicit_values_come_first(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[generation]\nmax_regions = 9\nmaximum_merge_cost = 0.5\n')
    some = {k: v for k, v in GOOD.items() if k != "maximum_merge_cost"}
    found = config.resolve(some, path)
    assert (found["max_regions"], found["maximum_merge_cost"], found["margin_mm"]) == (350, 0.5, 5.0)
    assert config.resolve(GOOD, tmp_path / "absent.toml") == config.validate(GOOD)


@pytest.mark.parametrize(("name", "value"), [("max_regions", True), ("max_regions", 0), ("margin_mm", float("nan")), ("page", "A5"), ("line_color", "red"), ("output_pdf", "x.png"), ("merge_cost_color_weight", 0.5), ("palette", None)])
def test_bad_values(name, value):
    with pytest.raises(config.ConfigurationError):
        config.resolve(GOOD | {name: value})
