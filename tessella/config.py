"""Options of a generation from TOML files and from explicit values, on the driver.

Explicit values come first; a file is read only if some value is missing, and only for those.
"""

from __future__ import annotations

import math
import re
import tomllib
from pathlib import Path
from typing import Any

from tessella.operators.merging import check_weights


class ConfigurationError(ValueError):
    """A value is missing, of the wrong type, or out of its range."""


#: Name -> (section, type, check).
FIELDS: dict[str, tuple[str, type, Any]] = {
    "palette": ("input", str, lambda v: bool(v.strip())),
    "palette_version": ("input", int, lambda v: v >= 1),
    "region_complexity_reduction_enabled": ("generation", bool, None),
    "max_regions": ("generation", int, lambda v: v >= 1),
    "maximum_merge_cost": ("generation", float, lambda v: 0 <= v <= 1),
    "minimum_region_size_mm": ("generation", float, lambda v: v > 0),
    "color_distance": ("generation", str, lambda v: v in ("delta_e_76", "delta_e_2000")),
    "outline_simplification_enabled": ("generation", bool, None),
    "outline_simplification_tolerance_px": ("generation", float, lambda v: v >= 0),
    "merge_cost_color_weight": ("generation", float, lambda v: v >= 0),
    "merge_cost_affected_area_weight": ("generation", float, lambda v: v >= 0),
    "merge_cost_border_weight": ("generation", float, lambda v: v >= 0),
    "merge_cost_geometry_weight": ("generation", float, lambda v: v >= 0),
    "merge_cost_enclosure_strength": ("generation", float, lambda v: 0 <= v <= 1),
    "merge_cost_compactness_strength": ("generation", float, lambda v: 0 <= v <= 1),
    "page": ("output", str, lambda v: v in ("A4", "A3")),
    "orientation": ("output", str, lambda v: v in ("portrait", "landscape")),
    "placement": ("output", str, lambda v: v in ("fit", "crop")),
    "margin_mm": ("output", float, lambda v: v >= 0),
    "line_width_pt": ("output", float, lambda v: v > 0),
    "line_color": ("output", str, lambda v: bool(re.fullmatch("#[0-9A-Fa-f]{6}", v))),
    "output_pdf": ("output", str, lambda v: v.endswith(".pdf")),
}
WEIGHTS = [f"merge_cost_{w}_weight" for w in ("color", "affected_area", "border", "geometry")]


def load_values(path: str | Path, names: list[str]) -> dict[str, Any]:
    """Only the named values of a file, those that it has."""
    with open(path, "rb") as f:
        sections = tomllib.load(f)
    return {n: sections[FIELDS[n][0]][n] for n in names if n in sections.get(FIELDS[n][0], {})}


def validate(values: dict[str, Any]) -> dict[str, Any]:
    """The values with whole numbers as floats where these are asked for, or :class:`ConfigurationError`."""
    missing = [n for n in FIELDS if n not in values]
    if missing:
        raise ConfigurationError(f"missing: {', '.join(missing)}")
    out = {}
    for name, (_, kind, check) in FIELDS.items():
        value = values[name]
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if type(value) is not kind or kind is float and not math.isfinite(value) or check and not check(value):
            raise ConfigurationError(f"{name} has no valid value: {value!r}")
        out[name] = value
    try:
        check_weights(tuple(out[w] for w in WEIGHTS))
    except ValueError as e:
        raise ConfigurationError(str(e)) from None
    return out


def resolve(explicit: dict[str, Any], path: str | Path | None = None) -> dict[str, Any]:
    """Explicit values, completed from the file where some are missing, and checked."""
    given = {n: v for n, v in explicit.items() if v is not None}
    missing = [n for n in FIELDS if n not in given]
    found = load_values(path, missing) if missing and path else {}
    return validate(given | found)
