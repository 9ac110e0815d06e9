"""From pixels to a vector document: quantize, detect, merge, reduce, outline, label; and the same from configured values."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import WEIGHTS as WEIGHT_NAMES
from tessella.functions.layout import PAGES, circle_diameter, place_images
from tessella.operators import contraction, labels, merging, outlines, quantize, regions
from tessella.sources import legend, sinks
from tessella.tables import stored


@dataclass(frozen=True)
class Options:
    """How an image is turned into outlines and labels."""

    distance: str = "delta_e_2000"
    diameter: int = 3
    reduce: bool = True
    most_regions: int = 350
    most_cost: float = 0.300
    tolerance: float | None = None
    weights: tuple[float, ...] = merging.WEIGHTS["production"]
    enclosure: float = merging.ENCLOSURE
    compactness: float = merging.COMPACTNESS
    #: Whether a region that is left too small to paint is an error, after the mandatory merge and after the reduction.
    strict: bool = False

    def __post_init__(self) -> None:
        if self.diameter < 1 or self.most_regions < 1 or not 0 <= self.most_cost <= 1 or (self.tolerance is not None and self.tolerance < 0):
            raise ValueError("an option is out of its range")
        merging.check_weights(self.weights)


@dataclass(frozen=True)
class Document:
    """Relations keyed by image_id and region_id."""

    members: DataFrame
    outlines: DataFrame
    labels: DataFrame


def generate(pixels: DataFrame, palette: DataFrame, options: Options = Options()) -> Document:
    """All steps over all images; the members are stored once for outlines and labels."""
    found = regions.detect_regions(quantize.quantize(pixels, palette, options.distance))
    members = contraction.merged_regions(found, options.diameter, options.strict)
    if options.reduce:
        costs = {"weights": options.weights, "enclosure": options.enclosure, "compactness": options.compactness}
        members = contraction.reduced_regions(members, palette, options.diameter, options.most_regions, options.most_cost, options.distance, options.strict, **costs)
    members = stored(members, "members")
    return Document(members, outlines.trace_outlines(members, options.tolerance), labels.place_labels(members, palette))


#: Images of different sizes have different smallest discs; each kind is a plan of its own.
MOST_DIAMETERS = 256


def options_of(values: dict[str, Any], diameter: int) -> Options:
    """The options that validated values (:func:`tessella.config.resolve`) stand for; without reduction no reducer is bound."""
    return Options(
        distance=values["color_distance"], diameter=diameter, reduce=values["region_complexity_reduction_enabled"], most_regions=values["max_regions"], most_cost=values["maximum_merge_cost"],
        tolerance=values["outline_simplification_tolerance_px"] if values["outline_simplification_enabled"] else None, weights=tuple(values[w] for w in WEIGHT_NAMES),
        enclosure=values["merge_cost_enclosure_strength"], compactness=values["merge_cost_compactness_strength"], strict=True,
    )


def placed_images(pixels: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Each image's place on its page, and ``diameter``: pixels across its smallest region."""
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    asked = sizes.withColumns({c: F.lit(values[c]) for c in ("page", "orientation", "placement")})
    placed = place_images(asked, values["margin_mm"], values["line_width_pt"])
    return placed.withColumn("diameter", circle_diameter(values["minimum_region_size_mm"]).cast("int"))


def generate_configured(pixels: DataFrame, palette: DataFrame, values: dict[str, Any]) -> tuple[Document, DataFrame]:
    """The document by validated values, with both gates, and the images' places."""
    placed = stored(placed_images(pixels, values), "placed")
    diameters = sorted(r["diameter"] for r in placed.select("diameter").distinct().limit(MOST_DIAMETERS + 1).collect())
    if len(diameters) > MOST_DIAMETERS:
        raise ValueError(f"images of more than {MOST_DIAMETERS} smallest sizes; generate them in parts")
    parts = [generate(pixels.join(placed.filter(F.col("diameter") == d).select("image_id"), "image_id", "left_semi"), palette, options_of(values, d)) for d in diameters]
    if not parts:
        parts = [generate(pixels, palette, options_of(values, 1))]
    whole = parts[0]
    for more in parts[1:]:
        whole = replace(whole, members=whole.members.unionByName(more.members), outlines=whole.outlines.unionByName(more.outlines), labels=whole.labels.unionByName(more.labels))
    return whole, placed


def configured_pdf(pixels: DataFrame, palette: DataFrame, values: dict[str, Any], title: str, version: int) -> DataFrame:
    """``(image_id, pdf)``: each image's page, then the palette's legend."""
    document, placed = generate_configured(pixels, palette, values)
    short, long = PAGES[values["page"]]
    page = (long, short) if values["orientation"] == "landscape" else (short, long)
    pages = legend.legend_pages(palette, title, version)
    return sinks.to_pdf(document.outlines, document.labels, placed, page, values["margin_mm"], line_pt=values["line_width_pt"], line_color=values["line_color"], more=pages)
