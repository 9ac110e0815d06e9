"""Pages: sizes, placement of an image, legend grid, processing size, as column formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page sizes in millimetres, portrait.
PAGES = {"A4": (210.0, 297.0), "A3": (297.0, 420.0)}
MM_PER_POINT = 25.4 / 72


def output_size(page: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height in millimetres; landscape turns the page."""
    short, long = (F.when(page == "A4", F.lit(PAGES["A4"][i])).when(page == "A3", F.lit(PAGES["A3"][i])) for i in (0, 1))
    turned = orientation == "landscape"
    return F.when(turned, long).otherwise(short), F.when(turned, short).otherwise(long)


def effective_margin(margin_mm: float, line_width_pt: float) -> float:
    """The margin and half a line."""
    return margin_mm + line_width_pt * MM_PER_POINT / 2


def place_images(images: DataFrame, margin_mm: float, line_width_pt: float = 0.0) -> DataFrame:
    """``images(width, height, page, orientation, placement)`` with scale (mm a pixel), size, crop window and offset.

    ``fit`` shows the whole image, centred; ``crop`` fills the page and centres the window by whole pixels.
    """
    margin = effective_margin(margin_mm, line_width_pt)
    page_w, page_h = output_size(F.col("page"), F.col("orientation"))
    room = images.withColumns({"room_w": page_w - 2 * margin, "room_h": page_h - 2 * margin})
    fit = F.col("placement") == "fit"
    sx, sy = F.col("room_w") / F.col("width"), F.col("room_h") / F.col("height")
    room = room.withColumn("scale", F.when(fit, F.least(sx, sy)).otherwise(F.greatest(sx, sy)))
    crop = lambda side, room_side: F.when(fit, F.col(side)).otherwise(F.floor(F.col(room_side) / F.col("scale")))
    room = room.withColumns({"image_w_mm": F.col("width") * F.col("scale"), "image_h_mm": F.col("height") * F.col("scale"), "crop_w": crop("width", "room_w"), "crop_h": crop("height", "room_h")})
    return room.withColumns({
        "crop_left": F.floor((F.col("width") - F.col("crop_w")) / 2), "crop_top": F.floor((F.col("height") - F.col("crop_h")) / 2),
        "offset_x_mm": F.when(fit, margin + (F.col("room_w") - F.col("image_w_mm")) / 2).otherwise(F.lit(margin)),
        "offset_y_mm": F.when(fit, margin + (F.col("room_h") - F.col("image_h_mm")) / 2).otherwise(F.lit(margin)),
    }).drop("room_w", "room_h")


def to_page(x: Column, y: Column) -> tuple[Column, Column]:
    """Millimetres on the page of an image position, from the columns of :func:`place_images`."""
    return F.col("offset_x_mm") + (x - F.col("crop_left")) * F.col("scale"), F.col("offset_y_mm") + (y - F.col("crop_top")) * F.col("scale")


def in_crop(x: Column, y: Column) -> Column:
    return x.between(F.col("crop_left"), F.col("crop_left") + F.col("crop_w")) & y.between(F.col("crop_top"), F.col("crop_top") + F.col("crop_h"))


def circle_diameter(minimum_mm: float) -> Column:
    """Pixels across the smallest region that can be painted."""
    return F.ceil(F.lit(minimum_mm) / F.col("scale"))


def processing_size(images: DataFrame, most_pixels: int) -> DataFrame:
    """``images(width, height)`` with the size they are worked on: shrunk alike to ``most_pixels`` at most, one pixel at least."""
    total = F.col("width") * F.col("height")
    factor = F.sqrt(F.lit(float(most_pixels)) / total)
    small = images.withColumns({"w": F.greatest(F.floor(F.col("width") * factor), F.lit(1)), "h": F.greatest(F.floor(F.col("height") * factor), F.lit(1))})
    over = F.col("w") * F.col("h") > most_pixels
    wide = F.col("w") >= F.col("h")
    bounded = small.withColumns({"w2": F.when(over & wide, F.greatest(F.floor(F.lit(most_pixels) / F.col("h")), F.lit(1))).otherwise(F.col("w")), "h2": F.when(over & ~wide, F.greatest(F.floor(F.lit(most_pixels) / F.col("w")), F.lit(1))).otherwise(F.col("h"))})
    keep = total <= most_pixels
    return bounded.withColumns({"process_width": F.when(keep, F.col("width")).otherwise(F.col("w2")), "process_height": F.when(keep, F.col("height")).otherwise(F.col("h2"))}).drop("w", "h", "w2", "h2")


def legend_layout(palette: DataFrame, columns: int = 4, rows: int = 17, start_x_pt: float = 56.7, top_y_pt: float = 751.2, column_width_pt: float = 118.0, row_height_pt: float = 42.5) -> DataFrame:
    """Where each palette entry stands: page, column, row (filled down first), position in points, and whether its text is light."""
    at = F.col("idx") % (columns * rows)
    red, green, blue = (F.shiftright("rgb", s).bitwiseAND(255) for s in (16, 8, 0))
    out = palette.withColumns({"page": F.floor(F.col("idx") / (columns * rows)), "column": F.floor(at / rows), "row": at % rows})
    return out.withColumns({"x_pt": start_x_pt + F.col("column") * column_width_pt, "y_pt": top_y_pt - F.col("row") * row_height_pt, "dark": red * 0.2126 + green * 0.7152 + blue * 0.0722 < 150.0})


def layout_violations(layout: DataFrame, width_pt: float, height_pt: float, margin_pt: float, entry_width_pt: float, entry_height_pt: float) -> DataFrame:
    """Entries that leave the margins."""
    inside = (F.col("x_pt") >= margin_pt) & (F.col("x_pt") + entry_width_pt <= width_pt - margin_pt) & (F.col("y_pt") >= margin_pt) & (F.col("y_pt") + entry_height_pt <= height_pt - margin_pt)
    return layout.filter(~inside)
