"""Results out of the engine: vector pages as PDF, JSON records."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS_PER_MM = 72 / 25.4
#: Width of a Helvetica digit, in thousandths of the font size.
DIGIT_WIDTH = 556


def page_operators(outlines: list[tuple[list, list]], labels: list[tuple[str, float, float]], place: dict[str, float], page: tuple[float, float], margin: float, font_pt: float, line_pt: float, line_color: str = "#000000") -> bytes:
    """PDF operators of one page: clip to the margin, stroke outlines with their holes, centre labels that fit."""
    k, height = POINTS_PER_MM, page[1]
    at = lambda x, y: (f"{(place['offset_x_mm'] + (x - place['crop_left']) * place['scale']) * k:.3f}", f"{(height - place['offset_y_mm'] - (y - place['crop_top']) * place['scale']) * k:.3f}")
    out = ["q", f"{margin * k:.3f} {margin * k:.3f} {(page[0] - 2 * margin) * k:.3f} {(height - 2 * margin) * k:.3f} re W n", f"{line_pt} w {' '.join(f'{int(line_color[i : i + 2], 16) / 255:.4g}' for i in (1, 3, 5))} RG 0 0 0 rg"]
    for points, holes in outlines:
        for ring in (points, *holes):
            first, *rest = [at(p["x"], p["y"]) for p in ring]
            out.append(" ".join([*first, "m", *(f"{x} {y} l" for x, y in rest), "h S"]))
    for text, x, y in labels:
        px, py = (float(v) for v in at(x + 0.5, y + 0.5))
        half = len(text) * DIGIT_WIDTH * font_pt / 2000
        in_crop = place["crop_left"] <= x <= place["crop_left"] + place["crop_w"] and place["crop_top"] <= y <= place["crop_top"] + place["crop_h"]
        if in_crop and margin * k <= px - half and px + half <= (page[0] - margin) * k and margin * k <= py - font_pt / 2 and py + font_pt / 2 <= (height - margin) * k:
            out.append(f"BT /F1 {font_pt} Tf {px - half:.3f} {py - font_pt * 0.35:.3f} Td ({text}) Tj ET")
    return "\n".join([*out, "Q"]).encode("latin-1")


def pdf_document(pages: list[bytes], page: tuple[float, float]) -> bytes:
    """A PDF of these pages with one built-in font."""
    box = f"[0 0 {page[0] * POINTS_PER_MM:.3f} {page[1] * POINTS_PER_MM:.3f}]"
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, content in enumerate(pages):
        bodies.append(f"<< /Type /Page /Parent 2 0 R /MediaBox {box} /Contents {5 + 2 * i} 0 R /Resources << /Font << /F1 3 0 R >> >> >>".encode())
        bodies.append(f"<< /Length {len(content)} >>\nstream\n".encode() + content + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(bodies):
        places.append(len(out))
        out += f"{i + 1} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def to_pdf(outlines: DataFrame, labels: DataFrame, placed: DataFrame, page: tuple[float, float] = (297.0, 210.0), margin_mm: float = 5.0, font_pt: float = 3.0, line_pt: float = 0.1, line_color: str = "#000000", more: Sequence[bytes] = ()) -> DataFrame:
    """``(image_id, pdf)``: one document an image, made where the image's rows are gathered. ``more``: operators of pages that follow, a few."""
    shapes = outlines.select("image_id", "region_id", "points", "hole_rings", F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    texts = labels.select("image_id", "region_id", F.lit(None).cast(outlines.schema["points"].dataType).alias("points"), F.lit(None).cast(outlines.schema["hole_rings"].dataType).alias("hole_rings"), "text", "x", "y")
    placement = ["scale", "crop_left", "crop_top", "crop_w", "crop_h", "offset_x_mm", "offset_y_mm"]
    rows = shapes.unionAll(texts).join(placed.select("image_id", *placement).hint("merge"), "image_id")

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("region_id")
        drawn, named = part[part["text"].isna()], part[part["text"].notna()]
        content = page_operators(list(zip(drawn["points"], drawn["hole_rings"])), list(zip(named["text"], named["x"], named["y"])), {c: float(part[c].iloc[0]) for c in placement}, page, margin_mm, font_pt, line_pt, line_color)
        return pd.DataFrame([(int(part["image_id"].iloc[0]), pdf_document([content, *more], page))], columns=["image_id", "pdf"])

    return rows.groupBy("image_id").applyInPandas(draw, "image_id long, pdf binary")


def json_record(*columns: str) -> Column:
    """One JSON object with its keys in order."""
    return F.to_json(F.struct(*sorted(columns)))
