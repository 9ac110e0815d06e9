"""Legend pages as rows: swatches, numbers and names of a palette, wrapped by glyph widths, and their PDF operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.layout import PAGES, legend_layout
from tessella.sources.sinks import POINTS_PER_MM

# Widths of Helvetica's glyphs from space to tilde, in thousandths of the font size.
GLYPHS = dict(zip(map(chr, range(32, 127)), [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]))
#: Of letters beyond these, the width of an n.
OTHER_WIDTH = 556


class LegendError(ValueError):
    """The legend does not fit its page."""


@dataclass(frozen=True)
class LegendStyle:
    """Measures of the legend, in points where not said otherwise."""

    page: str = "A4"
    columns: int = 4
    rows: int = 17
    start_x: float = 20.0 * POINTS_PER_MM
    header_y: float = 284.0 * POINTS_PER_MM
    top_y: float = 265.0 * POINTS_PER_MM
    column_width: float = 118.0
    row_height: float = 42.5
    field: float = 22.5
    name_offset: float = 30.0
    font: float = 9.0
    line_height: float = 9.0
    margin_mm: float = 5.0


def text_width(text: Column, font: float) -> Column:
    """Width of a text in Helvetica."""
    widths = F.create_map(*(F.lit(v) for kv in GLYPHS.items() for v in kv))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.coalesce(F.try_element_at(widths, c), F.lit(OTHER_WIDTH))) * (font / 1000)


def legend_names(palette: DataFrame, style: LegendStyle = LegendStyle()) -> DataFrame:
    """``(idx, line, text, width, fits)``: names in one or two lines; ``fits`` is false where two do not hold a name.

    The first line takes words while they fit, one at least.
    """
    room = style.column_width - style.name_offset
    words = palette.select("idx", F.posexplode(F.filter(F.split(F.trim("name"), r"\s+"), lambda w: w != "")).alias("at", "word"))
    order = Window.partitionBy("idx").orderBy("at")
    upto = F.sum(text_width(F.col("word"), style.font)).over(order) + F.col("at") * (GLYPHS[" "] * style.font / 1000)
    lined = words.withColumn("line", F.when((upto <= room) | (F.col("at") == 0), 0).otherwise(1))
    lines = lined.groupBy("idx", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("text"))
    return lines.withColumn("width", text_width(F.col("text"), style.font)).withColumn("fits", F.col("width") <= room)


def legend_texts(palette: DataFrame, style: LegendStyle = LegendStyle()) -> DataFrame:
    """``(idx, page, part, text, x_pt, y_pt, light)``: numbers centred in their fields (part 0), then the lines of the names (1, 2)."""
    placed = legend_layout(palette, style.columns, style.rows, style.start_x, style.top_y, style.column_width, style.row_height)
    number = F.col("number").cast("string")
    fields = placed.select(
        "idx", "page", F.lit(0).alias("part"), number.alias("text"),
        (F.col("x_pt") + (style.field - text_width(number, style.font)) / 2).alias("x_pt"), (F.col("y_pt") + (style.field - style.font) / 2 + 1).alias("y_pt"), F.col("dark").alias("light"),
    )
    names = legend_names(palette, style)
    many = names.groupBy("idx").agg(F.count("*").alias("many"))
    height = style.font + (F.col("many") - 1) * style.line_height
    first = F.col("y_pt") + (style.field - height) / 2 + height - style.font
    lines = placed.select("idx", "page", "x_pt", "y_pt").join(names, "idx").join(many, "idx")
    return fields.unionByName(lines.select("idx", "page", (F.col("line") + 1).alias("part"), "text", (F.col("x_pt") + style.name_offset).alias("x_pt"), (first - F.col("line") * style.line_height).alias("y_pt"), F.lit(False).alias("light")))


def _shown(text: Column) -> Column:
    return F.concat(F.lit("("), F.regexp_replace(text, r"([\\()])", r"\\$1"), F.lit(") Tj"))


def legend_operators(palette: DataFrame, title: str, version: int, style: LegendStyle = LegendStyle()) -> DataFrame:
    """``(page, idx, part, operator)``: what a page draws, in order of idx (the header: -1) and part."""
    placed = legend_layout(palette, style.columns, style.rows, style.start_x, style.top_y, style.column_width, style.row_height)
    share = lambda s: F.shiftright("rgb", s).bitwiseAND(255) / 255.0
    fields = placed.select("page", "idx", F.lit(-1).alias("part"), F.format_string("%.4f %.4f %.4f rg %.3f %.3f %.3f %.3f re f", share(16), share(8), share(0), "x_pt", "y_pt", F.lit(style.field), F.lit(style.field)).alias("operator"))
    texts = legend_texts(palette, style)
    drawn = texts.select("page", "idx", "part", F.concat(F.when(F.col("light"), "1 1 1 rg").otherwise("0 0 0 rg"), F.format_string(" BT /F1 %.1f Tf %.3f %.3f Td ", F.lit(style.font), "x_pt", "y_pt"), _shown(F.col("text")), F.lit(" ET")).alias("operator"))
    wide = PAGES[style.page][0] * POINTS_PER_MM
    edition = f"Version {version}"
    own = lambda text: sum(GLYPHS.get(c, OTHER_WIDTH) for c in text) * style.font / 1000
    heads = [(0, title, style.start_x), (1, edition, wide - style.start_x - own(edition))]
    header = placed.filter("idx = 0").select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(t).alias("text"), F.lit(x).alias("x")) for p, t, x in heads))).alias("h"))
    top = header.select(F.lit(0).cast("long").alias("page"), F.lit(-1).cast("long").alias("idx"), "h.part", F.concat(F.format_string("0 0 0 rg BT /F1 %.1f Tf %.3f %.3f Td ", F.lit(style.font), "h.x", F.lit(style.header_y)), _shown(F.col("h.text")), F.lit(" ET")).alias("operator"))
    return fields.unionByName(drawn).unionByName(top)


def legend_pages(palette: DataFrame, title: str, version: int, style: LegendStyle = LegendStyle()) -> list[bytes]:
    """The operators of each page; a palette has 256 colours at most. :class:`LegendError` if a name or field leaves its place."""
    wide, high, margin = (PAGES[style.page][0] * POINTS_PER_MM, PAGES[style.page][1] * POINTS_PER_MM, style.margin_mm * POINTS_PER_MM)
    placed = legend_layout(palette, style.columns, style.rows, style.start_x, style.top_y, style.column_width, style.row_height)
    outside = placed.filter((F.col("x_pt") < margin) | (F.col("x_pt") + style.column_width > wide - margin) | (F.col("y_pt") < margin) | (F.col("y_pt") + style.field > high - margin))
    if outside.head(1) or legend_names(palette, style).filter("not fits").head(1):
        raise LegendError("the legend leaves its page or a name its column")
    pages: dict[int, list[str]] = {}
    for r in legend_operators(palette, title, version, style).orderBy("page", "idx", "part").collect():
        pages.setdefault(r["page"], []).append(r["operator"])
    return ["\n".join(ops).encode("latin-1", "replace") for _, ops in sorted(pages.items())]
