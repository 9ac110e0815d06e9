"""Which outlines are no proper polygons, and which share area: a spatial join over segments.

Segments are keyed by the grid cells they pass, so only segments of one cell meet; predicates on whole
numbers decide. Points inside other outlines are found by scan lines: where the segments of an outline
cross a line, the odd stretches between crossings are inside, and a point joins the stretches of its own
line and cell. All of it is joins, windows and formulas; work grows with the length of the outlines.

``outlines``: ``(image_id, region_id, points, hole_rings)``, arrays of ``(x, y)`` in whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a grid cell.
CELL = 16

_PAIR = ["image_id", "first_id", "second_id"]


def segments(outlines: DataFrame) -> DataFrame:
    """``(image_id, region_id, ring, i, ax, ay, bx, by)``: the sides of all rings; ring 0 is the outer one. Other columns pass."""
    others = [c for c in outlines.columns if c not in ("points", "hole_rings")]
    rings = outlines.select(*others, F.posexplode(F.concat(F.array("points"), "hole_rings")).alias("ring", "p"))
    sides = "transform(p, (a, i) -> struct(i as i, a.x as ax, a.y as ay, p[(i + 1) % size(p)].x as bx, p[(i + 1) % size(p)].y as by))"
    each = rings.select(*others, "ring", F.explode(F.expr(sides)).alias("s"))
    return each.select(*others, "ring", "s.i", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("ax", "ay", "bx", "by")))


def with_cells(sides: DataFrame, cell: int = CELL) -> DataFrame:
    """``sides`` with ``cx, cy``: a row for each grid cell that the side passes, and no other cells but for rounding."""
    columns = F.expr(f"explode(sequence(least(ax, bx) div {cell} - if(pmod(least(ax, bx), {cell}) <> 0 and least(ax, bx) < 0, 1, 0), greatest(ax, bx) div {cell} - if(pmod(greatest(ax, bx), {cell}) <> 0 and greatest(ax, bx) < 0, 1, 0)))")
    dealt = sides.withColumn("cx", columns)
    at = lambda x: f"(ay + ({x} - ax) * (by - ay) / (bx - ax))"
    left, right = at(f"greatest(cx * {cell}, least(ax, bx))"), at(f"least((cx + 1) * {cell}, greatest(ax, bx))")
    low = f"if(ax = bx, least(ay, by), least({left}, {right}) - 1e-6)"
    high = f"if(ax = bx, greatest(ay, by), greatest({left}, {right}) + 1e-6)"
    return dealt.withColumn("cy", F.expr(f"explode(sequence(floor({low} / {cell}), floor({high} / {cell})))"))


def orientation(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """SQL: 1, 0 or -1 as c lies left of, on or right of the line from a to b."""
    return f"signum(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def _ends(side: str, end: str) -> tuple[str, str]:
    return f"{side}.{end}x", f"{side}.{end}y"


def crossing(s: str, t: str) -> str:
    """SQL: whether two sides cross inside both."""
    a, b, c, d = _ends(s, "a"), _ends(s, "b"), _ends(t, "a"), _ends(t, "b")
    return f"({orientation(*a, *b, *c)} * {orientation(*a, *b, *d)} < 0 and {orientation(*c, *d, *a)} * {orientation(*c, *d, *b)} < 0)"


def on_side(x: str, y: str, s: str) -> str:
    """SQL: whether a point lies on a side."""
    a, b = _ends(s, "a"), _ends(s, "b")
    return f"({orientation(*a, *b, x, y)} = 0 and {x} between least({a[0]}, {b[0]}) and greatest({a[0]}, {b[0]}) and {y} between least({a[1]}, {b[1]}) and greatest({a[1]}, {b[1]}))"


def _boxes_meet(s: str, t: str) -> str:
    return " and ".join(f"greatest({s}.a{c}, {s}.b{c}) >= least({t}.a{c}, {t}.b{c}) and greatest({t}.a{c}, {t}.b{c}) >= least({s}.a{c}, {s}.b{c})" for c in "xy")


def _same(p: tuple[str, str], q: tuple[str, str]) -> str:
    return f"({p[0]} = {q[0]} and {p[1]} = {q[1]})"


def _touching(s: str, t: str) -> str:
    """SQL: whether two sides share more than one common end point."""
    a, b, c, d = _ends(s, "a"), _ends(s, "b"), _ends(t, "a"), _ends(t, "b")
    both = f"(({_same(a, c)} and {_same(b, d)}) or ({_same(a, d)} and {_same(b, c)}))"
    lies = [f"(not {_same(p, q)} and not {_same(p, r)} and {on_side(*p, other)})" for p, other, q, r in ((a, t, c, d), (b, t, c, d), (c, s, a, b), (d, s, a, b))]
    return f"({both} or {' or '.join(lies)})"


def twice_area(ring: str) -> str:
    """SQL: twice the signed area of an array of points."""
    return f"aggregate(transform({ring}, (p, i) -> p.x * {ring}[(i + 1) % size({ring})].y - {ring}[(i + 1) % size({ring})].x * p.y), cast(0 as bigint), (a, v) -> a + v)"


def improper_outlines(outlines: DataFrame, cell: int = CELL) -> DataFrame:
    """``(image_id, region_id)`` with a ring of fewer than three distinct points, without area, or that crosses, overlaps or touches itself.

    Two sides of a ring may share one end point.
    """
    rings = outlines.select("image_id", "region_id", F.explode(F.concat(F.array("points"), "hole_rings")).alias("ring"))
    flat = rings.filter(f"size(array_distinct(ring)) < 3 or {twice_area('ring')} = 0").select("image_id", "region_id")
    placed = with_cells(segments(outlines.select("image_id", "region_id", "points", "hole_rings")), cell)
    met = placed.alias("s").join(placed.alias("t").hint("merge"), F.expr("s.image_id = t.image_id and s.region_id = t.region_id and s.ring = t.ring and s.cx = t.cx and s.cy = t.cy and s.i < t.i"))
    crossed = met.filter(f"{_boxes_meet('s', 't')} and ({crossing('s', 't')} or {_touching('s', 't')})").select("s.image_id", "s.region_id")
    return flat.unionByName(crossed).distinct()


def _pairs(met: DataFrame, one: str, other: str) -> DataFrame:
    return met.select("image_id", F.least(one, other).alias("first_id"), F.greatest(one, other).alias("second_id")).distinct()


def crossing_pairs(sides: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs of outlines with two sides that cross inside both."""
    placed = with_cells(sides, cell)
    met = placed.alias("s").join(placed.alias("t").hint("merge"), F.expr("s.image_id = t.image_id and s.cx = t.cx and s.cy = t.cy and s.region_id < t.region_id and (s.asked or t.asked)"))
    found = met.filter(f"{_boxes_meet('s', 't')} and {crossing('s', 't')}")
    return found.select(F.col("s.image_id").alias("image_id"), F.col("s.region_id").alias("first_id"), F.col("t.region_id").alias("second_id")).distinct()


def inner_stretches(sides: DataFrame, cell: int = CELL) -> DataFrame:
    """``(image_id, line, inside, x0, x1, cx)``: the stretches of scan lines inside outlines, by cell; lines and x count half units.

    A side crosses the lines from its upper end on, without its lower end.
    """
    lines = sides.filter("ay <> by").withColumn("line", F.expr("explode(sequence(2 * least(ay, by), 2 * greatest(ay, by) - 1))"))
    met = lines.select("image_id", "region_id", "asked", "line", F.expr("2 * ax + (line - 2 * ay) * (bx - ax) / (by - ay)").alias("x0"), "ring", "i")
    order = Window.partitionBy("image_id", "region_id", "line").orderBy("x0", "ring", "i")
    stretches = met.withColumn("n", F.row_number().over(order)).withColumn("x1", F.lead("x0").over(order)).filter("n % 2 = 1 and x0 < x1")
    return stretches.select("image_id", "line", F.col("region_id").alias("inside"), F.col("asked").alias("inside_asked"), "x0", "x1", F.expr(f"explode(sequence(floor(x0 / {2 * cell}), floor(x1 / {2 * cell})))").alias("cx"))


def inside_pairs(sides: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs of outlines with a corner, or the middle of a side, of one strictly inside the other."""
    spots = F.array(F.struct((F.col("ax") * 2).alias("x"), (F.col("ay") * 2).alias("y")), F.struct((F.col("ax") + F.col("bx")).alias("x"), (F.col("ay") + F.col("by")).alias("y")))
    points = sides.select("image_id", "region_id", "asked", F.explode(spots).alias("p")).select("image_id", "region_id", "asked", F.col("p.x").alias("px"), F.col("p.y").alias("line"), F.floor(F.col("p.x") / (2 * cell)).alias("cx"))
    met = points.join(inner_stretches(sides, cell).hint("merge"), ["image_id", "line", "cx"]).filter("region_id <> inside and (asked or inside_asked) and px >= x0 and px < x1")
    met = met.select("image_id", "region_id", "inside", "px", "line", "cx", F.floor(F.col("line") / (2 * cell)).alias("cy")).distinct()
    # points on a side of the other outline are not inside it; scan lines count some of them
    placed = with_cells(sides, cell).select("image_id", F.col("region_id").alias("inside"), "cx", "cy", *((F.col(c) * 2).alias(c) for c in ("ax", "ay", "bx", "by")))
    same = F.expr(" and ".join(f"m.{c} = s.{c}" for c in ("image_id", "inside", "cx", "cy")) + f" and {on_side('m.px', 'm.line', 's')}")
    return _pairs(met.alias("m").join(placed.alias("s").hint("merge"), same, "left_anti"), "region_id", "inside")


def coincident_pairs(sides: DataFrame) -> DataFrame:
    """Pairs of outlines with the same sides, in whatever order and direction."""
    one, other = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    sets = sides.groupBy("image_id", "region_id").agg(F.max("asked").alias("asked"), F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct(F.least(one, other).alias("p"), F.greatest(one, other).alias("q"))))), 256).alias("sides"))
    met = sets.alias("s").join(sets.alias("t").hint("merge"), F.expr("s.image_id = t.image_id and s.sides = t.sides and s.region_id < t.region_id and (s.asked or t.asked)"))
    return met.select(F.col("s.image_id").alias("image_id"), F.col("s.region_id").alias("first_id"), F.col("t.region_id").alias("second_id"))


def overlapping_pairs(outlines: DataFrame, asked: Column | None = None, cell: int = CELL) -> DataFrame:
    """``(image_id, first_id, second_id)``, first below second: outlines of an image that share area.

    They do if sides cross inside both, a corner or the middle of a side of one lies strictly inside the
    other, or all sides are the same. ``asked``: only pairs with such an outline.
    """
    sides = segments(outlines.select("image_id", "region_id", "points", "hole_rings", (F.lit(True) if asked is None else asked).alias("asked")))
    found = crossing_pairs(sides, cell)
    for more in (inside_pairs(sides, cell), coincident_pairs(sides)):
        found = found.unionByName(more)
    return found.distinct()


def invalid_outlines(outlines: DataFrame, asked: Column | None = None, cell: int = CELL) -> DataFrame:
    """``(image_id, region_id)`` of improper outlines, and of both of each pair that shares area. ``asked``: only those, and pairs with one of those."""
    pairs = overlapping_pairs(outlines, asked, cell)
    both = pairs.select("image_id", F.explode(F.array("first_id", "second_id")).alias("region_id"))
    own = outlines if asked is None else outlines.filter(asked)
    return improper_outlines(own, cell).unionByName(both).distinct()
