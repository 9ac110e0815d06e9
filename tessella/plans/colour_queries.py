"""Queries on colours, quantization and what it loses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.functions.steps import apply_steps, steps_sql
from tessella.operators import collisions as C
from tessella.operators import quantize as Q
from tessella.plans.registry import query, with_sql
from tessella.sources.lenses import PALETTE_SQL, TILES_SQL, event_tiles, nation_palette
from tessella.tables import stored

OFFSETS = [2, 4, 8]

# Subqueries in SQL, each on those before it.
UNIQ = "uniq AS (SELECT DISTINCT rgb FROM px)"
LAB = "lab AS (" + steps_sql("uniq", color.lab_steps(), ["rgb", "l", "a", "b"]) + ")"
PLAB = "plab AS (" + steps_sql("palette", color.lab_steps(suffix="2"), ["idx", "number", "rgb AS palette_rgb", "l2", "a2", "b2"]) + ")"
PAIRS = {d: "pairs AS (" + steps_sql("(SELECT rgb, l AS l1, a AS a1, b AS b1, p.* FROM lab CROSS JOIN plab p)", steps, ["rgb", "idx", "number", "palette_rgb", "de"]) + ")" for d, steps in color.DISTANCES.items()}
CAND = "cand AS (SELECT *, de - min(de) OVER (PARTITION BY rgb) AS additional, row_number() OVER (PARTITION BY rgb ORDER BY round(de * 1e9), idx) AS rank FROM pairs)"
QUANT = "q AS (SELECT px.*, cand.idx, cand.de FROM px JOIN cand ON cand.rgb = px.rgb AND cand.rank = 1)"
QUANTIZED = [TILES_SQL, PALETTE_SQL, UNIQ, LAB, PLAB, PAIRS["delta_e_2000"], CAND, QUANT]
ADJACENT = """adj AS (
  SELECT a.image_id, 'horizontal' AS orientation, a.x, a.y, a.rgb, a.idx, b.rgb AS nrgb, b.idx AS nidx FROM q a JOIN q b ON a.image_id = b.image_id AND a.y = b.y AND b.x = a.x + 1
  UNION ALL
  SELECT a.image_id, 'vertical', a.x, a.y, a.rgb, a.idx, b.rgb, b.idx FROM q a JOIN q b ON a.image_id = b.image_id AND a.x = b.x AND b.y = a.y + 1)"""
BOUNDARY = """cnt AS (SELECT image_id, rgb, count(*) AS pixels FROM q GROUP BY ALL),
bnd AS (SELECT g.*, c1.pixels + c2.pixels AS source_pixels FROM (
  SELECT image_id, least(rgb, nrgb) AS first_rgb, greatest(rgb, nrgb) AS second_rgb, idx, count(*) AS length FROM adj WHERE idx = nidx AND rgb <> nrgb GROUP BY ALL) g
  JOIN cnt c1 ON c1.image_id = g.image_id AND c1.rgb = first_rgb JOIN cnt c2 ON c2.image_id = g.image_id AND c2.rgb = second_rgb)"""


def distance_sql(source: str, first: str, second: str, out: str, keep: str) -> str:
    steps = [*color.lab_steps(first, "1"), *color.lab_steps(second, "2"), *color.DELTA_E_2000]
    return steps_sql(source, steps, [keep, f"de AS {out}"])


RESCUE = "rescued AS (" + distance_sql("bnd", "first_rgb", "second_rgb", "source_de", "image_id, first_rgb, second_rgb, idx, length, source_pixels") + """),
alt AS (SELECT b.*, (SELECT arg_min(c.idx, c.rank) FROM cand c WHERE c.rgb = first_rgb AND c.idx <> b.idx AND c.rank <= 3) AS first_alternative,
  (SELECT arg_min(c.additional, c.rank) FROM cand c WHERE c.rgb = first_rgb AND c.idx <> b.idx AND c.rank <= 3) AS first_cost,
  (SELECT arg_min(c.idx, c.rank) FROM cand c WHERE c.rgb = second_rgb AND c.idx <> b.idx AND c.rank <= 3) AS second_alternative,
  (SELECT arg_min(c.additional, c.rank) FROM cand c WHERE c.rgb = second_rgb AND c.idx <> b.idx AND c.rank <= 3) AS second_cost FROM rescued b),
diag AS (SELECT *, least(first_cost, second_cost) AS rescue_cost FROM alt)"""
DIAGNOSED = [*QUANTIZED, ADJACENT, BOUNDARY, RESCUE]


def offsets_sql() -> str:
    both = " UNION ALL ".join(f"SELECT a.image_id, {k}::BIGINT AS offset_px, '{o}' AS orientation, a.x, a.y, a.rgb, b.rgb AS other_rgb, a.idx FROM q a JOIN q b ON a.image_id = b.image_id AND a.idx = b.idx AND a.rgb <> b.rgb AND b.x = a.x + {k if o == 'horizontal' else 0} AND b.y = a.y + {k if o == 'vertical' else 0}" for k in OFFSETS for o in C.LINES)
    return "off AS (SELECT * FROM (" + distance_sql(f"({both})", "rgb", "other_rgb", "de", "image_id, offset_px, orientation, x, y, rgb, other_rgb, idx") + ") WHERE de > 5)"


def surround_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT c.image_id, {k}::BIGINT AS offset_px, '{o}' AS orientation, c.x, c.y, c.rgb AS center_rgb, a.rgb AS first_rgb, b.rgb AS second_rgb, c.idx FROM q c JOIN q a ON a.image_id = c.image_id AND a.idx = c.idx AND a.x = c.x - {k if o == 'horizontal' else 0} AND a.y = c.y - {k if o == 'vertical' else 0} JOIN q b ON b.image_id = c.image_id AND b.idx = c.idx AND b.x = c.x + {k if o == 'horizontal' else 0} AND b.y = c.y + {k if o == 'vertical' else 0}"
        for k in OFFSETS for o in C.LINES
    )
    keep = "image_id, offset_px, orientation, x, y, center_rgb, first_rgb, second_rgb, idx"
    one = distance_sql(f"({parts})", "first_rgb", "second_rgb", "background_de", keep)
    two = distance_sql(f"({one})", "center_rgb", "first_rgb", "first_de", f"{keep}, background_de")
    three = distance_sql(f"({two})", "center_rgb", "second_rgb", "second_de", f"{keep}, background_de, first_de")
    return f"cs AS (SELECT * FROM ({three}) WHERE background_de <= 5 AND first_de > 5 AND second_de > 5)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quantize(event_tiles(spark, sf_dir), nation_palette(spark, sf_dir))


def diagnosed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = stored(quantized(spark, sf_dir), "quantized")  # both branches read it
    candidates = Q.ranked_candidates(event_tiles(spark, sf_dir), nation_palette(spark, sf_dir), 3)
    return q, C.rescue_diagnostics(C.collapsed_boundaries(q), candidates)


@query("color_lab", with_sql([TILES_SQL, UNIQ], "SELECT rgb, red, green, blue, round(xyz_x, 6) AS xyz_x, round(xyz_y, 6) AS xyz_y, round(xyz_z, 6) AS xyz_z, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b FROM (" + steps_sql("uniq", color.lab_steps(), ["*"]) + ")"))
def color_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["red", "green", "blue", "xyz_x", "xyz_y", "xyz_z", "l", "a", "b"]
    return rounded(apply_steps(event_tiles(spark, sf_dir).select("rgb").distinct(), color.lab_steps(), names), *names[3:])


def _distance_query(name: str) -> None:
    extra = ", round(rank_76, 6) AS rank_76, round(bound_76, 6) AS bound_76" if name == "delta_e_76" else ""
    keep = ["rgb", "idx", "de"] + (["rank_76", "bound_76"] if extra else [])
    sql = with_sql([TILES_SQL, PALETTE_SQL, UNIQ, LAB, PLAB], f"SELECT rgb, idx, round(de, 6) AS de{extra} FROM (" + steps_sql("(SELECT rgb, l AS l1, a AS a1, b AS b1, p.* FROM lab CROSS JOIN plab p)", color.DISTANCES[name], keep) + ")")

    @query(f"color_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = color.with_lab(event_tiles(spark, sf_dir).select("rgb").distinct(), suffix="1").withColumn("p", F.explode(Q.palette_array(nation_palette(spark, sf_dir))))
        pairs = pairs.select("rgb", "l1", "a1", "b1", "p.idx", "p.l2", "p.a2", "p.b2")
        return rounded(apply_steps(pairs, color.DISTANCES[name], keep[2:]).select(*keep), *keep[2:])


for _name in color.DISTANCES:
    _distance_query(_name)


@query("pack_pixels", with_sql([TILES_SQL], "SELECT image_id, pos, (y << 32) | x AS packed, ((y << 32) | x) >> 32 AS unpacked_y, ((y << 32) | x) & 4294967295 AS unpacked_x FROM px"))
def pack_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.functions.pixels import pack_pixel, unpack_pixel

    px = event_tiles(spark, sf_dir).withColumn("packed", pack_pixel(F.col("x"), F.col("y")))
    x, y = unpack_pixel(F.col("packed"))
    return px.select("image_id", "pos", "packed", y.alias("unpacked_y"), x.alias("unpacked_x"))


@query("unique_colours", with_sql([TILES_SQL], "SELECT image_id, rgb, min(pos) AS first_pos, count(*) AS pixels, row_number() OVER (PARTITION BY image_id ORDER BY min(pos)) AS seen FROM px GROUP BY image_id, rgb"))
def unique_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return Q.unique_colours(event_tiles(spark, sf_dir)).withColumn("seen", F.row_number().over(Window.partitionBy("image_id").orderBy("first_pos")).cast("long"))


def _nearest_query(name: str) -> None:
    @query(f"nearest_{name}", with_sql([TILES_SQL, PALETTE_SQL, UNIQ, LAB, PLAB, PAIRS[name]], "SELECT rgb, arg_min(idx, row(round(de * 1e9), idx)) AS idx, round(min(de), 6) AS de FROM pairs GROUP BY rgb"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(Q.nearest_colours(event_tiles(spark, sf_dir), nation_palette(spark, sf_dir), name), "de")


for _name in color.DISTANCES:
    _nearest_query(_name)


@query("quantize_image", with_sql(QUANTIZED, "SELECT image_id, pos, x, y, rgb, idx FROM q"))
def quantize_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(spark, sf_dir).select("image_id", "pos", "x", "y", "rgb", "idx")


@query("palette_candidates", with_sql(QUANTIZED, "SELECT c.rgb, c.rank, c.idx, c.number, round(c.de, 6) AS de, round(c.additional, 6) AS additional, n.pixels FROM cand c JOIN (SELECT rgb, count(*) AS pixels FROM px GROUP BY rgb) n ON n.rgb = c.rgb WHERE c.rank <= 3"))
def palette_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = event_tiles(spark, sf_dir)
    return rounded(Q.ranked_candidates(px, nation_palette(spark, sf_dir), 3).join(px.groupBy("rgb").agg(F.count("*").alias("pixels")), "rgb"), "de", "additional")


@query("source_pixel_counts", with_sql([TILES_SQL], "SELECT image_id, rgb, count(*) AS pixels FROM px GROUP BY ALL"))
def source_pixel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_tiles(spark, sf_dir).groupBy("image_id", "rgb").agg(F.count("*").alias("pixels"))


@query("distinct_colour_count", with_sql([TILES_SQL], "SELECT image_id, count(DISTINCT rgb) AS colours FROM px GROUP BY image_id"))
def distinct_colour_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_tiles(spark, sf_dir).groupBy("image_id").agg(F.count_distinct("rgb").alias("colours"))


@query("palette_usage", with_sql(QUANTIZED, "SELECT image_id, idx, count(DISTINCT rgb) AS sources, count(*) AS pixels, round(count(*) / sum(count(*)) OVER (PARTITION BY image_id), 6) AS fraction FROM q GROUP BY image_id, idx"))
def palette_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.palette_usage(quantized(spark, sf_dir)), "fraction")


@query("palette_utilization", with_sql(QUANTIZED, "SELECT image_id, count(DISTINCT idx) AS used_colours, count(DISTINCT rgb) AS sources, count(*) AS pixels, (SELECT count(*) FROM palette) AS palette_colours, round(count(DISTINCT idx) / (SELECT count(*) FROM palette), 6) AS utilization FROM q GROUP BY image_id"))
def palette_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.palette_utilization(quantized(spark, sf_dir), nation_palette(spark, sf_dir).count()), "utilization")


@query("palette_source_spread", with_sql(QUANTIZED, "SELECT image_id, idx, count(*) AS sources, sum(pixels)::BIGINT AS pixels, round(min(de), 6) AS min_de, round(max(de), 6) AS max_de, round(avg(de), 6) AS mean_de FROM (SELECT image_id, idx, rgb, any_value(de) AS de, count(*) AS pixels FROM q GROUP BY ALL EXCLUDE de) GROUP BY image_id, idx".replace("GROUP BY ALL EXCLUDE de", "GROUP BY image_id, idx, rgb")))
def palette_source_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.source_spread(quantized(spark, sf_dir)), "min_de", "max_de", "mean_de")


@query("collapsed_boundaries", with_sql([*QUANTIZED, ADJACENT, BOUNDARY], "SELECT * FROM bnd"))
def collapsed_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapsed_boundaries(quantized(spark, sf_dir))


_DIAG = "image_id, first_rgb, second_rgb, idx, length, source_pixels, round(source_de, 6) AS source_de, first_alternative, round(first_cost, 6) AS first_cost, second_alternative, round(second_cost, 6) AS second_cost, round(rescue_cost, 6) AS rescue_cost"
_DIAG_COLUMNS = ["source_de", "first_cost", "second_cost", "rescue_cost"]


@query("rescue_diagnostics", with_sql(DIAGNOSED, f"SELECT {_DIAG} FROM diag"))
def rescue_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnosed(spark, sf_dir)[1], *_DIAG_COLUMNS)


def _ranking(by: str) -> None:
    first = "round(rescue_cost, 6) NULLS LAST, length DESC" if by == "cost" else "length DESC, round(rescue_cost, 6) NULLS LAST"

    @query(f"rescue_ranking_by_{by}", with_sql(DIAGNOSED, f"SELECT {_DIAG}, row_number() OVER (PARTITION BY image_id ORDER BY {first}, round(source_de, 6) DESC, source_pixels DESC, idx, first_rgb, second_rgb) AS rank FROM diag WHERE source_de > 1.5"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(C.ranked_rescues(diagnosed(spark, sf_dir)[1], 1.5, by), *_DIAG_COLUMNS)


for _by in ("cost", "impact"):
    _ranking(_by)


def _summary_sql() -> str:
    far = "source_de > 1.5"
    classes = {"all": "true", "low": "source_de <= 1.5", "meaningful": far, "cost_le_1": f"{far} AND rescue_cost <= 1", "cost_le_2": f"{far} AND rescue_cost <= 2", "cost_le_5": f"{far} AND rescue_cost <= 5", "expensive": f"{far} AND rescue_cost > 5", "unavailable": f"{far} AND rescue_cost IS NULL"}
    parts = [f"count(*) FILTER (WHERE {c}) AS {n}_count, coalesce(sum(length) FILTER (WHERE {c}), 0)::BIGINT AS {n}_length" for n, c in classes.items()]
    return f"SELECT image_id, {', '.join(parts)} FROM diag GROUP BY image_id"


@query("rescue_summary", with_sql(DIAGNOSED, _summary_sql()))
def rescue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rescue_summary(diagnosed(spark, sf_dir)[1], 1.5)


def _offsets(q: DataFrame) -> DataFrame:
    return C.offset_pairs(q, OFFSETS)


def _surround(q: DataFrame) -> DataFrame:
    return C.center_surround(stored(q, "quantized"), OFFSETS)  # both directions read it


@query("offset_collapsed_pairs", with_sql([*QUANTIZED, offsets_sql()], "SELECT * REPLACE (round(de, 6) AS de) FROM off"))
def offset_collapsed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stored(quantized(spark, sf_dir), "quantized")  # both directions read it
    return rounded(_offsets(q), "de")


@query("offset_collapsed_summary", with_sql([*QUANTIZED, offsets_sql()], "SELECT g.image_id, g.offset_px, count(o.x) AS pairs, round(min(de), 6) AS min_de, round(max(de), 6) AS max_de, round(avg(de), 6) AS mean_de FROM (SELECT image_id, unnest([2, 4, 8])::BIGINT AS offset_px FROM (SELECT DISTINCT image_id FROM px)) g LEFT JOIN off o ON o.image_id = g.image_id AND o.offset_px = g.offset_px GROUP BY ALL"))
def offset_collapsed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stored(quantized(spark, sf_dir), "quantized")  # both directions and the list of images read it
    return rounded(C.offset_summary(_offsets(q), OFFSETS, q), "min_de", "max_de", "mean_de")


@query("center_surround_candidates", with_sql([*QUANTIZED, surround_sql()], "SELECT * REPLACE (round(background_de, 6) AS background_de, round(first_de, 6) AS first_de, round(second_de, 6) AS second_de) FROM cs"))
def center_surround_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_surround(quantized(spark, sf_dir)), "background_de", "first_de", "second_de")


@query("center_surround_summary", with_sql([*QUANTIZED, surround_sql()], "SELECT image_id, offset_px, count(*) AS candidates, count(DISTINCT row(x, y)) AS centers, count(*) FILTER (WHERE orientation = 'horizontal') AS horizontal, count(*) FILTER (WHERE orientation = 'vertical') AS vertical FROM cs GROUP BY image_id, offset_px"))
def center_surround_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.center_surround_summary(_surround(quantized(spark, sf_dir)))


_PERSIST = "pers AS (SELECT image_id, x, y, string_agg(DISTINCT offset_px::VARCHAR, ',' ORDER BY offset_px::VARCHAR) AS offsets, count(DISTINCT offset_px) AS support, count(*) AS candidates, count(*) FILTER (WHERE orientation = 'horizontal') AS horizontal, count(*) FILTER (WHERE orientation = 'vertical') AS vertical FROM cs GROUP BY image_id, x, y HAVING count(DISTINCT offset_px) >= 1)"


@query("center_surround_persistence", with_sql([*QUANTIZED, surround_sql(), _PERSIST], "SELECT * EXCLUDE (support) FROM pers"))
def center_surround_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.center_surround_persistence(_surround(quantized(spark, sf_dir)), 1)
    return found.withColumn("offsets", F.array_join(F.col("offsets").cast("array<string>"), ","))


@query("center_surround_histogram", with_sql([*QUANTIZED, surround_sql(), _PERSIST], "SELECT image_id, support, count(*) AS centers FROM pers GROUP BY image_id, support"))
def center_surround_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.persistence_histogram(C.center_surround_persistence(_surround(quantized(spark, sf_dir)), 1))
