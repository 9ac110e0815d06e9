"""Queries on sources, pages, sinks and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import layout as P
from tessella.operators import benchmarks as B
from tessella.plans.colour_queries import rounded
from tessella.plans.pipeline import Options, generate
from tessella.plans.registry import query
from tessella.sources import images as I
from tessella.sources import legend, palettes, resampling, sinks, synthetic
from tessella.sources.lenses import PALETTE_SQL, TILES_SQL, event_tiles, nation_palette

KINDS = ["flat", "checkerboard", "comb", "gradient"]
_XY = "SELECT pos, pos % 40 AS x, pos // 40 AS y FROM range(1200) t(pos)"


@query("synthetic_rasters", " UNION ALL ".join(f"SELECT '{k}' AS kind, pos, x, y, {e} AS rgb FROM ({_XY})" for k, e in {"flat": "8405024::BIGINT", "checkerboard": "CASE WHEN (x + y) % 2 = 1 THEN 16777215::BIGINT ELSE 0 END", "comb": "CASE WHEN x % 2 = 0 AND y < 28 + (x // 2) % 2 THEN 0::BIGINT ELSE 16777215 END", "gradient": "(x * 7 % 256) * 65536 + (y * 11 % 256) * 256 + (x + y) * 13 % 256"}.items()))
def synthetic_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in KINDS:
        part = synthetic.raster(spark, kind, 40, 30).select(F.lit(kind).alias("kind"), "pos", "x", "y", "rgb")
        out = part if out is None else out.unionAll(part)
    return out


@query("benchmark_workload", "SELECT n AS pos, n * 40503 % 16777216 AS rgb FROM range(5000) t(n)")
def benchmark_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.benchmark_colours(spark, 5000).select("pos", "rgb")


# Image sizes seen in orders.
_SIZES = "sz AS (SELECT o_orderkey AS image_id, o_orderkey * 37 % 9000 AS width, o_custkey * 53 % 8000 AS height, CASE WHEN o_orderkey % 2 = 0 THEN 'A4' ELSE 'A3' END AS page, CASE WHEN o_orderkey % 3 = 0 THEN 'landscape' ELSE 'portrait' END AS orientation, CASE WHEN o_orderkey % 5 < 3 THEN 'fit' ELSE 'crop' END AS placement FROM orders)"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("image_id"), (key * 37 % 9000).alias("width"), (cust * 53 % 8000).alias("height"), F.when(key % 2 == 0, "A4").otherwise("A3").alias("page"), F.when(key % 3 == 0, "landscape").otherwise("portrait").alias("orientation"), F.when(key % 5 < 3, "fit").otherwise("crop").alias("placement"))


@query("image_acceptance", f"WITH {_SIZES} SELECT image_id, width, height, CASE WHEN width < 1 OR height < 1 THEN 'empty' WHEN width > 8000 THEN 'width' WHEN height > 7000 THEN 'height' WHEN width * height > 20000000 THEN 'pixels' END AS refusal FROM sz")
def image_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.acceptance(sizes(spark, sf_dir).select("image_id", "width", "height"), 20_000_000, 8000, 7000)


@query("processing_size", f"WITH {_SIZES}, s AS (SELECT image_id, width, height, greatest(floor(width * sqrt(1600000e0 / (width * height))), 1)::BIGINT AS w, greatest(floor(height * sqrt(1600000e0 / (width * height))), 1)::BIGINT AS h FROM sz WHERE width > 0 AND height > 0) SELECT image_id, width, height, CASE WHEN width * height <= 1600000 THEN width WHEN w * h > 1600000 AND w >= h THEN greatest(1600000 // h, 1) ELSE w END AS process_width, CASE WHEN width * height <= 1600000 THEN height WHEN w * h > 1600000 AND w < h THEN greatest(1600000 // w, 1) ELSE h END AS process_height FROM s")
def processing_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.processing_size(sizes(spark, sf_dir).filter("width > 0 and height > 0").select("image_id", "width", "height"), 1_600_000)


_TAPS = lambda n, m, name: f"""{name}0 AS (SELECT image_id, {n} AS n, {n}::DOUBLE / {m} AS scale, greatest({n}::DOUBLE / {m}, 1) AS wide, i, (i + 0.5) * ({n}::DOUBLE / {m}) AS c FROM dims, range(0, {m}) t(i)),
{name}1 AS (SELECT image_id, i, k, (k + 0.5 - c) / wide AS t FROM {name}0, range(greatest(0, floor(c - 3 * wide + 0.5))::BIGINT, least(n, floor(c + 3 * wide + 0.5))::BIGINT) r(k)),
{name}2 AS (SELECT image_id, i, k, CASE WHEN t = 0 THEN 1 WHEN abs(t) >= 3 THEN 0 ELSE 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * t * pi() * t) END AS w FROM {name}1),
{name} AS (SELECT image_id, i, k, w / sum(w) OVER (PARTITION BY image_id, i) AS w FROM {name}2)"""  # noqa: E731
_CHANNELS = (("r", 16), ("g", 8), ("b", 0))


# Tiles shrink to half their width and a third of their height.
@query("resampled_tiles", f"""WITH {TILES_SQL}, dims AS (SELECT *, greatest(height // 3, 1) AS mh, greatest(width // 2, 1) AS mw FROM (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM px GROUP BY image_id)),
{_TAPS("width", "mw", "ac")}, {_TAPS("height", "mh", "dn")},
rw AS (SELECT px.image_id, i AS x, y, {", ".join(f"sum(((rgb >> {s}) & 255) * w) AS {c}" for c, s in _CHANNELS)} FROM px JOIN ac ON ac.image_id = px.image_id AND ac.k = px.x GROUP BY ALL),
cl AS (SELECT rw.image_id, x, i AS y, {", ".join(f"least(greatest(floor(sum({c} * w) + 0.5), 0), 255)::BIGINT AS {c}" for c, _ in _CHANNELS)} FROM rw JOIN dn ON dn.image_id = rw.image_id AND dn.k = rw.y GROUP BY ALL)
SELECT cl.image_id, y * mw + x AS pos, x, y, r * 65536 + g * 256 + b AS rgb FROM cl JOIN dims ON dims.image_id = cl.image_id""")
def resampled_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = event_tiles(spark, sf_dir)
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return resampling.resample(px, sizes.withColumns({"process_width": F.greatest(F.floor(F.col("width") / 2), F.lit(1)), "process_height": F.greatest(F.floor(F.col("height") / 3), F.lit(1))}))


_PLACED = f"""{_SIZES}, r AS (SELECT *, {P.effective_margin(5.0, 0.1)!r}::DOUBLE AS m, CASE WHEN page = 'A4' THEN 210e0 ELSE 297e0 END AS s, CASE WHEN page = 'A4' THEN 297e0 ELSE 420e0 END AS l FROM sz WHERE width > 0 AND height > 0),
o AS (SELECT *, CASE WHEN orientation = 'landscape' THEN l ELSE s END - 2 * m AS rw, CASE WHEN orientation = 'landscape' THEN s ELSE l END - 2 * m AS rh FROM r),
k AS (SELECT *, CASE WHEN placement = 'fit' THEN least(rw / width, rh / height) ELSE greatest(rw / width, rh / height) END AS scale FROM o),
c AS (SELECT *, CASE WHEN placement = 'fit' THEN width ELSE floor(rw / scale)::BIGINT END AS crop_w, CASE WHEN placement = 'fit' THEN height ELSE floor(rh / scale)::BIGINT END AS crop_h FROM k),
pl AS (SELECT image_id, width, height, page, orientation, placement, scale, width * scale AS image_w_mm, height * scale AS image_h_mm, crop_w, crop_h, floor((width - crop_w) / 2)::BIGINT AS crop_left, floor((height - crop_h) / 2)::BIGINT AS crop_top, CASE WHEN placement = 'fit' THEN m + (rw - width * scale) / 2 ELSE m END AS offset_x_mm, CASE WHEN placement = 'fit' THEN m + (rh - height * scale) / 2 ELSE m END AS offset_y_mm FROM c)"""
_PLACED_FLOATS = ["scale", "image_w_mm", "image_h_mm", "offset_x_mm", "offset_y_mm"]


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.place_images(sizes(spark, sf_dir).filter("width > 0 and height > 0"), 5.0, 0.1)


@query("image_placement", f"WITH {_PLACED} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _PLACED_FLOATS)}) FROM pl")
def image_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(placed(spark, sf_dir), *_PLACED_FLOATS)


@query("page_positions", f"WITH {_PLACED} SELECT image_id, round(offset_x_mm + (width // 3 - crop_left) * scale, 6) AS x_mm, round(offset_y_mm + (height // 4 - crop_top) * scale, 6) AS y_mm, width // 3 BETWEEN crop_left AND crop_left + crop_w AND height // 4 BETWEEN crop_top AND crop_top + crop_h AS inside, ceil(round(2 / scale, 9))::BIGINT AS diameter FROM pl")
def page_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(spark, sf_dir)
    x, y = F.floor(F.col("width") / 3), F.floor(F.col("height") / 4)
    x_mm, y_mm = P.to_page(x, y)
    return rounded(p.select("image_id", x_mm.alias("x_mm"), y_mm.alias("y_mm"), P.in_crop(x, y).alias("inside"), F.ceil(F.round(2 / F.col("scale"), 9)).alias("diameter")), "x_mm", "y_mm")


@query("legend_layout", f"WITH {PALETTE_SQL} SELECT idx, number, name, rgb, idx // 12 AS page, idx % 12 // 4 AS \"column\", idx % 4 AS \"row\", round(56.7 + (idx % 12 // 4) * 118, 6)::DOUBLE AS x_pt, round(751.2 - (idx % 4) * 42.5, 6)::DOUBLE AS y_pt, (rgb >> 16) * 0.2126 + ((rgb >> 8) & 255) * 0.7152 + (rgb & 255) * 0.0722 < 150 AS dark FROM palette")
def legend_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.legend_layout(nation_palette(spark, sf_dir), 3, 4), "x_pt", "y_pt")


@query("legend_violations", f"WITH {PALETTE_SQL} SELECT idx FROM palette WHERE NOT (56.7 + (idx % 12 // 4) * 118 + 110 <= 395.3 AND 751.2 - (idx % 4) * 42.5 >= 14.2)")
def legend_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.layout_violations(P.legend_layout(nation_palette(spark, sf_dir), 3, 4), 409.5, 841.9, 14.2, 110.0, 42.5).select("idx")


_FILES = "fn AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'set' || p_size || '-v' || (p_partkey % 12000) || '.json' WHEN 1 THEN p_brand || '-v1.json' WHEN 2 THEN 'abc-v0' || p_size || '.json' ELSE 'p' || p_size || '-v' || p_size || '.json' END AS name FROM part)"


@query("palette_file_names", f"WITH {_FILES} SELECT p_partkey, name, CASE WHEN f THEN regexp_extract(name, '{palettes.FILE_NAME}', 1) END AS identity, CASE WHEN f THEN regexp_extract(name, '{palettes.FILE_NAME}', 2)::BIGINT END AS version, CASE WHEN f THEN name END AS again FROM (SELECT *, regexp_matches(name, '{palettes.FILE_NAME}') AS f FROM fn)")
def palette_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey") % 4
    name = F.when(key == 0, F.concat(F.lit("set"), "p_size", F.lit("-v"), F.col("p_partkey") % 12000, F.lit(".json"))).when(key == 1, F.concat("p_brand", F.lit("-v1.json"))).when(key == 2, F.concat(F.lit("abc-v0"), "p_size", F.lit(".json"))).otherwise(F.concat(F.lit("p"), "p_size", F.lit("-v"), "p_size", F.lit(".json")))
    rows = part.select("p_partkey", name.alias("name"))
    identity, version = palettes.parse_file_name(F.col("name"))
    return rows.select("p_partkey", "name", identity.alias("identity"), version.alias("version"), palettes.file_name(identity, version).alias("again"))


# Each nation gets three characters of a row of six, half of them outside the encoding.
@query("unsupported_code_points", "SELECT n_nationkey::BIGINT AS n_nationkey, array_to_string(list_transform(list_filter(string_split(substr('é日€ЖñΩ', n_nationkey % 5 + 1, 3), ''), lambda c: c IN ('日', 'Ж', 'Ω')), lambda c: 'U+' || printf('%04X', unicode(c))), ',') AS points FROM nation")
def unsupported_code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    points = palettes.unsupported_code_points(F.concat("n_name", F.substr(F.lit("é日€ЖñΩ"), F.col("n_nationkey") % 5 + 1, F.lit(3))))
    return n.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.array_join(points, ",").alias("points"))


@query("preview_overlay", f"WITH {TILES_SQL} SELECT image_id, x, y, CASE WHEN rgb % 7 = 0 THEN 16711680 ELSE rgb END AS rgb FROM px")
def preview_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = event_tiles(spark, sf_dir)
    return I.overlay(px, px.filter("rgb % 7 = 0")).select("image_id", "x", "y", "rgb")


# Bytes are compared as hexadecimal digits; pixels that a tile lacks are white.
_LITTLE = "(printf('%02X', ({v}) & 255) || printf('%02X', (({v}) >> 8) & 255) || printf('%02X', (({v}) >> 16) & 255) || printf('%02X', (({v}) >> 24) & 255))"
_HEADER = "'424D' || " + " || ".join(_LITTLE.format(v=v) for v in ("54 + data", "0", "54", "40", "width", "4294967296 - height")) + " || '01001800' || " + " || ".join(_LITTLE.format(v=v) for v in ("0", "data", "2835", "2835", "0", "0"))
_BITMAP = f"""dim AS (SELECT *, (width * 3 + 3) // 4 * 4 * height AS data FROM (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM px GROUP BY image_id)),
cell AS (SELECT d.image_id, d.width, gx.x, gy.y FROM dim d CROSS JOIN (SELECT unnest(range(50)) AS x) gx CROSS JOIN (SELECT unnest(range(50)) AS y) gy WHERE gx.x < d.width AND gy.y < d.height),
line AS (SELECT c.image_id, c.y, string_agg(printf('%02X', coalesce(rgb, 16777215) & 255) || printf('%02X', coalesce(rgb, 16777215) >> 8 & 255) || printf('%02X', coalesce(rgb, 16777215) >> 16 & 255), '' ORDER BY c.x) || repeat('00', (max(width) * 3 + 3) // 4 * 4 - max(width) * 3) AS bytes FROM cell c LEFT JOIN px ON px.image_id = c.image_id AND px.x = c.x AND px.y = c.y GROUP BY c.image_id, c.y)"""


@query("preview_bmp", f"WITH {TILES_SQL}, {_BITMAP} SELECT d.image_id, any_value(width) AS width, any_value(height) AS height, md5(any_value({_HEADER}) || string_agg(bytes, '' ORDER BY line.y)) AS hex_md5 FROM dim d JOIN line ON line.image_id = d.image_id GROUP BY d.image_id")
def preview_bmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.to_bmp(event_tiles(spark, sf_dir)).select("image_id", "width", "height", F.md5(F.hex("bmp").cast("binary")).alias("hex_md5"))


@query("vector_pages")
def vector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = event_tiles(spark, sf_dir)
    document = generate(px, nation_palette(spark, sf_dir), Options(tolerance=0.5))
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    place = P.place_images(size.withColumns({"page": F.lit("A4"), "orientation": F.lit("landscape"), "placement": F.lit("fit")}), 5.0, 0.1)
    return sinks.to_pdf(document.outlines, document.labels, place).select("image_id", F.sha2("pdf", 256).alias("pdf_sha256"))


_GLYPHS = ", ".join(f"('{c.replace(chr(39), chr(39) * 2)}', {w})" for c, w in legend.GLYPHS.items())
_WIDTH = lambda text: f"(SELECT sum(w) FROM unnest(string_split({text}, '')) t(c) JOIN glyph ON glyph.g = t.c)"


# Narrow columns, so that some names take two lines.
@query("legend_texts", f"""WITH {PALETTE_SQL}, glyph(g, w) AS (VALUES {_GLYPHS}),
wd AS (SELECT idx, nth, word, sum({_WIDTH("word")} * 0.009e0) OVER (PARTITION BY idx ORDER BY nth) + (nth - 1) * 278 * 0.009e0 AS upto FROM (SELECT idx, unnest(string_split(name, ' ')) AS word, generate_subscripts(string_split(name, ' '), 1) AS nth FROM palette)),
ln AS (SELECT idx, CASE WHEN upto <= 50 OR nth = 1 THEN 1 ELSE 2 END AS part, string_agg(word, ' ' ORDER BY nth) AS text FROM wd GROUP BY ALL),
ct AS (SELECT idx, count(*) AS many FROM ln GROUP BY idx),
pl AS (SELECT idx, number, rgb, idx // 12 AS page, 56.7e0 + (idx % 12 // 4) * 80 AS x, 751.2e0 - (idx % 4) * 42.5e0 AS y FROM palette)
SELECT idx, page, 0 AS part, number::VARCHAR AS text, round(x + (22.5e0 - length(number::VARCHAR) * 556 * 0.009e0) / 2, 6) AS x_pt, round(y + 7.75e0, 6) AS y_pt, (rgb >> 16) * 0.2126e0 + ((rgb >> 8) & 255) * 0.7152e0 + (rgb & 255) * 0.0722e0 < 150 AS light FROM pl
UNION ALL SELECT idx, page, part, text, round(x + 30, 6), round(y + 6.75e0 + (many - 1) * 4.5e0 - (part - 1) * 9, 6), false FROM pl JOIN ln USING (idx) JOIN ct USING (idx)""")
def legend_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = legend.LegendStyle(columns=3, rows=4, start_x=56.7, top_y=751.2, column_width=80.0)
    return rounded(legend.legend_texts(nation_palette(spark, sf_dir), style), "x_pt", "y_pt")


@query("json_results", f"WITH {PALETTE_SQL} SELECT idx, '{{\"idx\":' || idx || ',\"name\":\"' || name || '\",\"number\":' || number || '}}' AS record FROM palette")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_palette(spark, sf_dir).select("idx", sinks.json_record("number", "idx", "name").alias("record"))


# Measurements seen in lineitem and orders.
@query("duration_summary", "SELECT l_returnflag || l_linestatus AS stage, count(*) AS runs, min(l_quantity) AS least, median(l_quantity) AS median, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS greatest FROM lineitem GROUP BY ALL")
def duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.duration_summary(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("stage"), F.col("l_quantity").alias("seconds"))), "mean")


@query("paired_summary", "SELECT l_returnflag AS stage, median(l_quantity) AS before, median(l_extendedprice) AS after, round(median(l_extendedprice) - median(l_quantity), 6) AS delta, round(median(l_extendedprice) / median(l_quantity), 6) AS ratio, round((median(l_extendedprice) - median(l_quantity)) / median(l_quantity), 6) AS overhead FROM lineitem GROUP BY ALL")
def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.paired_summary(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("stage"), F.col("l_quantity").alias("before"), F.col("l_extendedprice").alias("after"))), "delta", "ratio", "overhead")


_POINTS = "pts AS (SELECT p_size::BIGINT * 120 AS workload, min(p_retailprice * (1 + p_partkey % 3)) / 500 + p_size * 0.05e0 AS speedup FROM part GROUP BY p_size)"


@query("break_even", f"WITH {_POINTS} SELECT min(workload) AS workload FROM pts p WHERE NOT EXISTS (SELECT 1 FROM pts o WHERE o.workload >= p.workload AND o.speedup < 2.5)")
def break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    points = part.groupBy("p_size").agg(F.min(F.col("p_retailprice") * (1 + F.col("p_partkey") % 3)).alias("m")).select((F.col("p_size").cast("long") * 120).alias("workload"), (F.col("m") / 500 + F.col("p_size") * 0.05).alias("speedup"))
    return B.break_even(points, 2.5)


_RUNS = "rn AS (SELECT p_size::BIGINT AS point, p_partkey % 8 + 1 AS workers, min(p_retailprice) AS seconds FROM part GROUP BY ALL)"


def _worker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_size").cast("long").alias("point"), (F.col("p_partkey") % 8 + 1).alias("workers")).agg(F.min("p_retailprice").alias("seconds"))


@query("worker_gains", f"WITH {_RUNS} SELECT a.point, a.workers, a.seconds, round((SELECT min(b.seconds) FROM rn b WHERE b.point = a.point AND b.workers < a.workers) / a.seconds, 6) AS gain FROM rn a")
def worker_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.worker_gains(_worker_runs(spark, sf_dir)), "gain")


@query("recommended_workers", f"WITH {_RUNS}, g AS (SELECT a.point, a.workers, coalesce((SELECT min(b.seconds) FROM rn b WHERE b.point = a.point AND b.workers < a.workers) / a.seconds >= 1, false) AS good, row_number() OVER (PARTITION BY a.workers ORDER BY a.point) AS r FROM rn a) SELECT coalesce(max(a.workers), 1) AS workers FROM g a JOIN g b ON a.workers = b.workers AND b.r = a.r + 1 WHERE a.good AND b.good")
def recommended_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.recommended_workers(_worker_runs(spark, sf_dir), 1.0, 2)


@query("worker_counts", "SELECT p_partkey, (SELECT string_agg(v::VARCHAR, ',' ORDER BY v) FROM (SELECT DISTINCT v FROM (SELECT 1 << k AS v FROM range(0, 40) t(k) WHERE 1 << k <= least(64, p_size, p_partkey % 50 + 1) UNION ALL SELECT least(64, p_size, p_partkey % 50 + 1)))) AS counts FROM part")
def worker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lit(64).cast("long").alias("cpus"), F.col("p_size").cast("long").alias("units"), (F.col("p_partkey") % 50 + 1).alias("most"))
    return B.worker_counts(limits).select("p_partkey", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query("calibration_points", "SELECT a.workload, round(CASE WHEN b IS NULL THEN 0 ELSE o / b END, 6) AS speedup FROM (SELECT p_size::BIGINT * 120 AS workload, max(p_retailprice) FILTER (WHERE p_partkey % 8 = 0) AS o, min(p_retailprice) FILTER (WHERE p_partkey % 8 > 0) AS b FROM part GROUP BY p_size) a")
def calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("long").alias("unique_colours"), F.lit(120).cast("long").alias("palette_colours"), (F.col("p_partkey") % 8 + 1).alias("workers"), F.col("p_retailprice").alias("seconds"))
    return rounded(B.calibration_points(runs), "speedup")


@query("validation_breakdown", "SELECT o_orderpriority AS kind, count(*) AS calls, round(sum(o_totalprice), 2) AS seconds, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS share FROM orders GROUP BY ALL")
def validation_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.validation_breakdown(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("seconds")))
    return found.withColumns({"seconds": F.round("seconds", 2), "share": F.round("share", 6)})
