"""Queries on regions, borders and merge costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.functions.steps import steps_sql
from tessella.operators import merging as M
from tessella.operators import regions as R
from tessella.plans.colour_queries import DIAGNOSED, QUANTIZED, diagnosed, quantized, rounded
from tessella.plans.registry import query, with_sql
from tessella.sources.lenses import nation_palette

DIAMETER = 3

# Subqueries in SQL, each on those before it.
REGIONS = [
    *QUANTIZED,
    "step AS (SELECT a.image_id, a.pos AS p, b.pos AS n FROM q a JOIN q b ON a.image_id = b.image_id AND a.idx = b.idx AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND b.pos IN (a.pos - 1, a.pos + 1, a.pos - 50, a.pos + 50))",
    """cc(image_id, pos, label) USING KEY (image_id, pos) AS (
  SELECT image_id, pos, pos FROM q
  UNION
  SELECT o.image_id, o.pos, min(c.label) FROM cc c JOIN step e ON e.image_id = c.image_id AND e.n = c.pos
  JOIN recurring.cc o ON o.image_id = e.image_id AND o.pos = e.p WHERE c.label < o.label GROUP BY o.image_id, o.pos)""",
    "reg AS (SELECT q.image_id, q.pos, q.x, q.y, q.idx, dense_rank() OVER (PARTITION BY q.image_id ORDER BY cc.label) AS region_id FROM q JOIN cc ON cc.image_id = q.image_id AND cc.pos = q.pos)",
]
BORDERS = """side AS (
  SELECT a.image_id, a.region_id AS r1, b.region_id AS r2 FROM reg a JOIN reg b ON a.image_id = b.image_id AND a.region_id <> b.region_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.y = a.y + 1 AND b.x = a.x)) AND b.pos IN (a.pos + 1, a.pos + 50)),
bor AS (SELECT image_id, src, dst, count(*) AS length FROM (SELECT image_id, r1 AS src, r2 AS dst FROM side UNION ALL SELECT image_id, r2, r1 FROM side) GROUP BY ALL)"""
TABLE = """near AS (SELECT a.image_id, a.pos, count(*) AS same FROM reg a JOIN reg b ON a.image_id = b.image_id AND a.region_id = b.region_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND b.pos IN (a.pos - 1, a.pos + 1, a.pos - 50, a.pos + 50) GROUP BY ALL),
rt AS (SELECT r.image_id, region_id, min(idx) AS idx, count(*) AS area, sum(4 - coalesce(same, 0))::BIGINT AS perimeter, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, min(r.pos) AS first_pos FROM reg r LEFT JOIN near n ON n.image_id = r.image_id AND n.pos = r.pos GROUP BY r.image_id, region_id)"""


def fit_sql(diameter: int) -> str:
    r = diameter / 2
    offsets = ", ".join(f"({dx}, {dy})" for dx, dy in R.disc_offsets(diameter))
    return f"""disc(dx, dy) AS (VALUES {offsets}),
fit AS (SELECT DISTINCT c.image_id, c.region_id FROM (
  SELECT c.image_id, c.region_id, c.x, c.y FROM reg c CROSS JOIN disc JOIN reg p ON p.image_id = c.image_id AND p.region_id = c.region_id AND p.x = c.x + dx AND p.y = c.y + dy
  GROUP BY c.image_id, c.region_id, c.x, c.y HAVING count(*) = (SELECT count(*) FROM disc)) c
  JOIN rt ON rt.image_id = c.image_id AND rt.region_id = c.region_id AND c.x BETWEEN ceil(min_x + {r}) AND floor(max_x - {r}) AND c.y BETWEEN ceil(min_y + {r}) AND floor(max_y - {r}))"""


PALETTE_PAIRS = "pd AS (" + steps_sql("(SELECT a.idx AS source_idx, a.l2 AS l1, a.a2 AS a1, a.b2 AS b1, b.idx AS target_idx, b.l2, b.a2, b.b2 FROM plab a CROSS JOIN plab b)", color.DELTA_E_2000, ["source_idx", "target_idx", "de"]) + ")"
CAND_COLUMNS = ["image_id", "source_id", "target_id", "border", "source_idx", "target_idx", "source_area", "target_area", "source_perimeter", "target_perimeter", "de"]
CANDIDATES = "mc AS (" + steps_sql("(SELECT b.image_id, b.src AS source_id, b.dst AS target_id, b.length AS border, s.idx AS source_idx, t.idx AS target_idx, s.area AS source_area, t.area AS target_area, s.perimeter AS source_perimeter, t.perimeter AS target_perimeter, pd.de FROM bor b JOIN rt s ON s.image_id = b.image_id AND s.region_id = b.src JOIN rt t ON t.image_id = b.image_id AND t.region_id = b.dst JOIN pd ON pd.source_idx = s.idx AND pd.target_idx = t.idx)", [*M.DERIVED, *M.cost_steps()], [*CAND_COLUMNS, *M.MEASURES, *M.COSTS, "protect"]) + ")"
MERGING = [*REGIONS, BORDERS, TABLE, PALETTE_PAIRS, CANDIDATES]


def region_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.detect_regions(quantized(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    px = region_pixels(spark, sf_dir)
    table = R.region_table(px)
    return table, M.costed(M.candidates(table, R.shared_borders(px), nation_palette(spark, sf_dir)))


@query("detect_regions", with_sql(REGIONS, "SELECT * FROM reg", True))
def detect_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_pixels(spark, sf_dir)


@query("region_table", with_sql([*REGIONS, TABLE], "SELECT * FROM rt", True))
def region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.region_table(region_pixels(spark, sf_dir))


@query("region_set_stats", with_sql([*REGIONS, TABLE], "SELECT image_id, count(*) AS regions, sum(area)::BIGINT AS pixels, max(area) AS largest, sum((max_x - min_x + 1) * (max_y - min_y + 1))::BIGINT AS box_area, max((max_x - min_x + 1) * (max_y - min_y + 1)) AS largest_box FROM rt GROUP BY image_id", True))
def region_set_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.region_set_stats(R.region_table(region_pixels(spark, sf_dir)))


@query("shared_borders", with_sql([*REGIONS, BORDERS], "SELECT * FROM bor", True))
def shared_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shared_borders(region_pixels(spark, sf_dir))


# Two lattices of 7 x 7 blocks, the second moved by 3 pixels, share pixels.
_BLOCKS = "mem AS (SELECT DISTINCT image_id, x // 7 + 8 * (y // 7) AS region_id, x, y FROM px UNION SELECT image_id, 100 + (x + 3) // 7 + 9 * (y // 7) AS region_id, x, y FROM px)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.sources.lenses import event_tiles

    px = event_tiles(spark, sf_dir)
    first = px.select("image_id", (F.floor(F.col("x") / 7) + 8 * F.floor(F.col("y") / 7)).alias("region_id"), "x", "y")
    return first.union(px.select("image_id", 100 + F.floor((F.col("x") + 3) / 7) + 9 * F.floor(F.col("y") / 7), "x", "y")).distinct()


@query("overlapping_borders", with_sql([QUANTIZED[0], _BLOCKS], "SELECT a.image_id, a.region_id AS src, b.region_id AS dst, count(*) AS length FROM mem a JOIN mem b ON a.image_id = b.image_id AND a.region_id <> b.region_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL"))
def overlapping_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlapping_borders(blocks(spark, sf_dir))


_UNIONS = """pr AS (SELECT DISTINCT a.image_id, a.region_id AS src, b.region_id AS dst FROM mem a JOIN mem b ON a.image_id = b.image_id AND a.region_id <> b.region_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
un AS (SELECT DISTINCT pr.image_id, src, dst, x, y FROM pr JOIN mem m ON m.image_id = pr.image_id AND m.region_id IN (src, dst))"""


# In SQL every pair's pixels are put together and their open sides counted.
@query("union_measures", with_sql([QUANTIZED[0], _BLOCKS, _UNIONS], "SELECT u.image_id, u.src, u.dst, count(DISTINCT (u.x, u.y)) AS union_area, (4 * count(DISTINCT (u.x, u.y)) - count(n.x))::BIGINT AS union_perimeter FROM un u LEFT JOIN un n ON n.image_id = u.image_id AND n.src = u.src AND n.dst = u.dst AND abs(n.x - u.x) + abs(n.y - u.y) = 1 GROUP BY u.image_id, u.src, u.dst"))
def union_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = blocks(spark, sf_dir)
    return M.union_measures(members, R.overlapping_borders(members))


@query("overlapping_images", with_sql([QUANTIZED[0], _BLOCKS], "SELECT image_id, max(n) > 1 AS overlapping FROM (SELECT image_id, x, y, count(DISTINCT region_id) AS n FROM mem GROUP BY ALL) GROUP BY image_id"))
def overlapping_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlapping_images(blocks(spark, sf_dir))


@query("region_neighbours", with_sql([*REGIONS, BORDERS, TABLE], "SELECT rt.image_id, rt.region_id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS neighbours FROM rt LEFT JOIN bor ON bor.image_id = rt.image_id AND bor.src = rt.region_id GROUP BY ALL", True))
def region_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = region_pixels(spark, sf_dir)
    found = R.neighbours(px.select("image_id", "region_id").distinct(), R.shared_borders(px))
    return found.withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query("merged_borders", with_sql([*REGIONS, BORDERS], "SELECT image_id, (src + 1) // 2 AS src, (dst + 1) // 2 AS dst, sum(length)::BIGINT AS length FROM bor WHERE (src + 1) // 2 <> (dst + 1) // 2 GROUP BY ALL", True))
def merged_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = region_pixels(spark, sf_dir)
    mapping = px.select("image_id", "region_id").distinct().withColumn("final_id", F.floor((F.col("region_id") + 1) / 2))
    return R.merged_borders(R.shared_borders(px), mapping)


@query("disc_offsets", " UNION ALL ".join(f"SELECT {d}::BIGINT AS diameter, x::BIGINT AS dx, y::BIGINT AS dy FROM range(-{d // 2}, {d // 2 + 1}) a(x), range(-{d // 2}, {d // 2 + 1}) b(y) WHERE x * x + y * y <= {d / 2} * {d / 2}" for d in (1, 2, 3, 4, 5, 8)))
def disc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d, dx, dy) for d in (1, 2, 3, 4, 5, 8) for dx, dy in R.disc_offsets(d)], "diameter long, dx long, dy long")


@query("fitting_regions", with_sql([*REGIONS, TABLE, fit_sql(DIAMETER)], "SELECT * FROM fit", True))
def fitting_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fitting_regions(region_pixels(spark, sf_dir), DIAMETER)


@query("paintability", with_sql([*REGIONS, BORDERS, TABLE, fit_sql(DIAMETER)], "SELECT image_id, region_id, EXISTS (SELECT 1 FROM bor WHERE bor.image_id = rt.image_id AND bor.src = rt.region_id) AS mergeable FROM rt WHERE NOT EXISTS (SELECT 1 FROM fit WHERE fit.image_id = rt.image_id AND fit.region_id = rt.region_id)", True))
def paintability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paintability(region_pixels(spark, sf_dir), DIAMETER)


@query("first_merge_targets", with_sql([*REGIONS, BORDERS, TABLE, fit_sql(DIAMETER)], "SELECT b.image_id, b.src AS region_id, arg_min(b.dst, row(-b.length, b.dst)) AS target_id, max(b.length) AS length FROM bor b WHERE NOT EXISTS (SELECT 1 FROM fit WHERE fit.image_id = b.image_id AND fit.region_id = b.src) GROUP BY b.image_id, b.src", True))
def first_merge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = region_pixels(spark, sf_dir)
    return R.merge_targets(R.paintability(px, DIAMETER), R.shared_borders(px))


@query("stage_loss", with_sql([*REGIONS, TABLE, *(fit_sql(d).replace("disc(", f"disc{d}(").replace("CROSS JOIN disc ", f"CROSS JOIN disc{d} ").replace("FROM disc)", f"FROM disc{d})").replace("fit AS", f"fit{d} AS") for d in (2, 3, 5))], "SELECT rt.image_id, d.diameter, count(*) AS detected, count(*) FILTER (WHERE f.region_id IS NOT NULL) AS paintable FROM rt CROSS JOIN (SELECT unnest([2, 3, 5])::BIGINT AS diameter) d LEFT JOIN (SELECT 2 AS diameter, * FROM fit2 UNION ALL SELECT 3, * FROM fit3 UNION ALL SELECT 5, * FROM fit5) f ON f.image_id = rt.image_id AND f.region_id = rt.region_id AND f.diameter = d.diameter GROUP BY ALL", True))
def stage_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = region_pixels(spark, sf_dir)
    all_regions, out = px.select("image_id", "region_id").distinct(), None
    for d in (2, 3, 5):
        part = all_regions.join(R.fitting_regions(px, d).withColumn("fits", F.lit(1)), ["image_id", "region_id"], "left").groupBy("image_id").agg(F.count("*").alias("detected"), F.count("fits").alias("paintable")).withColumn("diameter", F.lit(d).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


# Boundary components: edges of collapsed boundaries that share grid points.
_EDGES = """bedge AS (SELECT a.image_id, orientation, x, y, CASE orientation WHEN 'horizontal' THEN x + 1 ELSE x END AS x1, CASE orientation WHEN 'horizontal' THEN y ELSE y + 1 END AS y1, x + 1 AS x2, y + 1 AS y2, a.idx, d.source_de, d.rescue_cost
  FROM adj a JOIN diag d ON d.image_id = a.image_id AND d.first_rgb = least(rgb, nrgb) AND d.second_rgb = greatest(rgb, nrgb) AND d.idx = a.idx WHERE a.idx = a.nidx AND rgb <> nrgb AND source_de > 1.5),
enum AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x, orientation) AS e FROM bedge),
pt AS (SELECT image_id, e, unnest([y1 * 4294967296 + x1, y2 * 4294967296 + x2]) AS point FROM enum),
link AS (SELECT DISTINCT a.image_id, a.e AS e1, b.e AS e2 FROM pt a JOIN pt b ON a.image_id = b.image_id AND a.point = b.point AND a.e <> b.e),
ec(image_id, e, label) USING KEY (image_id, e) AS (
  SELECT image_id, e, e FROM enum
  UNION
  SELECT o.image_id, o.e, min(c.label) FROM ec c JOIN link l ON l.image_id = c.image_id AND l.e2 = c.e JOIN recurring.ec o ON o.image_id = l.image_id AND o.e = l.e1 WHERE c.label < o.label GROUP BY o.image_id, o.e),
lab2 AS (SELECT enum.*, dense_rank() OVER (PARTITION BY enum.image_id ORDER BY label) AS component FROM enum JOIN ec ON ec.image_id = enum.image_id AND ec.e = enum.e)"""
_COMPONENTS = """SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY edges DESC, mean_cost NULLS LAST, mean_de DESC, min_y, min_x, max_y, max_x, dominant_idx, component) AS rank FROM (
SELECT image_id, component, count(*) AS edges, min(x1) AS min_x, min(y1) AS min_y, max(x2) AS max_x, max(y2) AS max_y, round(min(source_de), 6) AS min_de, round(max(source_de), 6) AS max_de, round(avg(source_de), 6) AS mean_de, round(min(rescue_cost), 6) AS min_cost, round(avg(rescue_cost), 6) AS mean_cost, count(*) FILTER (WHERE rescue_cost IS NULL) AS unavailable,
 (SELECT arg_min(idx, row(-n, idx)) FROM (SELECT idx, count(*) AS n FROM lab2 i WHERE i.image_id = o.image_id AND i.component = o.component GROUP BY idx)) AS dominant_idx
FROM lab2 o GROUP BY image_id, component)"""


@query("boundary_components", with_sql([*DIAGNOSED, _EDGES], _COMPONENTS, True))
def boundary_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.collisions import boundary_edges

    q, diagnostics = diagnosed(spark, sf_dir)
    found = R.boundary_components(R.components_by_points(boundary_edges(q, diagnostics, 1.5)))
    return rounded(found, "min_de", "max_de", "mean_de", "min_cost", "mean_cost")


_FLOATS = ["de", *M.MEASURES[2:], *M.COSTS]


# Written from the definitions, apart from the formulas that the plan runs.
_BY_HAND = """own AS (SELECT image_id, source_id, target_id, border, source_idx, target_idx, source_area, target_area, source_perimeter, target_perimeter, de,
    source_area + target_area AS ma, source_perimeter + target_perimeter - 2 * border AS mp, pow(target_perimeter, 2) / target_area AS tc, border / source_perimeter::DOUBLE AS enc, source_area / (source_area + target_area)::DOUBLE AS ar, de / (10 + de) AS cp,
    least(4 * pi() * source_area / pow(source_perimeter, 2), 1) AS round_ FROM mc),
grown AS (SELECT *, pow(mp, 2) / ma AS mc2, pow(mp, 2) / ma - tc AS cc, CASE WHEN pow(mp, 2) / ma > tc THEN (pow(mp, 2) / ma - tc) / (pow(mp, 2) / ma) ELSE 0 END AS gp FROM own),
based AS (SELECT *, 0.4 * cp + 0.25 * ar + 0.15 * (1 - enc) + 0.2 * gp AS bc FROM grown),
held AS (SELECT *, 1 - (1 - bc) * (1 - 0.5 * enc * cp * (1 - ar)) AS ec FROM based),
total AS (SELECT *, 1 - (1 - ec) * (1 - 0.15 * (1 - round_) * cp * (1 - ar)) AS tcost FROM held)"""
_OWN_LIST = ", ".join([*CAND_COLUMNS[:-1], "ma AS merged_area", "mp AS merged_perimeter", *(f"round({c}, 6) AS {n}" for n, c in {"de": "de", "area_ratio": "ar", "source_border_ratio": "enc", "target_border_ratio": "border / target_perimeter::DOUBLE", "source_compactness": "round_", "target_complexity": "tc", "merged_complexity": "mc2", "complexity_change": "cc", "color_penalty": "cp", "border_penalty": "1 - enc", "geometry_penalty": "gp", "base_cost": "bc", "enclosed_cost": "ec", "cost": "tcost"}.items())])


@query("merge_candidates", with_sql([*MERGING, _BY_HAND], f"SELECT {_OWN_LIST} FROM total", True))
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates(spark, sf_dir)[1].select(*CAND_COLUMNS, *M.MEASURES, *M.COSTS), *_FLOATS)


# Candidates with an end in a region that holds no disc.
@query("touching_candidates", with_sql([*MERGING, fit_sql(DIAMETER)], "SELECT image_id, source_id, target_id, border FROM mc WHERE NOT EXISTS (SELECT 1 FROM fit WHERE fit.image_id = mc.image_id AND fit.region_id = mc.source_id) OR NOT EXISTS (SELECT 1 FROM fit WHERE fit.image_id = mc.image_id AND fit.region_id = mc.target_id)", True))
def touching_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = region_pixels(spark, sf_dir)
    touching = R.paintability(px, DIAMETER).select("image_id", "region_id")
    found = M.candidates(R.region_table(px), R.shared_borders(px), nation_palette(spark, sf_dir), touching=touching)
    return found.select("image_id", "source_id", "target_id", "border")


@query("ranked_candidates", with_sql(MERGING, "SELECT m.image_id, source_id, target_id, round(cost, 6) AS cost, row_number() OVER (PARTITION BY m.image_id ORDER BY round(cost, 9), source_id, target_id) AS rank, p.name AS source_name, p.number AS source_number, t.number AS target_number, r.min_x, r.min_y, r.max_x, r.max_y FROM mc m JOIN rt r ON r.image_id = m.image_id AND r.region_id = m.source_id JOIN palette p ON p.idx = source_idx JOIN palette t ON t.idx = target_idx", True))
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = candidates(spark, sf_dir)
    names = nation_palette(spark, sf_dir)
    rows = M.ranked(rows).join(F.broadcast(names.select(F.col("idx").alias("source_idx"), F.col("name").alias("source_name"), F.col("number").alias("source_number"))), "source_idx")
    rows = rows.join(F.broadcast(names.select(F.col("idx").alias("target_idx"), F.col("number").alias("target_number"))), "target_idx")
    rows = rows.join(table.select("image_id", F.col("region_id").alias("source_id"), "min_x", "min_y", "max_x", "max_y").hint("merge"), ["image_id", "source_id"])
    return rounded(rows.select("image_id", "source_id", "target_id", "cost", "rank", "source_name", "source_number", "target_number", "min_x", "min_y", "max_x", "max_y"), "cost")


@query("protected_ranking", with_sql(MERGING, "SELECT image_id, source_id, target_id, round(c, 6) AS protected, row_number() OVER (PARTITION BY image_id ORDER BY round(c, 9), source_id, target_id) AS rank FROM (SELECT *, base_cost + 0.75 * source_border_ratio * protect * (1 - base_cost) AS c FROM mc)", True))
def protected_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)[1].withColumn("protected", M.protected_cost(0.75))
    return rounded(M.ranked(rows, "protected").select("image_id", "source_id", "target_id", "protected", "rank"), "protected")


@query("combined_protection", with_sql(MERGING, "SELECT image_id, source_id, target_id, w AS weights, round(CASE w WHEN 'production' THEN e1 + 0.15 * (1 - source_compactness) * protect * (1 - e1) ELSE e2 + 0.15 * (1 - source_compactness) * protect * (1 - e2) END, 6) AS cost FROM (SELECT *, b1 + 0.5 * source_border_ratio * protect * (1 - b1) AS e1, b2 + 0.5 * source_border_ratio * protect * (1 - b2) AS e2 FROM (SELECT *, 0.4 * color_penalty + 0.25 * area_ratio + 0.15 * border_penalty + 0.2 * geometry_penalty AS b1, 0.6 * color_penalty + 0.15 * area_ratio + 0.15 * border_penalty + 0.1 * geometry_penalty AS b2 FROM mc)) CROSS JOIN (SELECT unnest(['production', 'colour-focused']) AS w)", True))
def combined_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = region_pixels(spark, sf_dir)
    rows = M.candidates(R.region_table(px), R.shared_borders(px), nation_palette(spark, sf_dir))
    out = None
    for name, weights in M.WEIGHTS.items():
        part = rounded(M.costed(rows, weights).select("image_id", "source_id", "target_id", F.lit(name).alias("weights"), "cost"), "cost")
        out = part if out is None else out.unionByName(part)
    return out


_SCORES = "sc AS (SELECT m.*, s.strategy, ((de / (de + scale)) * c + area_ratio * a + border_penalty * b + geometry_penalty * g) / (c + a + b + g) AS score FROM mc m CROSS JOIN (VALUES " + ", ".join(f"('{n}', {', '.join(f'{v}e0' for v in values)})" for n, *values in M.STRATEGIES) + ") s(strategy, scale, c, a, b, g))"


@query("strategy_cohorts", with_sql([*MERGING, _SCORES], "SELECT image_id, strategy, count(*) AS cohort, round(avg(de), 6) AS mean_de, round(avg(area_ratio), 6) AS mean_area_ratio, round(avg(source_border_ratio), 6) AS mean_border_ratio, round(avg(complexity_change), 6) AS mean_complexity_change, round(max(score), 6) AS max_score FROM (SELECT *, row_number() OVER (PARTITION BY image_id, strategy ORDER BY round(score, 9), source_id, target_id) AS r, count(*) OVER (PARTITION BY image_id, strategy) AS n FROM sc) WHERE r <= greatest(1, ceil(n * 0.1)) GROUP BY image_id, strategy", True))
def strategy_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.strategy_cohorts(M.strategy_scores(candidates(spark, sf_dir)[1]))
    return rounded(found, "mean_de", "mean_area_ratio", "mean_border_ratio", "mean_complexity_change", "max_score")


@query("neighbour_contrast", with_sql(MERGING, "SELECT image_id, source_id, count(*) AS neighbours, sum(border)::BIGINT AS total_border, round(sum(border) / max(source_perimeter), 6) AS coverage, round(max(border) / sum(border), 6) AS dominant_share, round(min(de), 6) AS min_de, round(max(de), 6) AS max_de, round(avg(de), 6) AS mean_de, round(sum(border * de) / sum(border), 6) AS weighted_de, round(sum(border * de / (de + 10)) / sum(border), 6) AS weighted_penalty FROM mc GROUP BY image_id, source_id", True))
def neighbour_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.neighbour_contrast(candidates(spark, sf_dir)[1]), "coverage", "dominant_share", "min_de", "max_de", "mean_de", "weighted_de", "weighted_penalty")


@query("fragile_details", with_sql(MERGING, "SELECT rt.image_id, rt.region_id, area, perimeter, round(m.min_de, 6) AS min_de FROM rt JOIN (SELECT image_id, source_id, min(de) AS min_de FROM mc GROUP BY ALL) m ON m.image_id = rt.image_id AND m.source_id = rt.region_id WHERE (area <= 3 * pi() * 2.25 OR 4 * pi() * area / (perimeter * perimeter) <= 0.3) AND m.min_de >= 5", True))
def fragile_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = candidates(spark, sf_dir)
    return rounded(M.fragile_details(table, rows, DIAMETER), "min_de")


METRICS = ["de", "source_area", "target_area", "merged_area", "area_ratio", "border", "source_border_ratio", "target_border_ratio", "source_perimeter", "merged_perimeter", "merged_complexity", "complexity_change"]


@query("metric_distributions", with_sql(MERGING, " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS n, round(min({m})::DOUBLE, 6) AS least, " + ", ".join(f"round(quantile_cont({m}::DOUBLE, {p / 100}), 6) AS p{p:02d}" for p in (5, 25, 50, 75, 95)) + f", round(max({m})::DOUBLE, 6) AS greatest FROM mc" for m in METRICS), True))
def metric_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.metric_distributions(candidates(spark, sf_dir)[1], METRICS), "least", "p05", "p25", "p50", "p75", "p95", "greatest")
