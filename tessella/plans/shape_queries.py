"""Queries on merging, reduction, outlines and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.color import with_lab
from tessella.operators import contraction as N
from tessella.operators import folds as D
from tessella.operators import labels as L
from tessella.operators import leaders as C
from tessella.operators import outlines as O
from tessella.operators import overlaps as V
from tessella.operators import quantize as Q
from tessella.operators import regions as R
from tessella.operators import replay as P
from tessella.operators import topology as T
from tessella.plans.colour_queries import rounded
from tessella.plans.region_queries import DIAMETER, REGIONS, TABLE, region_pixels
from tessella.plans.registry import query, with_sql
from tessella.sources.lenses import event_tiles, nation_palette
from tessella.tables import stored


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.merged_regions(region_pixels(spark, sf_dir), DIAMETER)


def reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.reduced_regions(merged(spark, sf_dir), nation_palette(spark, sf_dir), DIAMETER, 8, 0.6)


@query("mandatory_merge")
def mandatory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir)


@query("region_reduction")
def region_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduced(spark, sf_dir)


@query("merge_trace")
def merge_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.merge_trace(merged(spark, sf_dir), nation_palette(spark, sf_dir), DIAMETER, 8, 0.6), "cost")


def traced_merges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Regions and borders before the reduction, its trace, and the palette."""
    palette = nation_palette(spark, sf_dir)
    members = stored(merged(spark, sf_dir), "merged")
    return R.region_table(members.withColumn("pos", F.lit(0))), R.shared_borders(members), stored(N.merge_trace(members, palette, DIAMETER, 8, 0.6), "trace"), palette


@query("accepted_merges")
def accepted_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.accepted_merges(*traced_merges(spark, sf_dir))
    return rounded(found.select("image_id", "step", "source_id", "target_id", "source_idx", "target_idx", "source_area", "target_area", "border", "source_perimeter", "target_perimeter", "de", "base_cost", "cost"), "de", "base_cost", "cost")


@query("accepted_contrast")
def accepted_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.accepted_contrast(*traced_merges(spark, sf_dir)), "coverage", "dominant_share", "min_de", "max_de", "mean_de", "weighted_de", "weighted_penalty", "target_share")


@query("mandatory_stage_loss")
def mandatory_stage_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each image as detected and after the mandatory merge."""
    return N.stage_loss(region_pixels(spark, sf_dir), DIAMETER)


@query("reduction_matrix")
def reduction_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.reduction_matrix(merged(spark, sf_dir), nation_palette(spark, sf_dir), DIAMETER, [0.25, 0.5, 0.75], [0.3, 0.6]), "reduction")


@query("leader_clusters")
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.leader_clusters(with_lab(Q.unique_colours(event_tiles(spark, sf_dir))), 2.0)


@query("leader_clusters_2000")
def leader_clusters_2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.leader_clusters(with_lab(Q.unique_colours(event_tiles(spark, sf_dir))), 2.0, "delta_e_2000")


def local_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.local_components(with_lab(event_tiles(spark, sf_dir)), 5.0)


@query("local_components")
def local_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.local_component_table(local_members(spark, sf_dir), DIAMETER)


@query("local_component_summary")
def local_component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.local_component_summary(local_components(spark, sf_dir))


@query("unpaintable_components")
def unpaintable_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.unpaintable_components(local_members(spark, sf_dir), DIAMETER), "de")


_SIDES = ", ".join("(" + ", ".join(map(str, s)) + ")" for s in O.SIDES)


@query("boundary_edges", with_sql([*REGIONS, f"sd(dx, dy, px1, py1, px2, py2) AS (VALUES {_SIDES})"], "SELECT r.image_id, r.region_id, r.x + px1 AS sx, r.y + py1 AS sy, r.x + px2 AS ex, r.y + py2 AS ey, o.region_id AS other FROM reg r CROSS JOIN sd LEFT JOIN reg o ON o.image_id = r.image_id AND o.x = r.x + dx AND o.y = r.y + dy WHERE o.region_id IS NULL OR o.region_id <> r.region_id", True))
def boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.boundary_edges(region_pixels(spark, sf_dir))


@query("outlines")
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = O.trace_outlines(region_pixels(spark, sf_dir))
    return traced.select("image_id", "region_id", F.to_json("points").alias("points"), F.to_json("hole_rings").alias("hole_rings"))


# Raw outlines have a vertex for every exposed side, and enclose exactly the region's pixels.
@query("outline_areas", with_sql([*REGIONS, TABLE], "SELECT image_id, region_id, area::DOUBLE AS area FROM rt", True))
def outline_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.outline_areas(O.trace_outlines(region_pixels(spark, sf_dir)))


@query("raw_outline_vertices", with_sql([*REGIONS, TABLE], "SELECT image_id, count(*) AS outlines, sum(perimeter)::BIGINT AS vertices, max(perimeter) AS most_vertices FROM rt GROUP BY image_id", True))
def raw_outline_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.outline_set_stats(O.trace_outlines(region_pixels(spark, sf_dir), raw=True)).select("image_id", "outlines", "vertices", "most_vertices")


@query("outline_set_stats")
def outline_set_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.outline_set_stats(O.trace_outlines(merged(spark, sf_dir)))


@query("simplified_outlines")
def simplified_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = O.trace_outlines(merged(spark, sf_dir), tolerance=1.0)
    return traced.select("image_id", "region_id", F.to_json("points").alias("points"), F.to_json("hole_rings").alias("hole_rings"))


@query("outline_reduction")
def outline_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = merged(spark, sf_dir)
    return rounded(O.point_reduction(O.trace_outlines(members), O.trace_outlines(members, tolerance=1.0)), "reduction")


# Edges with the one after them; of two at a corner the one that turns right. Chains are walked from their cuts on.
_CHAINS = [
    f"sd(dx, dy, px1, py1, px2, py2) AS (VALUES {_SIDES})",
    "bnd AS MATERIALIZED (SELECT r.image_id, r.region_id, r.x + px1 AS sx, r.y + py1 AS sy, r.x + px2 AS ex, r.y + py2 AS ey, o.region_id AS other FROM reg r CROSS JOIN sd LEFT JOIN reg o ON o.image_id = r.image_id AND o.x = r.x + dx AND o.y = r.y + dy WHERE o.region_id IS NULL OR o.region_id <> r.region_id)",
    """nxt AS MATERIALIZED (SELECT e.*, o.ex AS nx, o.ey AS ny, e.other IS DISTINCT FROM o.other AS cut FROM bnd e JOIN bnd o ON o.image_id = e.image_id AND o.region_id = e.region_id AND o.sx = e.ex AND o.sy = e.ey
  QUALIFY row_number() OVER (PARTITION BY e.image_id, e.region_id, e.sx, e.sy, e.ex, e.ey ORDER BY (o.ex - o.sx = e.sy - e.ey AND o.ey - o.sy = e.ex - e.sx) DESC) = 1)""",
    """walk AS (SELECT image_id, region_id, ex AS sx, ey AS sy, nx AS ex, ny AS ey, [(ex, ey), (nx, ny)] AS pts FROM nxt WHERE cut
  UNION ALL SELECT n.image_id, n.region_id, n.ex, n.ey, n.nx, n.ny, list_append(pts, (n.nx, n.ny)) FROM walk w JOIN nxt n ON n.image_id = w.image_id AND n.region_id = w.region_id AND n.sx = w.sx AND n.sy = w.sy AND n.ex = w.ex AND n.ey = w.ey AND NOT n.cut)""",
    "whole AS (SELECT w.image_id, pts FROM walk w JOIN nxt n ON n.image_id = w.image_id AND n.region_id = w.region_id AND n.sx = w.sx AND n.sy = w.sy AND n.ex = w.ex AND n.ey = w.ey AND n.cut)",
]


@query("border_chains", with_sql([*REGIONS, *_CHAINS], "SELECT image_id, count(DISTINCT least(pts, list_reverse(pts))) AS open_chains, count(*) AS open_refs, (SELECT count(DISTINCT (ex, ey)) FROM nxt n WHERE n.cut AND n.image_id = whole.image_id) AS nodes FROM whole GROUP BY image_id", True))
def border_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.chain_stats(O.ring_points(region_pixels(spark, sf_dir)))
    return found.filter("nodes > 0").select("image_id", (F.col("chains") - F.col("closed_chains")).alias("open_chains"), (F.col("refs") - F.col("closed_refs")).alias("open_refs"), "nodes")


def customer_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares in a row, one a customer; every third ring crosses itself, and every seventh of the others reaches over the next one."""
    key = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(key / 10).alias("image_id"), (key % 10).alias("region_id"), (key % 3 == 1).alias("crossed"), ((key % 7 == 2) & (key % 3 != 1)).alias("wide"))
    left = (F.col("region_id") * 4).cast("int")
    right = left + F.when(F.col("wide"), 5).otherwise(2)
    at = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    square, bow = F.array(at(left, 0), at(right, 0), at(right, 2), at(left, 2)), F.array(at(left, 0), at(right, 2), at(right, 0), at(left, 2))
    points = F.when(F.col("crossed"), bow).otherwise(square)
    return rows.select("image_id", "region_id", points.alias("points"), F.array().cast("array<array<struct<x:int,y:int>>>").alias("hole_rings"))


_SQUARES = "s AS (SELECT c_custkey // 10 AS image_id, c_custkey % 10 AS region_id, c_custkey % 3 = 1 AS crossed, c_custkey % 7 = 2 AND c_custkey % 3 <> 1 AS wide FROM customer)"


@query("invalid_outlines", with_sql([_SQUARES], "SELECT image_id, region_id FROM s WHERE crossed OR (wide AND EXISTS (SELECT 1 FROM s n WHERE n.image_id = s.image_id AND n.region_id = s.region_id + 1)) OR EXISTS (SELECT 1 FROM s p WHERE p.image_id = s.image_id AND p.region_id = s.region_id - 1 AND p.wide AND NOT s.crossed)"))
def invalid_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.validate_outlines(customer_squares(spark, sf_dir))


@query("overlapping_outlines", with_sql([_SQUARES], "SELECT s.image_id, s.region_id AS first_id, n.region_id AS second_id FROM s JOIN s n ON s.wide AND n.image_id = s.image_id AND n.region_id = s.region_id + 1"))
def overlapping_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.overlapping_pairs(customer_squares(spark, sf_dir))


@query("invalid_simplified_outlines")
def invalid_simplified_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.validate_outlines(O.trace_outlines(merged(spark, sf_dir), tolerance=1.0))


_INNER = """inn AS (SELECT image_id, region_id, x, y, (SELECT count(*) FROM reg b WHERE b.image_id = a.image_id AND b.region_id = a.region_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1) AS n FROM reg a)"""


@query("region_geometry", with_sql([*REGIONS, _INNER], "SELECT image_id, region_id, count(*) AS pixels, count(*) FILTER (WHERE n < 9) AS boundary_pixels, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y FROM inn GROUP BY image_id, region_id", True))
def region_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.region_geometry(region_pixels(spark, sf_dir))


# In SQL each inner pixel is compared with every boundary pixel of its region.
@query("region_labels", with_sql([*REGIONS, _INNER], """SELECT image_id, region_id, (arg_min(idx, k) + 1)::VARCHAR AS text, arg_min(x, k)::DOUBLE AS x, arg_min(y, k)::DOUBLE AS y, arg_min(d2, k) AS squared_distance FROM (
  SELECT i.image_id, i.region_id, i.x, i.y, g.idx, i.d2, row(-i.d2, (g.n * i.x - g.sx) ** 2 + (g.n * i.y - g.sy) ** 2, i.y, i.x) AS k FROM (
    SELECT a.image_id, a.region_id, a.x, a.y, CASE WHEN a.n < 9 THEN 0 ELSE (SELECT min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) FROM inn b WHERE b.image_id = a.image_id AND b.region_id = a.region_id AND b.n < 9) END AS d2 FROM inn a) i
  JOIN (SELECT image_id, region_id, min(idx) AS idx, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM reg GROUP BY ALL) g ON g.image_id = i.image_id AND g.region_id = i.region_id) GROUP BY image_id, region_id""", True))
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.place_labels(region_pixels(spark, sf_dir), nation_palette(spark, sf_dir))
