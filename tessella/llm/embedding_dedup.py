"""Near-duplicate vectors by cosine, with int8 tile products and rigorous error bounds.

Equal vectors of one label are one class. The classes of a label are dealt into blocks, every pair
of blocks meets once, and a task quantises both sides to int8: with ``u = s q + e`` for a unit vector
``u``, its scale ``s`` and its own error norm ``|e|``, the product ``s1 s2 (q1 . q2)`` is off by at most
``|e1| + |e2| + |e1| |e2|``. Pairs below the threshold by more than that are settled by the integer
product alone; only the others are recomputed in double precision from the stored components. A tile
returns link counts and a spanning set of links, never its pairs.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, rows without a label
and rows without a vec_id link with nothing: zero links, a component of their own, kept. Vectors of
unlike length never link. Repeated rows count as vectors of their own that link to each other; ties
need no order, the least vec_id names a component; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_skewed, materialize
from tessella.llm.components import block_pairs, connected_components, tile_links

#: Vectors of a block; a tile compares two blocks.
BLOCK = 2048
#: Room for rounding in the double precision sums of bounds; far below any quantisation error.
SLACK = 1e-9


def _prepare(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, dim, key, vector)``; key, a 128-bit hash of the components, is null where a row links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, datas, dims = [], [], []
            lists = batch.column("embedding")
            usable = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<f8", copy=False)  # null components become nan
            offsets = lists.offsets.to_numpy()
            for i in range(len(lists)):
                v = values[offsets[i] : offsets[i + 1]]
                good = usable[i] and len(v) and np.isfinite(v).all() and v.any()
                data = (v + 0.0).tobytes() if good else None  # + 0.0: one zero only
                datas.append(data)
                keys.append(hashlib.blake2b(data, digest_size=16).digest() if good else None)
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(datas, pa.binary())], ["vec_id", "label", "dim", "key", "vector"])

    columns = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return columns.mapInArrow(run, "vec_id bigint, label string, dim int, key binary, vector binary")


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows, their scales, and the norm of what rounding left, for rows of norm one."""
    scale = np.abs(units).max(axis=1) / 127
    q = np.rint(units / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(units - scale[:, None] * q, axis=1)


def _units(data: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean tile: cosine of unit rows ``a`` and ``b`` at or above the threshold.

    Int8 products are summed as float32, which is exact while ``dim * 127^2`` stays below ``2^24``; for
    longer rows they are summed as float64.
    """
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(b)
    exact = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = np.zeros((len(a), len(b)), bool)
    columns = qb.astype(exact).T
    for at in range(0, len(a), 256):
        part = slice(at, at + 256)
        estimate = (qa[part].astype(exact) @ columns) * sa[part, None] * sb[None, :]
        bound = ea[part, None] + eb[None, :] + ea[part, None] * eb[None, :] + SLACK
        near[part] = estimate >= threshold - bound
        i, j = np.nonzero(near[part])
        for k in range(0, len(i), 1 << 14):  # only what the bound leaves open, in double precision
            x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            near[at + x, y] = np.einsum("ij,ij->i", a[at + x], b[y]) >= threshold
    return near


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, copies, data, o_nodes, o_copies, o_data in zip(*(batch.column(p + c) for p in ("", "other_") for c in ("nodes", "copies", "vectors"))):
                own = not o_nodes.is_valid
                a, a_nodes, a_copies = _units(data.as_py()), nodes.values.to_numpy(), copies.values.to_numpy()
                b, b_nodes, b_copies = (a, a_nodes, a_copies) if own else (_units(o_data.as_py()), o_nodes.values.to_numpy(), o_copies.values.to_numpy())
                near = near_pairs(a, b, threshold)
                if own:
                    np.fill_diagonal(near, False)
                ids = a_nodes if own else np.concatenate([a_nodes, b_nodes])
                counts = near @ b_copies if own else np.concatenate([near @ b_copies, near.T @ a_copies])
                hit = np.flatnonzero(counts)
                i, j = tile_links(near, own)
                rows = pa.array(np.concatenate([ids[hit], ids[i]])), pa.array(np.concatenate([counts[hit], np.zeros(len(i), np.int64)])), pa.array(np.concatenate([np.zeros(len(hit), np.int64), ids[j]]), mask=np.arange(len(hit) + len(i)) < len(hit))
                yield pa.RecordBatch.from_arrays(list(rows), ["a", "n", "b"])

    return run


def embedding_components(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``."""
    rows = materialize(_prepare(vectors), "embedding-rows")
    keys = ["label", "dim", "key"]
    grouped = rows.filter("key is not null").groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "embedding-classes")
    sizes = materialize(classes.groupBy("label", "dim").agg(F.count("*").alias("vectors")), "embedding-sizes")
    sized = join_skewed(classes.withColumn("place", F.struct("label", "dim")), sizes.select(F.struct("label", "dim").alias("place"), "vectors"), "place", "vectors")
    dealt = sized.select("label", "dim", "node", "copies", "vector", F.ceil(F.col("vectors") / block).cast("int").alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member = F.collect_list(F.struct("node", "copies", "vector"))
    blocks = dealt.groupBy("label", "dim", "blocks", "block").agg(member.alias("m")).select("label", "dim", "blocks", "block", F.col("m.node").alias("nodes"), F.col("m.copies").alias("copies"), F.col("m.vector").alias("vectors"))
    tiles = block_pairs(materialize(blocks, "embedding-blocks"), ["label", "dim"], ["nodes", "copies", "vectors"])
    found = materialize(tiles.mapInArrow(_compare(threshold), "a bigint, n bigint, b bigint"), "embedding-links")
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("linked"))
    components = connected_components(found.filter("b is not null").select("a", "b"))
    joined = classes.select(*keys, "node", "rep", "copies").join(counts, F.col("node") == F.col("a"), "left").drop("a")
    joined = joined.join(components.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    joined = materialize(joined.withColumn("component", F.coalesce("component", "node")).drop("member"), "embedding-classed")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(joined.join(least, "component").select(F.struct(*keys).alias("class"), "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "embedding-named")
    linked = join_skewed(rows.filter("key is not null").select("vec_id", F.struct(*keys).alias("class")), named, "class", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.other
)
SELECT node AS vec_id, (SELECT count(*) FROM pairs WHERE a = node) AS n_links,
       min(other) AS component_id, node = min(other) AS kept
FROM reach GROUP BY node
"""
