"""Hard negatives by radix selection over integer scores.

Vectors and anchors are packed into blocks; a pass sends every block of anchors with its open searches
to every block of vectors. A search asks for the first ``k`` rows of a window of scores, higher scores
first, ties by smaller vec_id. Its rows are counted by the next digit of ``highest - score``; the counts
of all blocks are added, the digit that holds the kth row becomes the search's bucket, and the next pass
counts that bucket by its next digit. Scores that tie are told apart by the digits of vec_id. A search
is closed when its bucket holds few rows; a last pass gathers the rows up to it, a few a search, and only
they are ordered. Joins whose tables grow with the vectors or anchors are sorted, not broadcast: Spark takes
a stored table for as small as its compressed file. A block reports no digit beyond its own kth row, which the digit sought can't pass; so
a block sends at most ``k`` counts a search and pass. Searches are a table as everything else: nothing but
bounds of scores and ids, and whether a search is open, comes to the driver.

The positives of an anchor are one search; its negatives one for each different score of its positives.

Cases: rows without an id, a label or a vector, with an empty one, or with a null or non-finite component
take no part; so do those with a scaled component of 2^26 and more, whose products no long can sum. Vectors
of unlike length are never compared. Repeated ids and rows are rows of their own: an anchor's own row is
never its positive, another row of its id can be; each anchor row has its rows in the result, as has each
of its positives. Fewer rows than asked for: all of them; no positive or no negative: no row. An
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import join_skewed, materialize
from tessella.llm.vectors import floored, usable

#: Vectors of a block, about, while there are no more than ``BLOCKS`` blocks; then blocks grow up to ``LARGE_BLOCK``.
BLOCK, BLOCKS, LARGE_BLOCK = 4096, 64, 16384
#: Anchors of a block, about, and those whose scores are in memory at once.
ANCHORS, SCORED = 2048, 256
#: Bits of a digit.
DIGIT = 12
#: Rows that a closed bucket may hold beyond those wanted.
SPARE = 24
#: Scaled components stay below this.
LARGEST = 1 << 26

#: A search: an anchor's row, whether its label is sought, the scores from ``hi`` down to ``lo``, and the rows
#: still wanted of the bucket ``[base, base + 2^shift)`` of ``hi - score``. ``id_shift`` is -1 until scores tie.
_SEARCH = ["anchor", "same", "hi", "lo", "wanted", "base", "shift", "id_base", "id_shift", "open"]
_COUNTS = "anchor bigint, same boolean, hi bigint, digit bigint, n bigint"
_FOUND = "anchor bigint, same boolean, hi bigint, score bigint, vec_id bigint, n bigint"


def _block_rows(rows: DataFrame, size: int, most: int) -> DataFrame:
    """``rows(rid, vec_id, label, dim, vector)`` by dim and block, numbered from 0: about ``size`` rows a block, up to ``most`` where they are many."""
    blocks = F.least(F.ceil(F.count("*") / size), F.greatest(F.ceil(F.count("*") / most), F.lit(BLOCKS))).cast("int")
    sizes = materialize(rows.groupBy("dim").agg(F.count("*").alias("many"), blocks.alias("blocks")), "negatives-sizes")
    dealt = join_skewed(rows, sizes, "dim", "many").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    members = F.collect_list(F.struct("rid", "vec_id", "label", "vector"))
    return dealt.groupBy("dim", "blocks", "block").agg(members.alias("m")).select("dim", "blocks", "block", *(F.col(f"m.{c}").alias(f"{c}s") for c in ("rid", "vec_id", "label", "vector")))


def _matrix(vectors: pa.ListScalar, dim: int, exact: type) -> np.ndarray:
    return vectors.values.flatten().to_numpy(zero_copy_only=False).astype(exact).reshape(-1, dim)


def _least(s: dict) -> int:
    """The least score that can count for a search: that of its window or its bucket's last."""
    return max(s["lo"], s["hi"] + 1 - s["base"] - (1 << s["shift"]))


def _searches(batches: Iterator[pa.RecordBatch], exact: type, least_id: int):
    """For each pair of blocks and search of it: the search, and its rows' scores and ids down to its bucket's end, in any order."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            dim = row["dim"].as_py()
            rids, ids = row["rids"].values.to_numpy(), row["vec_ids"].values.to_numpy()
            own = row["labels"].values.dictionary_encode()
            labels = own.indices.to_numpy()
            anchors = row["a_rids"].values.to_numpy()
            sought = pc.fill_null(pc.index_in(row["a_labels"].values, own.dictionary), -1).to_pylist()
            sent, own_vectors = _matrix(row["a_vectors"], dim, exact), _matrix(row["vectors"], dim, exact).T
            place, first = {a: k for k, a in enumerate(anchors.tolist())}, -SCORED
            by_anchor: dict[tuple[int, bool], list[dict]] = {}
            for s in row["searches"].values.to_pylist():
                by_anchor.setdefault((place[s["anchor"]], s["same"]), []).append(s)
            sides: dict[tuple[int, bool], np.ndarray] = {}
            for k, same in sorted(by_anchor):
                wanted = by_anchor[k, same]
                if k >= first + SCORED:
                    first = k
                    scores = sent[first : first + SCORED] @ own_vectors
                side = sought[k], same
                if side not in sides:
                    sides[side] = np.flatnonzero((labels == side[0]) == same)
                at, score = sides[side], scores[k - first]
                score = score[at]
                near = np.flatnonzero((score >= min(map(_least, wanted))) & (score <= max(s["hi"] for s in wanted)))
                at, score = at[near], score[near].astype(np.int64)
                if same:
                    others = rids[at] != anchors[k]
                    at, score = at[others], score[others]
                for s in wanted:
                    fits = (score <= s["hi"]) & (score >= _least(s))
                    yield s, s["hi"] - score[fits], ids[at[fits]] - least_id


def _count(exact: type, least_id: int):
    """The next digit's counts of every open search, up to the block's own last wanted row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for s, depth, ids in _searches(batches, exact, least_id):
            if s["id_shift"] >= 0:
                value, base, shift = ids[depth == s["base"]], s["id_base"], s["id_shift"]
            else:
                value, base, shift = depth, s["base"], s["shift"]
            value = value[(value >= base) & ((value - base) >> shift == 0)]
            digits = (value - base) >> max(0, shift - DIGIT)
            if len(digits) > s["wanted"]:
                digits = digits[digits <= np.partition(digits, s["wanted"] - 1)[s["wanted"] - 1]]
            out += ((s["anchor"], s["same"], s["hi"], int(d), int(n)) for d, n in zip(*np.unique(digits, return_counts=True)))
            if len(out) > 50_000:
                yield _batch(out, _COUNTS)
                out = []
        yield _batch(out, _COUNTS)

    return run


def _gather(exact: type, least_id: int):
    """The rows of every search up to the end of its bucket; ``n`` counts rows of one score and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for s, depth, ids in _searches(batches, exact, least_id):
            within = (depth >= s["base"]) & ((depth - s["base"]) >> s["shift"] == 0)
            if s["id_shift"] >= 0:
                within &= (ids < s["id_base"]) | ((ids - s["id_base"]) >> s["id_shift"] == 0)
            at = np.flatnonzero((depth < s["base"]) | within)
            found, n = np.unique(np.stack([depth[at], ids[at]], axis=1), axis=0, return_counts=True)
            out += ((s["anchor"], s["same"], s["hi"], s["hi"] - int(d), int(v) + least_id, int(c)) for (d, v), c in zip(found, n))
            if len(out) > 50_000:
                yield _batch(out, _FOUND)
                out = []
        yield _batch(out, _FOUND)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_()}
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _meet(searches: DataFrame, anchors: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every block of anchors that has searches with every block of vectors of its length."""
    own = searches.select("anchor", *(c for c in _SEARCH if c != "anchor"), "dim", "a_block")
    packed = own.groupBy("dim", "a_block").agg(F.collect_list(F.struct(*_SEARCH)).alias("searches"))
    sent = anchors.join(packed.hint("merge"), ["dim", "a_block"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)))
    # the right side of a merge join is held a key at a time: one block of vectors
    return sent.join(vectors.hint("merge"), ["dim", "block"]).select("dim", "rids", "vec_ids", "labels", "vectors", "a_rids", "a_labels", "a_vectors", "searches")


def _select(searches: DataFrame, anchors: DataFrame, vectors: DataFrame, exact: type, ids: tuple[int, int], name: str) -> DataFrame:
    """``(anchor, same, hi, score, vec_id, n)``: the first wanted rows of each search, and few beyond them."""
    key = ["anchor", "same", "hi"]
    id_bits = int(ids[1] - ids[0]).bit_length()
    open_ = materialize(searches, f"{name}-searches")
    done = []
    while True:
        done.append(open_.filter("not open"))
        todo = open_.filter("open")
        if not todo.head(1):
            break
        counts = _meet(todo, anchors, vectors).mapInArrow(_count(exact, ids[0]), _COUNTS).groupBy(*key, "digit").agg(F.sum("n").alias("n"))
        # at most 2^DIGIT digits a search
        running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("digit")))
        met = running.join(todo.select(*key, "wanted").hint("merge"), key).filter("upto >= wanted").groupBy(*key).agg(F.min_by(F.struct("digit", "n", (F.col("upto") - F.col("n")).alias("before")), "digit").alias("at"))
        open_ = materialize(_narrowed(todo.join(met.hint("merge"), key, "left"), id_bits), f"{name}-searches")
    closed = done[0]
    for part in done[1:]:
        closed = closed.unionByName(part)
    return _meet(closed, anchors, vectors).mapInArrow(_gather(exact, ids[0]), _FOUND).groupBy(*key, "score", "vec_id").agg(F.sum("n").alias("n"))


def _narrowed(rows: DataFrame, id_bits: int) -> DataFrame:
    """Searches with their next bucket. A search with fewer rows than wanted (``at`` is null) takes all that its bucket holds."""
    by_id = F.col("id_shift") >= 0
    less = lambda c: F.greatest(F.lit(0), F.col(c) - DIGIT).cast("int")
    step = lambda c: F.call_function("shiftleft", F.col("at.digit"), less(c))
    moved = rows.select(
        *(c for c in rows.columns if c not in ("base", "shift", "id_base", "id_shift", "wanted", "open")),
        F.when(by_id, F.col("base")).otherwise(F.col("base") + step("shift")).alias("base"),
        F.when(by_id, F.col("shift")).otherwise(less("shift")).alias("shift"),
        F.when(by_id, F.col("id_base") + step("id_shift")).otherwise(F.col("id_base")).alias("id_base"),
        F.when(by_id, less("id_shift")).otherwise(F.col("id_shift")).alias("id_shift"),
        (F.col("wanted") - F.col("at.before")).alias("wanted"),
    ).withColumn("many", F.col("at.n") > F.col("wanted") + SPARE)
    ties = F.col("many") & (F.col("shift") == 0) & (F.col("id_shift") < 0)
    found = moved.withColumn("id_shift", F.when(ties, id_bits).otherwise(F.col("id_shift")).cast("int"))
    found = found.withColumn("open", F.col("many") & ((F.col("shift") > 0) | (F.col("id_shift") > 0))).drop("many", "at")
    kept = [c for c in rows.columns if c != "at"]
    short = rows.filter("at is null").withColumn("open", F.lit(False)).select(*kept)
    return found.filter("wanted is not null").select(*kept).unionByName(short)


def _opened(rows: DataFrame) -> DataFrame:
    """Searches over all of their scores."""
    bits = F.length(F.bin(F.col("hi") - F.col("lo"))).cast("int")
    return rows.select(*rows.columns, F.lit(0).cast("long").alias("base"), bits.alias("shift"), F.lit(0).cast("long").alias("id_base"), F.lit(-1).alias("id_shift"), F.lit(True).alias("open"))


def _ranked(found: DataFrame, wanted: int) -> DataFrame:
    """The first rows of each search in order, one row for each of several equal ones; ``found`` holds few a search."""
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(wanted).cast("long")))))
    order = Window.partitionBy("anchor", "same", "hi").orderBy(F.col("score").desc(), "vec_id", "copy")
    return copies.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``vectors(vec_id, label, embedding)``.

    An anchor's positives are its first rows of its label, a positive's negatives the first rows of other
    labels whose score is ``low`` to ``high`` percent of the positive's.
    """
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"), LARGEST / scale)
    kept = vectors.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), is_anchor.alias("is_anchor"), F.size("embedding").alias("dim"), floored(F.col("embedding"), scale).cast("array<int>").alias("vector"))
    rows = materialize(kept.withColumn("rid", F.monotonically_increasing_id()), "negatives-rows")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    least, most, largest = rows.agg(F.min("vec_id"), F.max("vec_id"), F.max(norm)).first()
    if least is None:
        least, most, largest = 0, 0, 0.0
    if largest >= 2**62:
        raise ArithmeticError("scores do not fit a long")
    exact = np.float32 if largest < 2**24 else np.float64 if largest < 2**52 else np.int64  # sums of products are exact whole numbers in each
    top = int(largest * (1 + 1e-9)) + 2  # no product is beyond the largest square
    blocks = materialize(_block_rows(rows.drop("is_anchor"), BLOCK, LARGE_BLOCK), "negatives-vectors")
    counts = blocks.groupBy("dim").agg(F.max("blocks").alias("v_blocks"))
    anchors = _block_rows(rows.filter("is_anchor").drop("is_anchor"), ANCHORS, ANCHORS).join(F.broadcast(counts), "dim")
    anchors = materialize(anchors.select("dim", F.col("block").alias("a_block"), "v_blocks", *(F.col(c).alias(f"a_{c}") for c in ("rids", "vec_ids", "labels", "vectors"))), "negatives-anchors")
    places = anchors.select("dim", "a_block", F.explode(F.arrays_zip("a_rids", "a_vec_ids")).alias("a")).select("dim", "a_block", F.col("a.a_rids").alias("anchor"), F.col("a.a_vec_ids").alias("anchor_id"))
    first = places.select("dim", "a_block", "anchor", F.lit(True).alias("same"), F.lit(top).cast("long").alias("hi"), F.lit(-top).cast("long").alias("lo"), F.lit(positives).cast("long").alias("wanted"))
    near = _ranked(_select(_opened(first), anchors, blocks, exact, (least, most), "positives"), positives)
    near = materialize(near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score")), "negatives-positives")
    # floor and ceiling of whole numbers, whatever their signs
    over, under = F.expr(f"(positive_score * {high} - pmod(positive_score * {high}, 100L)) div 100"), F.expr(f"(positive_score * {low} + pmod(-positive_score * {low}, 100L)) div 100")
    windows = near.select("anchor", over.alias("hi"), under.alias("lo")).distinct().filter("hi >= lo").join(places.hint("merge"), "anchor")
    second = windows.select("dim", "a_block", "anchor", F.lit(False).alias("same"), "hi", "lo", F.lit(negatives).cast("long").alias("wanted"))
    far = _ranked(_select(_opened(second), anchors, blocks, exact, (least, most), "negatives"), negatives)
    chosen = near.withColumn("hi", over).join(far.select("anchor", "hi", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).hint("merge"), ["anchor", "hi"])
    return chosen.join(places.select("anchor", "anchor_id").hint("merge"), "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""
