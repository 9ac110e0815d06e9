"""Vector codes: one codebook for each part of a vector, refined by Lloyd's rounds on bounds kept in heaps.

A chunk of vectors is one stored row with all of its state, so a round is one narrow pass that writes
the next state; only the codebooks (parts x entries x width numbers) and their sums come to the driver.
In a chunk each entry of a codebook has a heap of the parts assigned to it, keyed by slack: the lower
bound of the distance to any other entry minus the upper bound of the distance to its own. When the
entries move, a part's slack shrinks by the drift of its entry and the largest drift of the others at
most. Keys hold the entry's cumulative drift at insertion, so nothing is touched while that drift stays
below the least key: only parts whose key it has reached are popped, compared with all entries in whole
numbers, and pushed again. A heap is an ascending array, so what is popped is a prefix that a binary
search finds. Sums follow the parts that moved.

Components become ``floor(scale * x)``; distances are whole numbers, so results do not depend on chunks,
partitions or retries. Slack is in double precision and rounded down by far more than its error; ties
of two entries have no slack and are always compared again.

Cases: rows whose vector is null, empty, or holds null or non-finite components (or scaled ones of
2^27 and more, whose squares no long can sum) are dropped; so are those that can't be cut into equal
parts, or whose length is not that of the first row that can. Rows without an id keep null as theirs
and come last among the first entries; repeated ids and rows are coded each, and among equal ids the
lesser vector comes first. With fewer rows than entries a codebook has as many entries as rows. An
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_skewed, materialize, new_path, remove
from tessella.llm.vectors import floored, usable

#: Vectors of a chunk, at most.
CHUNK = 8192
#: Scaled components stay below this.
LARGEST = 1 << 27
#: What a bound is moved to be safe from rounding, relative to distances.
MARGIN = 1e-9

_STATE = "ids array<bigint>, labels array<string>, vectors binary, codes binary, keys binary, items binary, heads binary, sums array<bigint>"


@dataclass(frozen=True)
class Books:
    """The codebooks ``entries[part, entry, place]`` and each entry's cumulative drift."""

    entries: np.ndarray
    drift: np.ndarray

    def moved(self, entries: np.ndarray) -> Books:
        """The next codebooks; drift grows by an entry's own way and the longest of the others."""
        way = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + MARGIN) + MARGIN
        others = np.zeros_like(way)
        for e in range(way.shape[1]):
            others[:, e] = np.delete(way, e, axis=1).max(axis=1, initial=0)
        return Books(entries, self.drift + way + others)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower), its squared distance, and the slack, for each row of ``parts``."""
    squares = np.empty((len(parts), len(entries)), np.int64)
    for e, entry in enumerate(entries):
        away = parts - entry
        squares[:, e] = np.einsum("ij,ij->i", away, away)
    code = squares.argmin(axis=1)
    rows = np.arange(len(parts))
    best = squares[rows, code]
    squares[rows, code] = np.iinfo(np.int64).max
    if len(entries) == 1:
        return code, best, np.full(len(parts), np.inf)
    upper, lower = np.sqrt(best.astype(np.float64)), np.sqrt(squares.min(axis=1).astype(np.float64))
    return code, best, lower - upper - MARGIN * (lower + upper)


def _merged(keys: np.ndarray, items: np.ndarray, new_keys: np.ndarray, new_items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A heap with more members; both come and go in ascending order of keys."""
    order = np.argsort(new_keys, kind="stable")
    at = np.searchsorted(keys, new_keys[order])
    return np.insert(keys, at, new_keys[order]), np.insert(items, at, new_items[order])


class Chunk:
    """The state of a chunk: codes, and for each part and entry its heap and its sum."""

    def __init__(self, vectors: np.ndarray, shape: tuple[int, int, int]):
        self.vectors, (self.parts, self.entries, self.width) = vectors, shape
        self.codes = np.zeros((len(vectors), self.parts), np.uint8)
        none = np.zeros(0), np.zeros(0, np.int32)
        self.heaps = [[none] * self.entries for _ in range(self.parts)]
        self.sums = np.zeros((self.parts, self.entries, self.width + 1), np.int64)

    def part(self, p: int) -> np.ndarray:
        return self.vectors[:, p * self.width : (p + 1) * self.width]

    def start(self, books: Books) -> None:
        """Assigns every part."""
        for p in range(self.parts):
            self._push(p, np.arange(len(self.vectors), dtype=np.int32), books, first=True)

    def step(self, books: Books) -> int:
        """Assigns the parts again whose bounds drift has reached; returns how many."""
        popped = 0
        for p in range(self.parts):
            gone = []
            for e, (keys, items) in enumerate(self.heaps[p]):
                n = int(np.searchsorted(keys, books.drift[p, e], "right"))
                if n:
                    gone.append(items[:n])
                    self.heaps[p][e] = keys[n:], items[n:]
            if gone:
                self._push(p, np.concatenate(gone), books)
                popped += sum(map(len, gone))
        return popped

    def _push(self, p: int, items: np.ndarray, books: Books, first: bool = False) -> None:
        own = self.part(p)[items].astype(np.int64)
        code, _, slack = nearest(own, books.entries[p])
        before = self.codes[items, p]
        moved = np.ones(len(items), bool) if first else code != before
        weighed = np.concatenate([np.ones((len(items), 1), np.int64), own], axis=1)
        np.add.at(self.sums[p], code[moved], weighed[moved])
        if not first:
            np.subtract.at(self.sums[p], before[moved], weighed[moved])
        self.codes[items, p] = code
        keys = slack + books.drift[p, code]
        for e in np.unique(code):
            here = code == e
            self.heaps[p][e] = _merged(*self.heaps[p][e], keys[here], items[here])

    def stored(self) -> list:
        flat = [h for heaps in self.heaps for h in heaps]
        heads = np.cumsum([0, *(len(k) for k, _ in flat)]).astype(np.int64)
        keys, items = (np.concatenate([h[i] for h in flat]) for i in (0, 1))
        return [self.vectors.tobytes(), self.codes.tobytes(), keys.astype(np.float64).tobytes(), items.astype(np.int32).tobytes(), heads.tobytes(), self.sums.ravel()]

    @classmethod
    def restored(cls, row: dict, shape: tuple[int, int, int]) -> Chunk:
        parts, entries, width = shape
        chunk = cls(np.frombuffer(row["vectors"], np.int32).reshape(-1, parts * width), shape)
        chunk.codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, parts).copy()
        keys, items, heads = np.frombuffer(row["keys"]), np.frombuffer(row["items"], np.int32), np.frombuffer(row["heads"], np.int64)
        chunk.heaps = [[(keys[(at := slice(heads[i := p * entries + e], heads[i + 1]))], items[at]) for e in range(entries)] for p in range(parts)]
        chunk.sums = np.array(row["sums"], np.int64).reshape(parts, entries, width + 1)
        return chunk


def _row(ids: pa.Array, labels: pa.Array, chunk: Chunk) -> pa.RecordBatch:
    vectors, codes, keys, items, heads, sums = chunk.stored()
    lists = [pa.array([x], t) for x, t in ((ids.to_pylist(), pa.list_(pa.int64())), (labels.to_pylist(), pa.list_(pa.string())), (vectors, pa.binary()), (codes, pa.binary()), (keys, pa.binary()), (items, pa.binary()), (heads, pa.binary()), (sums, pa.list_(pa.int64())))]
    return pa.RecordBatch.from_arrays(lists, [c.split()[0] for c in _STATE.split(", ")])


def _start(books: Books, shape: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                values = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                chunk = Chunk(values.astype(np.int32).reshape(part.num_rows, -1), shape)
                chunk.start(books)
                yield _row(part.column("vec_id"), part.column("label"), chunk)

    return run


def _step(books: Books, shape: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("vectors", "codes", "keys", "items", "heads", "sums")}
                chunk = Chunk.restored(row, shape)
                chunk.step(books)
                yield _row(batch.column("ids")[i].values, batch.column("labels")[i].values, chunk)

    return run


def _codes(books: Books):
    """Codes as text, and the squared distances to the assigned entries, summed over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.entries.shape
        for batch in batches:
            for ids, labels, vectors, codes in zip(*(batch.column(c) for c in ("ids", "labels", "vectors", "codes"))):
                own = np.frombuffer(vectors.as_py(), np.int32).reshape(-1, parts, width)
                chosen = np.frombuffer(codes.as_py(), np.uint8).reshape(-1, parts)
                away = own - books.entries[np.arange(parts), chosen]
                texts = chosen.tobytes().hex()
                code = [texts[at : at + 2 * parts] for at in range(0, len(texts), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(code, pa.string()), pa.array(np.einsum("ijk,ijk->i", away, away))], ["vec_id", "label", "code", "error"])

    return run


def _means(state: DataFrame, books: Books) -> np.ndarray:
    """Each entry replaced by its parts' floored mean; unused entries stay."""
    sums = state.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    parts, entries, width = books.entries.shape
    flat = np.zeros(parts * entries * (width + 1), object)
    for row in sums:
        flat[row["at"]] = row["n"]
    total = flat.reshape(parts, entries, width + 1)
    out = books.entries.copy()
    for p, e in zip(*np.nonzero(total[:, :, 0])):
        out[p, e] = [n // total[p, e, 0] for n in total[p, e, 1:]]
    return out


def digest(entries: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, np.ndarray]:
    """Codes of ``vectors(vec_id, embedding, label)``, and the codebooks as ``[part, entry, place]``.

    The codes are ``(vec_id, label, code, error)``: two hexadecimal digits a part (256 entries at most),
    and the squared distance to what the code stands for. The table is stored in the shared folder.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    fit = usable(F.col("embedding"), LARGEST / scale) & (F.size("embedding") % parts == 0)
    kept = vectors.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), floored(F.col("embedding"), scale).alias("vector"))
    order = F.col("vec_id").asc_nulls_last(), F.col("vector")
    head = kept.orderBy(*order).limit(1).collect()
    if not head:
        return spark.createDataFrame([], "vec_id bigint, label string, code string, error bigint"), np.zeros((parts, 0, 0), np.int64)
    dim = len(head[0]["vector"])
    kept = kept.filter(F.size("vector") == dim)
    firsts = [r["vector"] for r in kept.orderBy(*order).limit(entries).collect()]  # as many rows as entries at most
    shape = parts, len(firsts), dim // parts
    books = Books(np.array(firsts, np.int64).reshape(len(firsts), parts, -1).swapaxes(0, 1).copy(), np.zeros((parts, len(firsts))))
    state, path = None, None
    for done in range(rounds + 1):
        work = kept.mapInArrow(_start(books, shape), _STATE) if state is None else state.mapInArrow(_step(books, shape), _STATE)
        before, path = path, new_path(spark, "vector-codes")
        work.write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(work.schema).parquet(path)
        if before:
            remove(spark, before)
        if done == rounds:
            break
        means = _means(state, books)
        if np.array_equal(means, books.entries):
            break  # nothing moves any more
        books = books.moved(means)
    coded = state.select("ids", "labels", "vectors", "codes").mapInArrow(_codes(books), "vec_id bigint, label string, code string, error bigint")
    result = materialize(coded, "vector-coded")
    remove(spark, path)
    return result, books.entries


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels; those without one count together."""
    labelled = coded.withColumn("key", F.struct("label"))
    sums = materialize(labelled.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return join_skewed(labelled, sums, "key", "n").drop("key", "n")


def oracle_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB SQL of the same rounds, each written out."""
    distance = "list_sum(list_transform(list_zip(a.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS w FROM kept, range({parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w FROM parts QUALIFY e < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT a.vec_id, any_value(a.label) AS label, a.p, any_value(a.w) AS w, min(({distance}) * {entries} + b.e) AS m FROM parts a JOIN book{r} b ON a.p = b.p GROUP BY a.vec_id, a.p)")
        if r < rounds:
            steps.append(f"sums{r} AS (SELECT p, m % {entries} AS e, i, sum(w[i]) AS s, count(*) AS n FROM near{r}, range(1, (SELECT max(len(w)) + 1 FROM parts)) t(i) GROUP BY ALL)")
            steps.append(f"means{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS w FROM sums{r} GROUP BY p, e)")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.w, b.w) AS w FROM book{r} b LEFT JOIN means{r} n ON b.p = n.p AND b.e = n.e)")
    return f"""
WITH {", ".join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS d FROM book{rounds}),
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', (m % {entries})::INTEGER), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, d AS codebooks_sha256 FROM coded, digest
"""
