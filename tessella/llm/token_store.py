"""Content-addressed store of token ids: chunks, recipes and Merkle manifests as Parquet tables.

Layout below the store's folder:

* ``objects/kind=chunk``: each distinct chunk once: ``key`` (128-bit BLAKE2b of the ids), ``n``, ``ids``
  (little-endian, ``width`` bytes an id), dealt by digest;
* ``recipes``: one row a document in ascending ``(doc_id, root)`` order over files in name order:
  ``n_tokens``, ``start``, ``chunks`` (digests in a row), ``sizes`` (big-endian), ``root`` (Merkle root of the digests);
* ``manifest``: one row for each range of ``BLOCK_TOKENS`` ids in each recipe file: the file's name, first and
  last place and doc_id, its documents and tokens, and the Merkle root over all that its recipes say.

A rolling hash over ``WINDOW`` ids cuts the stream where its high bits are zero, so equal passages give
equal chunks wherever they stand. Encoding emits recipes and, once a task, each chunk; one shuffle by
digest keeps one copy of each chunk. A hot chunk thus reaches the shuffle once a task, not once a row.

Reading back makes the manifest again from the recipes that are there and compares the two row by row, so
a recipe, a file or a value that is lost or changed fails the job; so does a chunk that is missing, has
other bytes than its digest says, or another length than a recipe says.

Cases: null and empty texts hold the end id only; repeated rows get a recipe each and share their
chunks; rows of equal doc_id stay apart, ordered by root; an empty table gives an empty store; extra
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import HOT_SHARE, column_blocks, materialize, new_path, running_total
from tessella.llm.word_tokens import word_encoder

#: Ids that the rolling hash sees.
WINDOW = 8
#: Mean distance of cuts, a power of two; least and greatest length of a chunk.
MEAN_IDS, LEAST_IDS, MOST_IDS = 512, 128, 4096
#: Chunks that a task remembers to have sent.
SENT = 500_000
#: Bytes of text encoded at once: in larger blocks fewer words are met again, and a task holds some ten times as much.
BLOCK_BYTES = 8 << 20
#: Ids whose documents are one row of the manifest; no group of it has more recipes.
BLOCK_TOKENS = 1 << 22


def marked_places(ids: np.ndarray) -> np.ndarray:
    """Places behind ``WINDOW`` ids whose rolling hash allows a cut there, over a stream of any number of documents."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    rolling = np.zeros(len(ids) - WINDOW + 1, np.uint64)
    for i in range(WINDOW):  # a polynomial over the last WINDOW ids, wrapping at 2^64
        rolling *= np.uint64(0x100000001B3)
        rolling += mixed[i : len(ids) - WINDOW + 1 + i]
    return np.flatnonzero(rolling >> np.uint64(64 - (MEAN_IDS.bit_length() - 1)) == 0) + WINDOW


def cut_points(n: int, marks: list[int]) -> list[int]:
    """Ends of the content-defined chunks of ``n`` ids with these ascending marks."""
    ends, last = [], 0
    for mark in marks:
        while mark - last > MOST_IDS:
            last += MOST_IDS
            ends.append(last)
        if mark - last >= LEAST_IDS and mark < n:
            ends.append(mark)
            last = mark
    while n - last > MOST_IDS:
        last += MOST_IDS
        ends.append(last)
    return [*ends, n]


def stream_cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document of a stream, from the document's start."""
    marks, starts = marked_places(ids), ends - np.diff(ends, prepend=0)
    low, high = np.searchsorted(marks, starts + WINDOW).tolist(), np.searchsorted(marks, ends, "right").tolist()
    return [[n] if n <= LEAST_IDS else cut_points(n, (marks[a:b] - start).tolist()) for n, start, a, b in zip((ends - starts).tolist(), starts.tolist(), low, high)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last node moves up; leaves and nodes differ by a prefix."""
    level = [digest(b"\0" + leaf) for leaf in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


OBJECTS = "kind string, key binary, n bigint, ids binary, doc_id bigint, sizes binary, root binary, width int"


def _objects(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Recipes and chunks of ``docs``, each chunk once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        width = encoder.dtype.itemsize
        sent: set[bytes] = set()
        for batch in batches:
            doc_ids, rids = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
            for a, b in column_blocks(batch.column("text"), BLOCK_BYTES):
                ids, ends = encoder.encode(batch.column("text").slice(a, b - a))
                ids, ends = np.insert(ids, ends, encoder.dtype.type(end_id)), ends + np.arange(1, len(ends) + 1)
                data, rows, start = ids.tobytes(), [], 0
                for i, (end, cuts) in enumerate(zip(ends.tolist(), stream_cuts(ids, ends))):
                    at, keys, sizes = 0, [], []
                    for cut in cuts:
                        chunk = data[(start + at) * width : (start + cut) * width]
                        keys.append(key := digest(chunk))
                        sizes.append(cut - at)
                        if key not in sent:
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(key)
                            rows.append(("chunk", key, cut - at, chunk, None, None, None, width))
                        at = cut
                    # a recipe's key only has to be its own: the row number behind a byte that no digest has at this length
                    rows.append(("recipe", b"r" + rids[a + i].to_bytes(8, "big"), end - start, b"".join(keys), doc_ids[a + i], struct.pack(f">{len(sizes)}I", *sizes), merkle_root(keys), width))
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")).mapInArrow(run, OBJECTS)


NAMES = ["kind", "key", "n", "ids", "doc_id", "sizes", "root", "width"]
TYPES = [pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32()]


def write_store(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None) -> str:
    """Writes the store of ``docs(doc_id, text)`` and returns its folder."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-store")
    one = Window.partitionBy("key").orderBy("n")
    kept = _objects(docs, path, end_id).withColumn("__rank", F.row_number().over(one)).filter("__rank = 1").drop("__rank")
    kept.write.partitionBy("kind").option("compression", "snappy").parquet(f"{folder}/objects")
    recipes = _read(spark, folder, "recipe").select("doc_id", F.col("n").alias("n_tokens"), F.col("ids").alias("chunks"), "sizes", "root", "width", "key")
    ordered = running_total(recipes, ["doc_id", "root", "key"], "n_tokens", "start", "store-order").drop("key")
    ordered = ordered.repartitionByRange("start").sortWithinPartitions("start")
    ordered.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _manifest(spark, folder).write.parquet(f"{folder}/manifest")
    return folder


def _read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(OBJECTS).parquet(f"{folder}/objects").filter(F.col("kind") == kind)


RECIPES = "doc_id bigint, n_tokens bigint, chunks binary, sizes binary, root binary, width int, start bigint"


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{folder}/recipes")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest's rows from the recipes as they are read."""
    said = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "start", "n_tokens", "width", F.hex("sizes"), F.hex("root"))
    rows = read_recipes(spark, folder).select("doc_id", "n_tokens", "start", F.unhex(F.md5(said.cast("binary"))).alias("leaf"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    rows = rows.withColumn("block", F.expr(f"start div {BLOCK_TOKENS}"))
    ends = [F.min("start").alias("first"), F.max("start").alias("last"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")]
    leaves = F.transform(F.sort_array(F.collect_list(F.struct("start", "leaf"))), lambda x: x["leaf"])
    lists = rows.groupBy("file", "block").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), *ends, leaves.alias("leaves"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = pa.array([merkle_root(x) for x in batch.column("leaves").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in MANIFEST[:-1]), roots], MANIFEST)

    return lists.mapInArrow(run, MANIFEST_SCHEMA)


MANIFEST = ["file", "block", "documents", "tokens", "first", "last", "first_id", "last_id", "root"]
MANIFEST_SCHEMA = "file string, " + ", ".join(f"{c} bigint" for c in MANIFEST[1:-1]) + ", root binary"


def check_manifest(spark: SparkSession, folder: str) -> None:
    """Fails unless the recipes that are there say exactly what the manifest says."""
    stored = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")
    both = _manifest(spark, folder).withColumn("__n", F.lit(1)).unionByName(stored.withColumn("__n", F.lit(-1)))
    wrong = both.groupBy(*MANIFEST).agg(F.sum("__n").alias("__n")).filter("__n <> 0").head(1)
    if wrong:
        raise ValueError(f"recipes and manifest differ: file {wrong[0]['file']}, block {wrong[0]['block']}")


def _times_x(v: np.ndarray) -> np.ndarray:
    """A bit-reversed polynomial over GF(2) times x, modulo the crc32 polynomial."""
    return (v >> 1) ^ np.where(v & 1, np.uint32(0xEDB88320), np.uint32(0)).astype(np.uint32)


def _byte_tables(by: int) -> np.ndarray:
    """For multiplication by the fixed polynomial ``by``: the product of each byte value at each of four places."""
    powers = np.zeros(32, np.uint32)  # by * x^k; bit 31 - k of an operand stands for x^k
    v = np.array([by], np.uint32)
    for k in range(32):
        powers[31 - k] = v[0]
        v = _times_x(v)
    values = np.arange(256)
    out = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            out[place] ^= np.where(values >> bit & 1, powers[8 * place + bit], 0).astype(np.uint32)
    return out


def _product(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tables[0][v & 255] ^ tables[1][v >> 8 & 255] ^ tables[2][v >> 16 & 255] ^ tables[3][v >> 24]


@functools.lru_cache(maxsize=1)
def _shifts() -> list[np.ndarray]:
    """Multiplication by x^(8 * 2^k) for k from 0 to 47."""
    v = np.array([1 << 31], np.uint32)
    for _ in range(8):
        v = _times_x(v)
    out = []
    for _ in range(48):
        out.append(_byte_tables(int(v[0])))
        v = _product(out[-1], v)
    return out


def crc32_shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What the crc32 of a part adds (by exclusive or) to that of the whole when ``after`` bytes follow it."""
    crc, after = crc.astype(np.uint32), after.astype(np.int64)
    for k, tables in enumerate(_shifts()):
        hit = np.flatnonzero(after >> k & 1)
        if len(hit):
            crc[hit] = _product(tables, crc[hit])
    return crc


def _uses(recipes: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, at, key, size, after)``: the chunks of each document in order; ``after``: ids behind the chunk."""
    parts = "transform(sequence(0, length(chunks) div 16 - 1), i -> struct(i as at, substring(chunks, i * 16 + 1, 16) as key, cast(conv(hex(substring(sizes, i * 4 + 1, 4)), 16, 10) as bigint) as size))"
    rows = recipes.select("doc_id", "start", "n_tokens", F.explode(F.expr(parts)).alias("p")).select("doc_id", "start", "n_tokens", "p.*")
    upto = Window.partitionBy("start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("after", F.col("n_tokens") - F.sum("size").over(upto))


def _with_chunks(uses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Joins each use to its chunk; the chunks used most, a bounded number, go to the uses by broadcast."""
    counts = uses.groupBy("key").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.filter(F.col("count") > max(1000, int(total * HOT_SHARE))).select("key")
    hot_chunks = chunks.join(F.broadcast(hot), "key", "left_semi")
    at_hand = uses.join(F.broadcast(hot_chunks), "key")
    rest = uses.join(F.broadcast(hot), "key", "left_anti").join(chunks, "key", "left")
    return at_hand.unionByName(rest)


def _checked_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """The recipes, each checked against its Merkle root and its sizes, all against the manifest."""
    check_manifest(spark, folder)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, sizes, n, root in zip(*(batch.column(c).to_pylist() for c in ("chunks", "sizes", "n_tokens", "root"))):
                if merkle_root([data[i : i + 16] for i in range(0, len(data), 16)]) != root or 4 * len(data) != 16 * len(sizes) or sum(struct.unpack(f">{len(sizes) // 4}I", sizes)) != n:
                    raise ValueError("a recipe does not match its root")
            yield batch

    return read_recipes(spark, folder).mapInArrow(check, RECIPES)


def verify_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Reads the whole store back: ``(doc_id, start, n_tokens, ids_crc32)`` of every document.

    Recipes are held against the manifest, every stored chunk is read and checked against its digest where
    it lies, and every use of a chunk against its length; what is damaged or missing fails the job. The
    crc32 of a document (ids as little-endian unsigned 32-bit) is the exclusive or of its chunks' shifted
    crc32, so only digests and checksums are shuffled, never the ids.
    """

    def check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for key, ids, n, width in zip(*(batch.column(c).to_pylist() for c in ("key", "ids", "n", "width"))):
                if digest(ids) != key or len(ids) != n * width:
                    raise ValueError("a stored chunk is damaged")
                crc.append(zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(crc, pa.int64())], ["key", "n", "crc"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("crc").null_count:
                raise ValueError("a stored chunk is missing")
            if not batch.column("n").equals(batch.column("size")):
                raise ValueError("a recipe gives another length than its chunk has")
            moved = crc32_shift(batch.column("crc").to_numpy(), 4 * batch.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(moved.astype(np.int64))], ["doc_id", "start", "n_tokens", "part"])

    chunks = _read(spark, folder, "chunk").select("key", "ids", "n", "width").mapInArrow(check_chunks, "key binary, n bigint, crc bigint")
    found = _with_chunks(materialize(_uses(_checked_recipes(spark, folder)), "store-uses"), materialize(chunks, "store-crc"))
    parts = found.select("doc_id", "start", "n_tokens", "after", "size", "n", "crc").mapInArrow(shift, "doc_id bigint, start bigint, n_tokens bigint, part bigint")
    return parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Rebuilds every document from its recipe and the stored chunks: ``(doc_id, start, n_tokens, ids)``.

    Recipes are held against the manifest, each chunk against its digest and its length, and each document
    against its Merkle root; a mismatch or a missing chunk fails the job. Ids are little-endian unsigned 32-bit.
    """
    recipes = materialize(_checked_recipes(spark, folder), "store-recipes")
    found = _with_chunks(materialize(_uses(recipes), "store-uses"), _read(spark, folder, "chunk").select("key", "ids"))
    parts = found.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("at", "key", "size", "ids"))).alias("parts"))
    joined = recipes.select("doc_id", "start", "n_tokens", "root", "width").join(parts, "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts, root, width, n in zip(*(batch.column(c).to_pylist() for c in ("parts", "root", "width", "n_tokens"))):
                if any(p["ids"] is None or digest(p["ids"]) != p["key"] or len(p["ids"]) != width * p["size"] for p in parts):
                    raise ValueError("a stored chunk is missing or damaged")
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), f"<u{width}")
                if merkle_root([p["key"] for p in parts]) != root or len(ids) != n:
                    raise ValueError("a recipe does not match its root")
                out.append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return joined.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
