"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are taken of all shingles of whole texts. Bits that correlate are put in one part; a
dynamic program gives each of the ``m`` parts its own threshold, with the sum that the generalised
principle asks for (``tau - m + 1``, -1 leaves a part out), so that the estimated number of
candidates and probes is least. Two fingerprints within ``tau`` bits then agree within the threshold
on some part. Every fingerprint probes the buckets of its parts (for a threshold t: the part's value
under every mask of t of its bits), buckets are cut into bounded blocks, and pairs of blocks are
verified as numpy tiles that return a spanning forest of the true links, not all pairs.

:func:`drop_similar` takes what one fingerprint cannot tell: texts whose sets of word shingles have a Jaccard
similarity of four fifths or more are linked, and no others. Candidates are pairs within ``SKETCH_TAU`` bits
on one of ``SKETCHES`` fingerprints of the words, weighted by ``1 + log(count)``, each probed by the same
principle; every candidate is then held against the exact similarity, so fingerprints decide only what is
looked at. A first round verifies the nearest candidate of each text; further ones, for each text, the
likeliest candidate of another component, by sizes and parity tables (a lower bound of the difference of two
sets); the last one every candidate pair that is then still in two components and left open by these
bounds. So no round but the last grows faster than the texts, and little is left to it. Of two texts of just that similarity nine tenths or more are candidates; more similar
ones, and those with a common near copy, are lost more rarely (a test measures it).

Cases: a null or blank text has the fingerprint zero and is linked like any other; texts of fewer
words than a shingle are one shingle; rows without a doc_id group like others, and a group of such rows
only has a null component_id; equal fingerprints are one node, so copies never meet as
pairs; an empty table gives an empty result; extra columns are not read. In :func:`drop_similar` a text
without a word is like no other, texts of the same words are one node, and other columns pass through.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import HOT_SHARE, blocks, column_blocks, free_name, join_skewed, materialize, temporary_tables
from tessella.llm.components import block_pairs, connected_components, tile_links

BITS = 64
#: Fingerprints of one block; a tile compares two blocks.
BLOCK = 2048
#: Buckets of up to so many fingerprints are compared many at a time.
SMALL = 32
#: Cost of one probe in candidates: a probe is shuffled, a candidate only compared.
PROBE_COST = 20.0
#: Fingerprints of a text's words, and the bits in which a candidate pair may differ on one of them.
SKETCHES, SKETCH_TAU = 8, 3
#: A link asks for a Jaccard similarity of ``SIMILAR[0] / SIMILAR[1]``.
SIMILAR = (4, 5)
#: Cells of a parity table, and rounds in which each text offers its likeliest candidate.
PARITY_BITS, OFFER_ROUNDS = 2048, 1


def fingerprints_of(texts: list[str | None], width: int, seed: int) -> np.ndarray:
    """The 64-bit fingerprints (uint64) of whole texts."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        if len(words) <= width:
            shingles = [joined]
        else:
            starts = [0, *ends[: len(words) - width]]
            shingles = [joined[a : b - 1] for a, b in zip(starts, ends[width - 1 :])]
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(shingles), 1 << 16):
            hashes = np.array([xxh64_intdigest(s, seed) for s in shingles[at : at + (1 << 16)]], "<u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")[0]
    return out


def fingerprint(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``; fp holds the 64 bits as a signed long. A narrow map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks([t or "" for t in texts]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(texts[a:b], width, seed).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(rows: DataFrame, many: int) -> list[tuple[int, np.ndarray]]:
    """For each of the ``many`` fingerprints in the arrays ``fps``: their number and the 64 x 64 counts of bits set together, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((many, BITS, BITS))
        for batch in batches:
            values = batch.column("fps").flatten().to_numpy().reshape(-1, many)
            total += len(values)
            for k in range(many):
                bits = _bits(values[:, k]).astype(np.float32)
                both[k] += bits.T @ bits
        counts = [x.ravel().astype(np.int64).tolist() for x in both]
        yield pa.RecordBatch.from_arrays([pa.array(range(many), pa.int32()), pa.array([total] * many), pa.array(counts, pa.list_(pa.int64()))], ["at", "n", "both"])

    cells = rows.select("fps").mapInArrow(run, "at int, n bigint, both array<bigint>").select("at", "n", F.posexplode("both").alias("cell", "count"))
    summed = cells.groupBy("at", "cell").agg(F.sum("n").alias("n"), F.sum("count").alias("count")).collect()  # always 4096 rows a fingerprint at most
    n, both = [0] * many, np.zeros((many, BITS * BITS))
    for r in summed:
        n[r["at"]], both[r["at"], r["cell"]] = r["n"], r["count"]
    return [(n[k], both[k].reshape(BITS, BITS)) for k in range(many)]


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Puts each bit, the most correlated pairs first, into the part that it correlates with most."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    room, parts, left = math.ceil(BITS / m), [], set(range(BITS))
    while left:
        part = [max(left, key=lambda b: corr[b][list(left)].sum())]
        left.discard(part[0])
        while left and len(part) < room:
            best = max(sorted(left), key=lambda b: corr[b][part].sum())
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def allocate(n: int, both: np.ndarray, parts: list[list[int]], tau: int) -> tuple[float, list[int]]:
    """The thresholds of least estimated cost, by dynamic programming over parts and what is left to give."""
    n = max(n, 1)  # an empty table must not make costly parts look free
    p = both.diagonal() / n

    def cost(part: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        near = np.zeros(t + 1)
        near[0] = 1.0
        for b in part:  # chance of j differing bits so far
            same = p[b] ** 2 + (1 - p[b]) ** 2
            near = near * same + np.concatenate([[0], near[:-1]]) * (1 - same)
        keys = math.comb(len(part), t)
        return n * keys * PROBE_COST + n * n * float(near.sum())

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        then: dict[int, tuple[float, list[int]]] = {}
        for given, (so_far, chosen) in best.items():
            for t in range(-1, min(tau, len(part)) + 1):
                c = so_far + cost(part, t)
                if given + t not in then or c < then[given + t][0]:
                    then[given + t] = (c, [*chosen, t])
        best = then
    return best[tau - len(parts) + 1]


def plan(n: int, both: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, for the number of parts that costs least."""
    choices = []
    for m in range(1, tau + 3):
        parts = correlated_parts(n, both, m)
        cost, thresholds = allocate(n, both, parts, tau)
        choices.append((cost, m, [(q, t) for q, t in zip(parts, thresholds) if t >= 0]))
    return min(choices, key=lambda c: c[:2])[2]


def _probes(rows: DataFrame, chosen: list[list[tuple[list[int], int]]], *columns: str) -> DataFrame:
    """``(key, fp, columns)``: a key for each part and each mask of t bits of each fingerprint in ``fps``; equal keys agree on the rest of the part."""
    masks = []
    for at, parts in enumerate(chosen):
        for part, t in parts:
            for off in itertools.combinations(part, t):
                value = sum(1 << b for b in part if b not in off)
                masks.append((at, value - (1 << BITS) if value >> 63 else value))
    numbered = F.array(*(F.struct(F.lit(i).alias("mask"), F.lit(at).alias("at"), F.lit(m).cast("long").alias("bits")) for i, (at, m) in enumerate(masks)))
    probes = rows.select("fps", *columns, F.explode(numbered).alias("m")).withColumn("fp", F.get("fps", F.col("m.at")))
    return probes.select(F.xxhash64(F.col("m.mask"), F.col("fp").bitwiseAND(F.col("m.bits"))).alias("key"), "fp", *columns)


def _dealt(probes: DataFrame, counts: DataFrame, by: str, block: int, sizes: tuple | None = None) -> DataFrame:
    """The probes whose key is in ``counts(key, count)``, with the block of their bucket."""
    dealt = join_skewed(probes, counts, "key", "count", sizes=sizes).withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    return dealt.withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))


def _tile(a: np.ndarray, b: np.ndarray | None, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within ``tau`` bits in one tile (``b`` None: within ``a``)."""
    columns = a if b is None else b
    near = np.empty((len(a), len(columns)), bool)
    for at in range(0, len(a), 256):
        near[at : at + 256] = np.bitwise_count(a[at : at + 256, None] ^ columns[None, :]) <= tau
    i, j = tile_links(near, b is None)
    nodes = a if b is None else np.concatenate([a, b])
    return nodes[i], nodes[j]


def _small(groups: list[np.ndarray], tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links within many small buckets, those of equal size at once."""
    by_size: dict[int, list[np.ndarray]] = {}
    for g in groups:
        by_size.setdefault(len(g), []).append(g)
    for size, same in by_size.items():
        rows = np.stack(same)
        i, j = np.triu_indices(size, 1)
        near = np.bitwise_count(rows[:, i] ^ rows[:, j]) <= tau
        k, pair = np.nonzero(near)
        yield rows[k, i[pair]], rows[k, j[pair]]


def near_links(fps: DataFrame, tau: int, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links among the distinct fingerprints ``fps(fp)`` that join all within ``tau`` bits."""
    rows = fps.select(F.array("fp").alias("fps"))
    probes = _probes(rows, [plan(n, both, tau) for n, both in bit_statistics(rows, 1)])
    counts = materialize(probes.groupBy("key").count().filter("count > 1"), "simhash-buckets")
    packed = materialize(_dealt(probes, counts, "fp", block).groupBy("key", "blocks", "block").agg(F.collect_list("fp").alias("fps")), "simhash-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, others = batch.column("fps"), batch.column("other_fps")
            flat, cut = own.flatten().to_numpy(), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
            groups = [flat[x:y] for x, y in zip(cut, cut[1:])]
            alone = others.is_null().to_numpy(zero_copy_only=False)
            small = [g for g, one in zip(groups, alone) if one and len(g) <= SMALL]
            found = list(_small(small, tau))
            for k, g in enumerate(groups):
                if not alone[k] or len(g) > SMALL:
                    found.append(_tile(g, None if alone[k] else others[k].values.to_numpy(), tau))
            links = [np.concatenate([f[side] for f in found]) if found else np.zeros(0, np.int64) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in links], ["a", "b"])

    return block_pairs(packed, ["key"], ["fps"]).mapInArrow(run, "a bigint, b bigint")


def simhash_components(docs: DataFrame, tau: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``."""
    rows = materialize(fingerprint(docs, width, seed), "simhash-rows")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "simhash-classes")
    links = materialize(near_links(classes, tau), "simhash-links")
    found = materialize(connected_components(links.select("a", "b")), "simhash-components")
    grouped = classes.join(found, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = materialize(grouped.join(least, "component").select("fp", "component_id", "copies"), "simhash-classed")
    out = join_skewed(rows, classes, "fp", "copies")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, tau: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the least of its component; one row of each component."""
    found = simhash_components(docs, tau, width, seed).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    id_, th = free_name(docs, "id"), free_name(docs, "th")
    kept = found.select(F.col("doc_id").alias(id_)).distinct()
    rows = docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    return rows.withColumn(th, _text_hash()).dropDuplicates(["doc_id", th]).drop(th)


def shingles_of(words: list[bytes], width: int) -> np.ndarray:
    """The distinct shingles of a text's words as sorted hashes (uint64); fewer words than a shingle are one."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.array([xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))], np.uint64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def parity(hashes: np.ndarray) -> bytes:
    """Whether each cell of a small table is met an odd number of times; two sets differ in as many shingles at least as their tables do in cells."""
    return np.packbits(np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1, bitorder="little").tobytes()


def sketches_of(texts: list[list[bytes]]) -> np.ndarray:
    """Fingerprints (int64, a row a text) of the weighted words of whole texts; zero for a text without a word."""
    number: dict[bytes, int] = {}
    coded = [np.unique(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), return_counts=True) for words in texts]
    size = SKETCHES * BITS // 8
    hashes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=size).digest() for w in number), np.uint8).reshape(-1, size)
    signs = np.unpackbits(hashes, axis=1).astype(np.int8) * 2 - 1
    sums = np.zeros((len(texts), SKETCHES * BITS), np.float32)
    for i, (at, counts) in enumerate(coded):
        sums[i] = (1 + np.log(counts)).astype(np.float32) @ signs[at].astype(np.float32)
    return np.packbits(sums > 0, axis=1).view("<i8")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketch_rows(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, th, node, size, parity, fps)`` of every row; ``node`` is a hash of the words. A narrow map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in column_blocks(batch.column("text")):
                part = batch.slice(a, b - a)
                words = [words_of(t) for t in part.column("text").to_pylist()]
                sets = [shingles_of(w, width) for w in words]
                nodes = np.array([int.from_bytes(hashlib.md5(b" ".join(w)).digest()[:8], "little", signed=True) for w in words], np.int64)
                fps = pa.FixedSizeListArray.from_arrays(pa.array(sketches_of(words).ravel()), SKETCHES).cast(pa.list_(pa.int64()))
                columns = [pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array([parity(s) for s in sets], pa.binary()), fps]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), *columns], ["doc_id", "th", "node", "size", "parity", "fps"])

    return docs.select("doc_id", _text_hash().alias("th"), "text").mapInArrow(run, "doc_id bigint, th bigint, node bigint, size int, parity binary, fps array<bigint>")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)), np.uint8)
    for at in range(0, len(a), 256):
        out[at : at + 256] = np.bitwise_count(a[at : at + 256, None] ^ b[None, :])
    return out


def _nearest(nodes: np.ndarray, others: np.ndarray, distance: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of the last two axes that has one: its node, the nearest candidate, and their distance."""
    at = distance.argmin(axis=-1)
    best = np.take_along_axis(distance, at[..., None], -1)[..., 0]
    hit = best <= tau
    return nodes[hit], (np.take_along_axis(others, at, -1) if others.ndim > 1 else others[at])[hit], best[hit]


def nearest_candidates(packed: DataFrame, tau: int) -> DataFrame:
    """``(a, b)``: for each node with a candidate in a block or pair of blocks ``fps, nodes``, the nearest over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, small = [], {}
            for own, other in zip(batch.column("members"), batch.column("other_members")):
                x, v = (own.values.field(k).to_numpy() for k in (0, 1))
                if other.is_valid:
                    y, w = (other.values.field(k).to_numpy() for k in (0, 1))
                    distance = _near(v, w)
                    found += [_nearest(x, y, distance, tau), _nearest(y, x, distance.T, tau)]
                elif len(x) <= SMALL:
                    small.setdefault(len(x), []).append((x, v))
                else:
                    distance = _near(v, v)
                    np.fill_diagonal(distance, 255)
                    found.append(_nearest(x, x, distance, tau))
            for size, groups in small.items():
                x, v = np.stack([g[0] for g in groups]), np.stack([g[1] for g in groups])
                distance = np.bitwise_count(v[:, :, None] ^ v[:, None, :])
                distance[:, np.arange(size), np.arange(size)] = 255
                found.append(_nearest(x, x, distance, tau))
            columns = [np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _likeliest(*columns)], ["node", "other", "distance"])

    pairs = block_pairs(packed, ["key"], ["members"]).mapInArrow(run, "node bigint, other bigint, distance bigint")
    return pairs.groupBy("node").agg(F.min(F.struct("distance", "other"))["other"].alias("other")).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))


def may_be_similar(a: tuple, b: tuple, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """With the share by which they differ at least (in millionths), the pairs of ``(nodes, components, sizes, parities, fps)`` that are near, not yet joined and left open by sizes and parities."""
    p, q = SIMILAR
    i, j = np.nonzero((_near(a[4], b[4]) <= tau) & (a[1][:, None] != b[1][None, :]) & (q * np.minimum(a[2][:, None], b[2][None, :]) >= p * np.maximum(a[2][:, None], b[2][None, :])))
    share = np.zeros(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        differ = np.bitwise_count(a[3][x] ^ b[3][y]).sum(axis=1, dtype=np.int64)
        total = a[2][x] + b[2][y]
        share[at : at + (1 << 16)] = np.where((q + p) * differ <= (q - p) * total, 1_000_000 * differ // np.maximum(total, 1), -1)
    keep = share >= 0
    return i[keep], j[keep], share[keep]


def _likeliest(nodes: np.ndarray, others: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of each node the one of least share, then of least other node."""
    order = np.lexsort((others, share, nodes))
    first = order[np.flatnonzero(np.diff(nodes[order], prepend=nodes[order[0]] - 1 if len(order) else 0))] if len(order) else order
    return nodes[first], others[first], share[first]


def open_candidates(packed: DataFrame, tau: int, every: bool) -> DataFrame:
    """``(a, b)``: every pair of :func:`may_be_similar` in the blocks, or (not ``every``) the likeliest one of each node over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(block: pa.Scalar) -> tuple:
            columns = [block.values.field(k) for k in range(5)]
            return (*(c.to_numpy().astype(np.int64) for c in columns[:3]), np.frombuffer(b"".join(columns[3].to_pylist()), "<u8").reshape(-1, PARITY_BITS // 64), columns[4].to_numpy())

        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 3]
            for own, other in zip(batch.column("members"), batch.column("other_members")):
                a = unpack(own)
                b = unpack(other) if other.is_valid else a
                i, j, share = may_be_similar(a, b, tau)
                x, y = a[0][i], b[0][j]
                if every:
                    found.append((np.maximum(x, y), np.minimum(x, y), share))
                else:
                    found.append(_likeliest(np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([share, share])))
            x, y, share = (np.concatenate(c) for c in zip(*found))
            if not every:
                x, y, share = _likeliest(x, y, share)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x, y, share)], ["a", "b", "share"])

    pairs = block_pairs(packed, ["key"], ["members"]).mapInArrow(run, "a bigint, b bigint, share bigint")
    if not every:
        pairs = pairs.groupBy("a").agg(F.min(F.struct("share", "b"))["b"].alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.select("a", "b").distinct()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles have the Jaccard similarity of a link; two empty ones don't."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and (SIMILAR[0] + SIMILAR[1]) * common >= SIMILAR[0] * (len(x) + len(y))


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(p.as_py(), "<u8"), np.frombuffer(q.as_py(), "<u8")) for p, q in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs
    for c, out in (("a", "x"), ("b", "y")):
        uses = materialize(pairs.groupBy(c).agg(F.count("*").alias("uses")), "similar-uses")
        sizes = uses.agg(F.sum("uses"), F.max("uses")).first()
        sets = uses.join(whole, F.col(c) == F.col("node")).select(c, "uses", F.col("hashes").alias(out))
        if (sizes[1] or 0) > max(1000, (sizes[0] or 0) * HOT_SHARE):  # else the sets are joined, and read, once
            sets = materialize(sets, "similar-used-sets")
        joined = join_skewed(joined, sets, c, "uses", sizes=sizes, weight=out).drop("uses")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _whole_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(node, hashes)`` of the wanted nodes, from their texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(words_of(t.as_py()), width).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "hashes"])

    texts = rows.join(wanted, "node").groupBy("node").agg(F.min("th").alias("th"))
    found = docs.select("text", _text_hash().alias("th")).join(texts, "th").select("node", "text")
    return found.mapInArrow(run, "node bigint, hashes binary").dropDuplicates(["node"])


def similar_components(docs: DataFrame, rows: DataFrame, width: int, tau: int = SKETCH_TAU, block: int = BLOCK) -> DataFrame:
    """``(node, component)`` of the nodes of ``rows`` that verified links join, for all candidates that are similar; component is the least node."""
    classes = materialize(rows.dropDuplicates(["node"]).select("node", "size", "parity", "fps"), "similar-classes")
    chosen = [plan(n, both, tau) for n, both in bit_statistics(classes, SKETCHES)]
    probes = _probes(classes, chosen, "node")
    counts = materialize(probes.groupBy("key").count().filter("count > 1"), "similar-buckets")
    members = F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("members")
    packed = materialize(_dealt(probes, counts, "node", block).groupBy("key", "blocks", "block").agg(members), "similar-blocks")
    some = materialize(nearest_candidates(packed, tau).distinct(), "similar-nearest")
    wanted = materialize(some.select(F.col("a").alias("node")).unionByName(some.select(F.col("b").alias("node"))).distinct(), "similar-nodes")
    whole = materialize(_whole_sets(docs, rows, wanted, width), "similar-sets")
    found = connected_components(_verified(some, whole))
    tried, known = some, classes.join(wanted, "node")  # only nodes with a candidate can be in another pair
    for every in [False] * OFFER_ROUNDS + [True]:
        with temporary_tables(docs.sparkSession):
            open_ = materialize(known.join(found.withColumnRenamed("component", "joined"), "node", "left").withColumn("component", F.coalesce("joined", "node")).drop("joined"), "similar-open")
            keys = _probes(open_, chosen, "component").groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("count"))
            mixed = materialize(keys.filter("low <> high").select("key", "count"), "similar-mixed")
            sizes = mixed.agg(F.sum("count"), F.max("count")).first()
            if not sizes[0]:  # no bucket holds two components
                break
            probes = _probes(open_, chosen, "node", "component", "size", "parity")
            members = F.collect_list(F.struct("node", "component", "size", "parity", "fp")).alias("members")
            packed = _dealt(probes, mixed, "node", max(2, block // 4), sizes).groupBy("key", "blocks", "block").agg(members)
            rest = materialize(open_candidates(materialize(packed, "similar-rest-blocks"), tau, every).join(tried, ["a", "b"], "left_anti"), "similar-rest", keep=True)
            if not rest.agg(F.count("*")).first()[0]:
                continue
            links = materialize(_verified(rest, whole), "similar-links", keep=True)
        tried = tried.unionByName(rest)
        stars = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = connected_components(stars.unionByName(links))
    return found


def drop_similar(docs: DataFrame, width: int = 5, tau: int = SKETCH_TAU, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, of which the least doc_id of each group of similar texts stays (a null one last, then by a hash of the text)."""
    rows = materialize(sketch_rows(docs, width), "similar-rows")
    found = materialize(similar_components(docs, rows, width, tau, block), "similar-components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    grouped = rows.groupBy("node").agg(F.min(rank).alias("least")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = materialize(grouped.groupBy("component").agg(F.min("least").alias("least")).select("least.doc_id", "least.th"), "similar-kept")
    id_, none, th = (free_name(docs, n) for n in ("id", "none", "th"))
    kept = kept.select(F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("doc_id").isNull().alias(none), F.col("th").alias(th))
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), none: F.col("doc_id").isNull(), th: _text_hash()})
    return keyed.join(kept.hint("merge"), [id_, none, th], "left_semi").dropDuplicates([id_, none, th]).drop(id_, none, th)
