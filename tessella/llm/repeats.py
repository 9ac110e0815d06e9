"""Repeated byte strings across a corpus, by longest-previous-factor arrays.

A byte goes when it lies in a string of ``length`` bytes that also starts elsewhere: anywhere (``keep``
is "none"), or earlier in the corpus ("first": the first copy stays). No suffix array of a whole corpus
is built; suffixes are dealt so that all with a common prefix of ``length`` bytes meet:

* The least hash of the windows of ``k`` bytes inside a string is its anchor. Equal strings have equal
  anchors, so only anchors that occur twice matter, and neighbouring strings share theirs: one piece of text
  (the strings of a run of starts) is sent for each anchor that is left.
* Equal pieces are one row, with the first and the last place where they occur.
* Pieces go to groups by anchor. A group sorts its suffixes by prefix doubling; in suffix order the
  previous and next places of smaller text position give each suffix's longest match with an earlier
  one, counted up to ``length``; mirrored positions give matches with later ones.
* Pieces of an anchor too frequent for a group are cut again by longer anchors, in the end by whole strings of
  ``length`` bytes. Equal ones of these are one row, so no group is too large.

Equal texts are one class from the start. The text position is the place in the sequence of distinct
texts, ordered by least doc_id (null first), then by hash.

Cases: a null text is empty; texts shorter than ``length`` lose nothing; text is read as UTF-8 bytes and
what is left need not be UTF-8; long texts are handled whole, in overlapping parts; of equal rows the first
stored one is the first; rows without an id are rows as others; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import column_blocks, join_skewed, materialize, running_total, temporary_tables

#: Starts of strings handled at once; places in a part fit the low bits of a key.
PART = 1 << 21
PLACE = np.uint64((1 << 22) - 1)
#: Bytes of pieces in a group, about; an anchor with more than HOT is cut again.
GROUP, HOT = 3 << 20, 1 << 20
#: Odd, so it has an inverse among 64-bit numbers.
BASE = 0x9E3779B97F4A7C15 | 1
RUN = "array<struct<start:int,stop:int,earlier:boolean>>"


def anchor_lengths(length: int) -> list[int]:
    """``k`` of the first and of later cuts."""
    return sorted({max(1, length * 5 // 16), max(1, length * 5 // 8), length})


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Grams:
    """Hashes of all windows of ``k`` bytes, by a polynomial whose sums are running ones."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, k: int) -> np.ndarray:
        n = len(data)
        if n > len(self.up):
            self.up, self.down = _powers(n, BASE), _powers(n, pow(BASE, -1, 1 << 64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[: n + 1 - k]) * self.down[: n + 1 - k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values: least so far from either side within fixed blocks."""
    n = len(values) - width + 1
    if width == 1:
        return values
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchored_runs(data: np.ndarray, ends: np.ndarray, length: int, k: int, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, start, stop)``: runs of starts of strings that have one anchor, for texts that end at ``ends``.

    Of equal hashes in a string the first is the anchor; equal strings have it at the same place.
    """
    hashes, starts, stops = [], [], []
    for at in range(0, max(0, len(data) - length + 1), PART):
        part = data[at : at + PART + length - 1]
        h = grams(part, k)
        least = _sliding_least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - k + 1)
        here = np.arange(len(least))
        fits = here + at + length <= ends[np.searchsorted(ends, here + at, "right")]
        here, anchor = here[fits], (least[fits] & PLACE).astype(np.int64)
        new = np.flatnonzero(np.diff(anchor, prepend=-1))  # the anchor of another text is another place
        if not len(new):
            continue
        hashes.append(h[anchor[new]].view(np.int64))
        starts.append(here[new] + at)
        stops.append(here[np.append(new[1:], len(here)) - 1] + at + 1)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (hashes, starts, stops))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary column, and where each text ends in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _lists(columns: list[np.ndarray], counts: np.ndarray, kinds: list[pa.DataType]) -> list[pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(c, kind)) for c, kind in zip(columns, kinds)]


def _anchor(length: int, k: int, name: str, digest: bool = False, text: bool = True):
    """Adds the runs of each text; ``digest``: and its SHA-256 and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for start, stop in column_blocks(batch.column("text")):
                rows = batch.slice(start, stop - start)
                texts = rows.column("text")
                data, ends = _bytes(texts)
                hashes, starts, stops = anchored_runs(data, ends, length, k, grams)
                of = np.searchsorted(ends, starts, "right")
                begin = np.concatenate([[0], ends[:-1]])[of]
                lists = _lists([hashes, starts - begin, stops - begin], np.bincount(of, minlength=len(ends)), [pa.int64(), pa.int32(), pa.int32()])
                own = [pa.array([hashlib.sha256(t.as_buffer() or b"").digest() for t in texts], pa.binary()), pa.array(np.diff(ends, prepend=0), pa.int64())] if digest else []
                names = ["key", "n_bytes"] if digest else []
                if text:
                    own, names = [*own, texts], [*names, "text"]
                yield pa.RecordBatch.from_arrays([rows.column(name), *own, *lists], [name, *names, "hashes", "starts", "stops"])

    return run


def _pieces(length: int, contents: bool):
    """One row a run: its bytes (``contents``) or their MD5, with where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int64()] if contents else [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["hash", "content", "pos"] if contents else ["pos", "start", "many", "digest"]
        out: list[tuple] = []

        def full() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

        for batch in batches:
            for pos, text, runs in zip(*(batch.column(c) for c in ("pos", "text", "runs"))):
                at, body = pos.as_py(), memoryview(text.as_buffer())
                for hashed, start, stop in zip(*(runs.values.field(c).to_pylist() for c in ("hash", "start", "stop"))):
                    cut = body[start : stop + length - 1]
                    out.append((hashed, bytes(cut), at + start) if contents else (at, start, stop - start, hashlib.md5(cut).digest()))
                    if len(out) == 10_000:
                        yield full()
        yield full()

    return run


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ranks = np.empty(len(keys), np.uint64)
    ranks[order] = np.cumsum(np.diff(keys[order], prepend=keys[order[:1]]) != 0)
    return ranks


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all prefixes of ``length`` bytes, equal for equal ones, by doubling; the text ends in zeros."""
    known = min(8, length)
    words = np.zeros(len(data), np.uint64)
    for j in range(known):
        words[: len(data) - j] |= data[j:].astype(np.uint64) << np.uint64(8 * (known - 1 - j))
    ranks = _ranks(words)
    while known < length:
        step = min(known, length - known)
        keys = ranks << np.uint64(32)
        keys[: len(data) - step] |= ranks[step:] + np.uint64(1)
        ranks = _ranks(keys)
        known += step
    return ranks


def previous_smaller(values: np.ndarray, fence: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, not beyond ``fence``; -1: none. By pointer jumping."""
    at = np.arange(len(values)) - 1
    at[at < fence] = -1
    todo = np.arange(len(values))
    while len(todo):
        todo = todo[at[todo] >= 0]
        todo = todo[values[at[todo]] >= values[todo]]
        at[todo] = at[at[todo]]
    return at


def has_previous_factor(ranks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Whether a suffix's longest previous factor reaches the length of the ranked prefixes.

    In suffix order the nearest smaller positions on both sides give the longest match; it reaches the
    full length where no rank changes on the way, which the fences stand for.
    """
    order = np.lexsort((positions, ranks))
    sorted_ranks, sorted_positions = ranks[order], positions[order]
    change = np.flatnonzero(np.diff(sorted_ranks)) + 1
    first = np.zeros(len(order), np.int64)
    first[change] = change
    first = np.maximum.accumulate(first)
    back = sorted_ranks[::-1]
    last = np.zeros(len(order), np.int64)
    turned = np.flatnonzero(np.diff(back)) + 1
    last[turned] = turned
    last = np.maximum.accumulate(last)
    found = previous_smaller(sorted_positions, first) >= 0
    found |= (previous_smaller(sorted_positions[::-1], last) >= 0)[::-1]
    out = np.empty(len(order), bool)
    out[order] = found
    return out


def repeated_starts(data: np.ndarray, ends: np.ndarray, firsts: np.ndarray, length: int, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``data`` where a repeated string of ``length`` bytes starts, and whether it occurs earlier.

    ``data`` holds pieces that end at ``ends`` and stand at text positions ``firsts``. Strings whose hash is
    alone are left out first, and only bytes of the others are sorted; a shared hash decides nothing.
    """
    h = grams(data, length)
    here = np.arange(len(h))
    of = np.searchsorted(ends, here, "right")
    here = here[here + length <= ends[of]]
    ranks = _ranks(h[here])
    here = here[np.bincount(ranks.astype(np.int64))[ranks.astype(np.int64)] > 1]
    if not len(here):
        return here, np.zeros(0, bool)
    gaps = np.diff(here, prepend=here[0])
    took = np.minimum(gaps, length)  # strings that overlap share their bytes
    place = np.cumsum(took)
    take = np.zeros(len(data) + 1, np.int64)
    np.add.at(take, here, 1)
    np.add.at(take, here + length, -1)
    covered = data[np.cumsum(take[:-1]) > 0]
    ranks = prefix_ranks(covered, length)[place]
    begins = np.concatenate([[0], ends[:-1]])
    of = np.searchsorted(ends, here, "right")
    positions = firsts[of] + here - begins[of]
    earlier = has_previous_factor(ranks, positions)
    any_ = earlier | has_previous_factor(ranks, -positions)
    return here[any_], earlier[any_]


def _factor_group(length: int):
    def run(table: pa.Table) -> pa.Table:
        data, ends = _bytes(pa.concat_arrays(table.column("content").chunks))
        firsts = table.column("first").to_numpy()
        here, earlier = repeated_starts(data, ends, firsts, length, Grams())
        of = np.searchsorted(ends, here, "right")
        local = here - np.concatenate([[0], ends[:-1]])[of]
        new = np.flatnonzero((np.diff(here, prepend=-2) != 1) | (np.diff(of, prepend=-1) != 0) | (np.diff(earlier.astype(np.int8), prepend=-1) != 0))
        stop = local[np.append(new[1:], len(here)) - 1] + 1 if len(new) else new
        runs = pa.StructArray.from_arrays([pa.array(local[new], pa.int32()), pa.array(stop, pa.int32()), pa.array(earlier[new])], ["start", "stop", "earlier"])
        owners, counts = np.unique(of[new], return_counts=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.table({"first": pa.array(firsts[owners], pa.int64()), "runs": pa.ListArray.from_arrays(offsets, runs)})

    return run


def _shifted(runs: Column, by: Column) -> Column:
    return F.transform(runs, lambda r: F.struct((r["start"] + by).alias("start"), (r["stop"] + by).alias("stop"), r["earlier"].alias("earlier")))


def _repeated_runs(anchored: DataFrame, attach, length: int, level: int) -> tuple[DataFrame, DataFrame]:
    """``(pos, runs)``: the repeated strings of texts at ``pos``, as runs of starts; a run of a string met earlier is marked. And ``(pos, text)`` of the texts that may have some.

    ``anchored``: ``(pos, hashes, starts, stops)``, stored but at level 0. ``attach`` adds the ``text`` to rows with ``pos``.
    """
    lengths = anchor_lengths(length)
    name = f"repeats-{level}"
    with temporary_tables(anchored.sparkSession):  # candidates and classes outlive it
        if level == 0:
            anchored = materialize(anchored, f"{name}-anchored")
        each = anchored.select("pos", F.explode(F.arrays_zip("hashes", "starts", "stops")).alias("r")).select("pos", F.col("r.hashes").alias("hash"), F.col("r.starts").alias("start"), F.col("r.stops").alias("stop"))
        seen = materialize(each.groupBy("hash").agg(F.count("*").alias("seen")).filter("seen > 1"), f"{name}-seen")
        again = join_skewed(each, seen, "hash", "seen").groupBy("pos").agg(F.collect_list(F.struct("hash", "start", "stop")).alias("runs"))  # a text's own runs
        candidates = materialize(attach(again), f"{name}-candidates", keep=True)
        found = candidates.mapInArrow(_pieces(length, True), "hash bigint, content binary, pos bigint")
        contents = found.groupBy("hash", "content").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
        contents = materialize(contents.withColumn("digest", F.unhex(F.md5("content"))), f"{name}-contents")
        sizes = materialize(contents.groupBy("hash").agg(F.count("*").alias("pieces"), F.sum(F.octet_length("content")).alias("bytes")).filter("pieces > 1"), f"{name}-sizes")
        total = sizes.agg(F.sum("bytes")).first()[0] or 0
        # an anchor with one piece only has nothing to compare
        sized = join_skewed(contents.select("hash", "content", "first"), sizes, "hash", "pieces")
        is_hot = (F.col("bytes") > HOT) & F.lit(level + 1 < len(lengths))
        groups = max(1, -(-total // GROUP))
        cold = sized.filter(~is_hot).select("first", "content", F.pmod(F.xxhash64("hash"), F.lit(groups)).alias("group"))
        runs = cold.groupBy("group").applyInArrow(_factor_group(length), f"first bigint, runs {RUN}")
        if level + 1 < len(lengths) and sizes.filter(F.col("bytes") > HOT).head(1):
            hot = materialize(sized.filter(is_hot).select(F.col("first").alias("pos"), F.col("content").alias("text")), f"{name}-hot")
            cut = hot.mapInArrow(_anchor(length, lengths[level + 1], "pos"), "pos bigint, text binary, hashes array<bigint>, starts array<int>, stops array<int>")
            cut = materialize(cut, f"{name}-cut")
            deeper, _ = _repeated_runs(cut.drop("text"), lambda rows: rows.join(cut.select("pos", "text"), "pos"), length, level + 1)
            runs = runs.unionByName(deeper.select(F.col("pos").alias("first"), "runs"))
        classes = contents.select("digest", "n", "first", (F.col("first") < F.col("last")).alias("copied")).join(runs, "first", "left")
        classes = materialize(classes.filter("runs is not null or copied"), f"{name}-classes", keep=True)
    places = candidates.mapInArrow(_pieces(length, False), "pos bigint, start int, many int, digest binary")
    met = join_skewed(places, classes, "digest", "n")
    is_first = F.col("pos") + F.col("start") == F.col("first")
    whole = lambda earlier: F.array(F.struct(F.lit(0).alias("start"), F.col("many").alias("stop"), F.lit(earlier).alias("earlier")))
    none = F.array().cast(RUN)
    own = F.when(~is_first, whole(True)).otherwise(F.concat(F.coalesce("runs", none), F.when(F.col("copied"), whole(False)).otherwise(none)))
    found = met.select("pos", _shifted(own, F.col("start")).alias("runs")).groupBy("pos").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return found, candidates.select("pos", "text")


def _spans(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Disjoint byte ranges that the strings of ``runs`` cover, in order."""
    out: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"] + length - 1) for r in runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(s) for s in out]


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


_DECIDED = "pos bigint, spans array<struct<start:int,stop:int>>, n_removed bigint, kept_sha256 string"


def _decide(length: int, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pos, text, runs in zip(*(batch.column(c) for c in ("pos", "text", "runs"))):
                spans = _spans([r for r in runs.as_py() if keep == "none" or r["earlier"]], length)
                row = {"pos": pos.as_py(), "spans": [{"start": a, "stop": b} for a, b in spans], "n_removed": sum(b - a for a, b in spans), "kept_sha256": hashlib.sha256(_cut(text.as_py(), spans)).hexdigest()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("pos", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

    return run


def repeat_spans(docs: DataFrame, length: int = 200, keep: str = "first", with_text: bool = False) -> DataFrame:
    """``(doc_id, key, n_bytes, n_removed, spans, kept_sha256)`` for every row of ``docs(doc_id, text)``.

    ``key`` is the SHA-256 of the text's bytes, ``spans`` the maximal removed ranges. ``keep``: "first" keeps the
    first copy of every string, "none" no copy. ``with_text``: the text's bytes come along as ``text``.
    """
    if keep not in ("first", "none") or length < 1:
        raise ValueError("keep is first or none, and a length is positive")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(_anchor(length, anchor_lengths(length)[0], "doc_id", True, with_text), f"doc_id {kind}, key binary, n_bytes bigint, {'text binary, ' * with_text}hashes array<bigint>, starts array<int>, stops array<int>")
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "repeats-rows")
    lead = F.min(F.struct("doc_id", "rid")).alias("lead")
    classes = rows.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("copies"), lead, F.min("n_bytes").alias("n_bytes"))
    classes = classes.select("key", "copies", "n_bytes", F.col("lead.doc_id").alias("lead_id"), F.col("lead.rid").alias("lead_rid"))
    placed = materialize(running_total(classes, ["lead_id", "key"], "n_bytes", "pos", "repeats-order"), "repeats-placed")
    anchored = rows.select("rid", "hashes", "starts", "stops").join(placed.select("pos", F.col("lead_rid").alias("rid")), "rid").drop("rid")
    keyed = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"), "text")
    named = placed.select("pos", F.col("key").alias("of"), "lead_id")

    def attach(found: DataFrame) -> DataFrame:
        """The text from a row of the class's first id; several equal ones do no harm."""
        return keyed.join(found.join(named, "pos").hint("merge"), (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("lead_id"))).select("pos", "text", "runs")

    runs, candidates = _repeated_runs(anchored, attach, length, 0)
    decided = materialize(candidates.join(runs.hint("merge"), "pos").mapInArrow(_decide(length, keep), _DECIDED).dropDuplicates(["pos"]), "repeats-decided")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    decisions = placed.select("pos", "key", "copies", "lead_rid").join(decided, "pos", "left").drop("pos")
    decisions = materialize(decisions.filter("copies > 1 or spans is not null"), "repeats-decisions")
    met = join_skewed(rows.select("rid", "doc_id", "key", "n_bytes", *["text"] * with_text), decisions, "key", "copies", how="left")
    gone = F.coalesce(F.col("copies") > 1, F.lit(False)) if keep == "none" else F.coalesce(F.col("rid") != F.col("lead_rid"), F.lit(False))
    spans = F.when(gone, whole).otherwise(F.coalesce("spans", none))
    removed = F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    digest = F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key"))))
    return met.select("doc_id", "key", "n_bytes", removed.alias("n_removed"), spans.alias("spans"), digest.alias("kept_sha256"), *["text"] * with_text)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = [_cut(text.as_py(), [(s["start"], s["stop"]) for s in spans.as_py()]) for text, spans in zip(batch.column("text"), batch.column("spans"))]
        columns = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(left, pa.binary())], [*columns, "kept"])


def drop_repeats(docs: DataFrame, length: int = 200, keep: str = "first") -> DataFrame:
    """:func:`repeat_spans` with ``kept``, the bytes that are left of each row's text."""
    found = repeat_spans(docs, length, keep, with_text=True)
    kinds = ", ".join(f"{c} {kind}" for c, kind in found.dtypes if c != "text")
    return found.mapInArrow(_kept, f"{kinds}, kept binary")


ORACLE_SQL = """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
hexed AS MATERIALIZED (SELECT rid, doc_id, octet_length(b) AS n, hex(b) AS h FROM docs),
strings AS MATERIALIZED (SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS d FROM hexed, range(0, n - 199) t(i) WHERE n >= 200),
many AS (SELECT d FROM strings GROUP BY d HAVING count(*) > 1),
hit AS (SELECT rid, i FROM strings SEMI JOIN many USING (d)),
led AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM hit),
grouped AS (SELECT rid, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS g FROM led),
spans AS (SELECT rid, g, min(i) AS a, max(i) + 200 AS z FROM grouped GROUP BY rid, g),
edges AS (SELECT rid, g, a, z, lag(z, 1, 0) OVER (PARTITION BY rid ORDER BY g) AS before FROM spans),
cut AS (SELECT e.rid, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY g) AS head, max(z) AS tail FROM edges e JOIN hexed USING (rid) GROUP BY e.rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM hexed LEFT JOIN cut USING (rid)
"""
