"""Mixture-controlled packing of token streams into fixed-length sequences.

Deficit round-robin over one queue a source: each window gives every source a quantum in its target
share of the window, and what a quantum leaves over in fractions of a token is carried to the next
window. The serving position after ``w`` windows is therefore ``floor(w * num / den)``, so any
document finds its windows from its position in its source's queue alone: the deficits carry across
windows, partitions and executors through distributed running totals, with no sequential pass.
Windows are laid end to end and cut every ``length`` tokens, so only the last sequence is padded.

Cases: null or empty texts still hold the end id; a null source is the queue ``""``; equal doc ids
are told apart by a row number; ties keep the order (source, doc_id, row number); an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import column_blocks, join_skewed, materialize, running_total
from tessella.llm.word_tokens import word_encoder

#: Tokens of a window: the span over which the mixture is held.
WINDOW_SEQUENCES = 64


def encode_documents(docs: DataFrame, path: str, end_id: int, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with ``n`` (ids with the end id) and ``ids`` (binary, little-endian)."""
    fields = [docs.schema[c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for a, b in column_blocks(batch.column("text")):
                ids, ends = encoder.encode(batch.column("text").slice(a, b - a))
                data, step = ids.tobytes(), encoder.dtype.itemsize
                starts = np.concatenate([[0], ends[:-1]])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(ends - starts + 1, pa.int64()), pa.array([data[x * step : y * step] + end for x, y in zip(starts, ends)], pa.binary())], [*columns, "n", "ids"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n bigint", "ids binary"])
    return docs.select(*columns, "text").mapInArrow(run, schema)


def _natural(totals: DataFrame, windows: int) -> DataFrame:
    """One phase a source: its share of the corpus is its share of every window."""
    phase = F.struct(F.lit(0).cast("long").alias("c_from"), F.col("total").alias("c_to"), F.lit(0).cast("long").alias("w_from"), F.col("total").alias("num"), F.lit(windows).cast("long").alias("den"))
    return totals.withColumn("phases", F.array(phase))


def mixture_phases(totals: dict[str, int], weights: dict[str, int], window: int) -> dict[str, list[tuple[int, int, int, int, int]]]:
    """Phases ``(c_from, c_to, w_from, num, den)`` of each source under fixed whole-number weights.

    A phase ends in the window in which some source runs out; the others then share its quantum in
    proportion to their weights. Sources without a weight take weight 1.
    """
    place, w, out = dict.fromkeys(totals, 0), 0, {s: [] for s in totals}
    active = {s for s, t in totals.items() if t > 0}
    while active:
        den = sum(weights.get(s, 1) for s in active)
        num = {s: window * weights.get(s, 1) for s in active}
        last = min(-(-(totals[s] - place[s]) * den // num[s]) for s in active)
        for s in list(active):
            to = min(totals[s], place[s] + int(Fraction(last * num[s], den)))
            out[s].append((place[s], to, w, num[s], den))
            place[s] = to
            if to >= totals[s]:
                active.discard(s)
        w += last
    return out


def pack(encoded: DataFrame, length: int = 4096, mixture: dict[str, int] | None = None, window_sequences: int = WINDOW_SEQUENCES) -> DataFrame:
    """Pieces ``(rid, doc_id, start, n, doc_tokens, sequence_id, offset)`` of ``encoded(rid, doc_id, source, n)``.

    ``mixture``: whole-number weight of each source; None: every window mirrors the corpus. Only the
    sources named in ``mixture`` have phases of their own on the driver, so that list is its bound.
    """
    spark = encoded.sparkSession
    window = length * window_sequences
    rows = encoded.select("rid", "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("n").cast("long").alias("n"))
    placed = running_total(rows, ["source", "doc_id", "rid"], "n", "at", "pack-queue")
    totals = materialize(rows.groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("rows")), "pack-sources")
    starts = running_total(totals, ["source"], "total", "base", "pack-bases").drop("rows")
    if mixture is None:
        tokens = totals.agg(F.sum("total")).first()[0] or 0
        sources = _natural(starts, max(1, -(-tokens // window)))
    else:
        named = {r["source"]: r["total"] for r in totals.filter(F.col("source").isin(list(mixture))).collect()}
        rest = totals.filter(~F.col("source").isin(list(mixture))).agg(F.sum("total")).first()[0]
        if rest:
            raise ValueError("mixture must name every source")
        kind = "source string, phases array<struct<c_from:bigint,c_to:bigint,w_from:bigint,num:bigint,den:bigint>>"
        sources = starts.join(F.broadcast(spark.createDataFrame([(s, p) for s, p in mixture_phases(named, mixture, window).items()], kind)), "source")
    sources = materialize(sources.join(totals.select("source", "rows"), "source"), "pack-phases")
    queued = join_skewed(placed, sources, "source", "rows").withColumn("c", F.col("at") - F.col("base"))
    cut = (
        queued.select("rid", "doc_id", "source", "n", "c", F.explode("phases").alias("p"))
        .select("rid", "doc_id", "source", "n", "c", "p.*")
        .withColumns({"from": F.greatest("c", "c_from"), "to": F.least(F.col("c") + F.col("n"), "c_to")})
        .filter(F.col("from") < F.col("to"))
    )
    # the window that holds position x of a phase is the last w with floor(w * num / den) <= x
    at = "w_from + ((cast({x} - c_from + 1 as decimal(19,0)) * cast(den as decimal(19,0)) - 1) div num)"
    begin = "c_from + ((cast({w} - w_from as decimal(19,0)) * cast(num as decimal(19,0))) div den)"
    cut = cut.withColumn("w", F.explode(F.sequence(F.expr(at.format(x="`from`")), F.expr(at.format(x="(`to` - 1)")))))
    cut = cut.withColumns({"lo": F.greatest("from", F.expr(begin.format(w="w"))), "hi": F.least("to", F.expr(begin.format(w="(w + 1)")))}).filter(F.col("lo") < F.col("hi"))
    windows = cut.select("rid", "doc_id", "w", "source", "lo", (F.col("lo") - F.col("c")).alias("start"), (F.col("hi") - F.col("lo")).alias("size"), F.col("n").alias("doc_tokens"))
    laid = running_total(windows, ["w", "source", "lo", "rid"], "size", "pos", "pack-windows")
    laid = laid.withColumn("sequence_id", F.explode(F.expr(f"sequence(pos div {length}, (pos + size - 1) div {length})")))
    first = F.greatest(F.col("pos"), F.col("sequence_id") * length)
    last = F.least(F.col("pos") + F.col("size"), (F.col("sequence_id") + 1) * length)
    return laid.select("rid", "doc_id", (F.col("start") + first - F.col("pos")).alias("start"), (last - first).alias("n"), "doc_tokens", "sequence_id", (first - F.col("sequence_id") * length).alias("offset"))


def with_ids(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``ids`` (binary of the encoder's width) and ``ids_crc32`` over 32-bit ids."""
    lists = pieces.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "n", "sequence_id", "offset"))).alias("cuts"))  # one document's own cuts
    joined = encoded.select("rid", "doc_id", F.col("n").alias("doc_tokens"), "ids").join(lists.hint("merge"), "rid")  # the cuts grow with the input: never broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(8)]
            for doc_id, tokens, data, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "cuts"))):
                kind = f"<u{len(data) // tokens}"
                ids = np.frombuffer(data, kind)
                for cut in cuts:
                    part = ids[cut["start"] : cut["start"] + cut["n"]]
                    values = (doc_id, cut["start"], cut["n"], part.tobytes(), zlib.crc32(part.astype("<u4").tobytes()), tokens, cut["sequence_id"], cut["offset"])
                    for column, value in zip(columns, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return joined.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, length: int = 4096, mixture: dict[str, int] | None = None) -> DataFrame:
    """Encodes, packs and cuts ``docs(doc_id, text, source)``; one row a piece with its ids.

    The ids are encoded once and stored; only they and each document's cuts meet in the last join.
    """
    base = docs.select("doc_id", "source", "text")
    encoded = encode_documents(base, path, end_id, ["doc_id", "source"]).withColumn("rid", F.monotonically_increasing_id())
    encoded = materialize(encoded, "pack-ids")
    return with_ids(encoded, pack(encoded, length, mixture))
