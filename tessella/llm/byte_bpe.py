"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut by the tokenizer's pattern; every distinct piece of a block is encoded once. Pieces of
like length form the rows of a padded matrix of symbols. In each round every row looks up the ranks
of all its neighbouring pairs in a hash table, merges its leftmost pair of least rank, and closes
the gap; rows without a mergeable pair leave the matrix. Pieces longer than ``MATRIX_LENGTH`` bytes
are merged one by one with a heap, which gives the same ids without a quadratic matrix.

Cases: null counts as the empty text (no ids); white space only, very long texts and repeated rows
need no special care; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import blocks
from tessella.llm.word_tokens import _Index, ragged_take

MATRIX_LENGTH = 1024
#: Cells of one matrix.
MATRIX_CELLS = 1 << 20
NO_RANK = np.int32(np.iinfo(np.int32).max)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id of the token they form."""

    EMPTY = np.int64(-1)

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.keys = np.full(1 << self.bits, self.EMPTY, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._slot(keys)
        left = np.arange(len(keys))
        self.reach = 0
        while len(left):  # each round places the first key that wants a free slot, the others move on
            self.reach += 1
            free = left[self.keys[slots[left]] == self.EMPTY]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], values[placed]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged ids of the pairs, ``NO_RANK`` where there is none."""
        keys = a.astype(np.int64) << 32 | b
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], NO_RANK)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != self.EMPTY))
        for _ in range(self.reach):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != self.EMPTY)]
        return out


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.table = PairTable(self.pairs)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merge_matrix(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges all rows of a padded matrix to the end; the matrix and its lengths afterwards."""
        out, done = symbols.copy(), lengths.copy()
        rows, m, n = np.arange(len(symbols)), symbols.copy(), lengths.copy()
        while len(rows) and m.shape[1] > 1:
            rank = self.table.look_up(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
            rank[np.arange(rank.shape[1]) >= (n - 1)[:, None]] = NO_RANK
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(m)), at]
            live = best != NO_RANK
            ended = ~live
            out[rows[ended], : m.shape[1]], done[rows[ended]] = m[ended], n[ended]
            rows, m, n, at, best = rows[live], m[live], n[live], at[live], best[live]
            if not len(rows):
                break
            m[np.arange(len(m)), at] = best
            column = np.arange(m.shape[1] - 1)
            m = np.where(column > at[:, None], m[:, 1:], m[:, :-1])  # closes the gap behind the merged pair
            n = n - 1
        out[rows, : m.shape[1]], done[rows] = m, n
        return out, done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap of pairs."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.pairs.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := self.pairs.get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := self.pairs.get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and each piece's start and length there."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts, lengths, parts, at = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        ready = np.flatnonzero(whole >= 0)
        starts[ready], lengths[ready] = np.arange(len(ready)), 1
        parts.append(whole[ready])
        at = len(ready)
        todo = np.flatnonzero(whole < 0)
        todo = todo[np.argsort(size[todo], kind="stable")]
        short = todo[size[todo] <= MATRIX_LENGTH]
        i = 0
        while i < len(short):  # a bucket: from this length to half as much again, within the cells
            top = int(np.searchsorted(size[short], size[short[i]] * 3 // 2, "right"))
            j = min(max(top, i + 1), i + max(1, MATRIX_CELLS // int(size[short[max(top, i + 1) - 1]])))
            rows = short[i:j]
            width = int(size[rows[-1]])
            flat = self.of_byte[np.frombuffer(b"".join([pieces[k] for k in rows]), np.uint8)]
            inside = np.arange(width) < size[rows][:, None]
            matrix = np.zeros((len(rows), width), np.int32)
            matrix[inside] = flat
            merged, left = self.merge_matrix(matrix, size[rows])
            parts.append(merged[np.arange(width) < left[:, None]])
            lengths[rows] = left
            starts[rows] = at + np.cumsum(left) - left
            at += int(left.sum())
            i = j
        for k in todo[size[todo] > MATRIX_LENGTH]:
            ids = self.merge_long(pieces[k])
            parts.append(ids)
            starts[k], lengths[k] = at, len(ids)
            at += len(ids)
        return np.concatenate(parts), starts, lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32) and the ends of the texts' ids."""
        index, at, counts = _Index(), [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.pattern.findall(text)
            counts[i] = len(found)
            at.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
        if not index:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        flat, starts, lengths = self.encode_pieces([p.encode() for p in index])
        ids, ends = ragged_take(flat, starts, lengths, np.concatenate(at))
        return ids.astype(np.uint32), np.concatenate([[0], ends])[np.cumsum(counts)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text from its ids."""
        out, cut = ragged_take(self.token_bytes, self.token_starts, self.token_lengths, ids.astype(np.int64))
        data, cut = out.tobytes(), np.concatenate([[0], cut])[ends]
        return [data[a:b] for a, b in zip(np.concatenate([[0], cut[:-1]]), cut)]


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One tokenizer a Python worker."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` to all columns of ``docs`` but the text.

    Null counts as the empty text. A narrow per-row map: no shuffle, memory bounded by the block.
    """
    keep = [f for f in docs.schema.fields if f.name not in (text, "ids", "n_tokens")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for a, b in blocks(texts):
                ids, ends = bpe.encode(texts[a:b])
                starts = np.concatenate([[0], ends[:-1]])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([ids[x:y].astype("<u4").tobytes() for x, y in zip(starts, ends)], pa.binary()), pa.array(ends - starts, pa.int64())], [*names, "ids", "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "ids binary", "n_tokens bigint"])
    return docs.select(*(f"`{n}`" for n in names), f"`{text}`").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) from the ids."""
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            rows = [x or b"" for x in batch.column(ids).to_pylist()]
            for a, b in blocks(rows):
                flat = np.frombuffer(b"".join(rows[a:b]), "<u4")
                out = bpe.decode(flat, np.cumsum([len(x) // 4 for x in rows[a:b]]))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(out, pa.binary())], [*(f.name for f in fields), "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "decoded binary"])
    return encoded.select(*(f"`{f.name}`" for f in fields)).mapInArrow(run, schema)
