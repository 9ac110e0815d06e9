"""Language identification with a byte convolutional network trained in numpy.

Bytes are folded to :data:`SYMBOLS` classes (case, digits and marks together), embedded, convolved with
filters of several widths, max-pooled over a fixed window and classified by a softmax layer. Training
is plain backpropagation with Adam on windows of labelled texts. At prediction the responses of a
filter to every pair of symbols are tables, so a convolution is a few look-ups and additions a byte;
all windows of the whole text are scored and their log-probabilities are averaged by filled length.

Cases: a null text or one without a letter is ``und`` with score 0; very long texts are scored window by
window in bounded blocks; repeated rows get equal predictions; without any labelled row everything is
``und``; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import blocks, fold, materialize

UNDETERMINED = "und"
SYMBOLS = 128
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 8
#: Bounds of the training sample: texts a language, texts of all languages (but one of each at least), characters a text.
TEXTS_A_LANGUAGE, SAMPLE_TEXTS, SAMPLE_CHARS = 600, 120_000, 512
#: Steps of training at least, and for each language; windows of a step.
STEPS, STEPS_A_LANGUAGE, BATCH = 320, 40, 48
#: Windows scored at once.
WINDOWS_AT_ONCE = 512


def symbol_table() -> np.ndarray:
    """Class of each byte: 0 padding, 1 blank, 2-27 letters, 28 digits, 29 marks, 30-61 UTF-8 continuation bytes by their low five bits, 62 on lead bytes."""
    table = np.full(256, 29, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 1
    for i in range(26):
        table[[65 + i, 97 + i]] = 2 + i
    table[48:58] = 28
    table[0x80:0xC0] = 30 + (np.arange(0x80, 0xC0) & 31)
    table[0xC0:] = 62 + np.arange(64)
    return table


FOLD = symbol_table()


@dataclass
class ByteNet:
    languages: list[str]
    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    shift: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.kernels, *self.biases, self.dense, self.shift]

    def tables(self) -> "PairTables":
        return PairTables(self)


def new_net(languages: list[str], seed: int = 7) -> ByteNet:
    r = np.random.default_rng(seed)
    pooled = FILTERS * len(WIDTHS)
    return ByteNet(
        languages,
        r.normal(0, 0.5, (SYMBOLS, EMBEDDING)).astype(np.float32),
        [r.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        r.normal(0, 1 / np.sqrt(pooled), (pooled, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )


def gradients(net: ByteNet, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of windows ``x`` (symbols) with classes ``y``, and its gradients by parameter."""
    n = len(x)
    embedded = net.embedding[x]
    pooled, places = [], []
    for w, kernel, bias in zip(WIDTHS, net.kernels, net.biases):
        patches = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1)  # n, positions, EMBEDDING, w
        patches = patches.transpose(0, 1, 3, 2).reshape(n, -1, w * EMBEDDING)
        response = patches @ kernel + bias
        at = response.argmax(axis=1)
        pooled.append(np.take_along_axis(response, at[:, None], axis=1)[:, 0])
        places.append(at)
    joined = np.concatenate(pooled, axis=1)
    active = np.maximum(joined, 0)
    logits = active @ net.dense + net.shift
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-np.log(p[np.arange(n), y] + 1e-12).mean())
    d = p
    d[np.arange(n), y] -= 1
    d /= n
    d_dense, d_shift = active.T @ d, d.sum(axis=0)
    d_joined = (d @ net.dense.T) * (joined > 0)
    d_embedding, d_kernels, d_biases = np.zeros_like(net.embedding), [], []
    for k, (w, kernel, at) in enumerate(zip(WIDTHS, net.kernels, places)):
        own = d_joined[:, k * FILTERS : (k + 1) * FILTERS]
        symbols = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]  # n, FILTERS, w
        patch = net.embedding[symbols].reshape(n, FILTERS, w * EMBEDDING)
        d_kernels.append(np.einsum("nf,nfp->pf", own, patch))
        d_biases.append(own.sum(axis=0))
        np.add.at(d_embedding, symbols, np.einsum("nf,pf->nfp", own, kernel).reshape(n, FILTERS, w, EMBEDDING))
    return loss, [d_embedding, *d_kernels, *d_biases, d_dense, d_shift]


def train(samples: list[tuple[str, str]], seed: int = 7) -> ByteNet | None:
    """A network from ``(language, text)`` samples; windows of changing place and length are drawn from each."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    r = np.random.default_rng(seed)
    net = new_net(languages, seed)
    texts = [FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)] for _, text in samples]
    classes = np.array([languages.index(lang) for lang, _ in samples])
    by_class = [np.flatnonzero(classes == c) for c in range(len(languages))]
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    steps = max(STEPS, STEPS_A_LANGUAGE * len(languages))
    for step in range(1, steps + 1):
        y = r.integers(0, len(languages), BATCH)  # classes in equal parts
        x = np.zeros((BATCH, WINDOW), np.uint8)
        for i, c in enumerate(y):
            text = texts[by_class[c][r.integers(len(by_class[c]))]]
            size = min(len(text), WINDOW if r.random() < 0.5 else int(r.integers(4, WINDOW + 1)))
            at = int(r.integers(0, len(text) - size + 1))
            x[i, :size] = text[at : at + size]
        _, grads = gradients(net, x, y)
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class PairTables:
    """The network with its filters unrolled into tables of their responses to pairs of symbols."""

    def __init__(self, net: ByteNet):
        self.net = net
        self.parts = []
        for w, kernel, bias in zip(WIDTHS, net.kernels, net.biases):
            single = [net.embedding @ kernel[k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)]
            single[0] = single[0] + bias
            tables = [((single[k][:, None] + single[k + 1][None]).reshape(-1, FILTERS), k, True) for k in range(0, w - 1, 2)]
            if w % 2:
                tables.append((single[w - 1], w - 1, False))
            self.parts.append((w, tables))

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Rows of symbols to rows of log-probabilities."""
        out = []
        for at in range(0, len(windows), WINDOWS_AT_ONCE):
            x = windows[at : at + WINDOWS_AT_ONCE]
            pairs = x[:, :-1].astype(np.int32) * SYMBOLS + x[:, 1:]
            pooled = []
            for w, tables in self.parts:
                places = x.shape[1] - w + 1
                response = None
                for table, offset, paired in tables:
                    found = table.take((pairs if paired else x)[:, offset : offset + places], axis=0)
                    response = found if response is None else np.add(response, found, out=response)
                pooled.append(response.max(axis=1))
            logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.net.dense + self.net.shift
            logits -= logits.max(axis=1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        languages, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
        if not known:
            return languages, scores
        data = [np.frombuffer(texts[i].encode("utf-8", "replace"), np.uint8) for i in known]
        counts = np.array([-(-len(d) // WINDOW) for d in data])
        windows = np.zeros((int(counts.sum()), WINDOW), np.uint8)
        filled = np.full(len(windows), WINDOW, np.float64)
        flat, at = windows.reshape(-1), 0
        for d, n in zip(data, counts):
            flat[at * WINDOW : at * WINDOW + len(d)] = FOLD[d]
            at += int(n)
            filled[at - 1] = len(d) - (n - 1) * WINDOW
        logs = self.log_probabilities(windows) * filled[:, None]
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(logs, starts, axis=0) / np.add.reduceat(filled, starts)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for k, i in enumerate(known):
            languages[i], scores[i] = self.net.languages[best[k]], p[k, best[k]]
        return languages, scores


def training_sample(docs: DataFrame, texts_a_language: int = TEXTS_A_LANGUAGE) -> list[tuple[str, str]]:
    """A bounded sample ``(lang, part of a text)`` from labelled rows outside the held-out fold.

    Rows are chosen by a hash of their id, at a rate that each language's count sets, and each language has
    one row at least. No language is left out; about 1.3 times ``SAMPLE_TEXTS`` parts of ``SAMPLE_CHARS``
    characters reach the driver at most, or one a language where there are more languages than that.
    """
    labelled = docs.filter((fold() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    labelled = labelled.filter(has_letter(F.col("text")))
    counts = materialize(labelled.groupBy("lang").agg(F.count("*").alias("count"), F.min(_draw()).alias("least")), "language-counts")
    many = counts.count()
    if not many:
        return []
    wanted = max(1, min(texts_a_language, SAMPLE_TEXTS // many))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    part = labelled.select("lang", "doc_id", F.substr("text", place, F.lit(SAMPLE_CHARS)).alias("part"))
    rates = counts.select("lang", F.greatest(F.least(F.lit(1.0), 1.3 * wanted / F.col("count")), F.col("least")).alias("rate"))
    chosen = part.join(F.broadcast(rates) if many <= SAMPLE_TEXTS else rates, "lang").filter(_draw() <= F.col("rate")).filter(has_letter(F.col("part")))
    ranked = chosen.select("lang", "part", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(_draw(), "doc_id", "part")).alias("rank"))
    rows = ranked.filter(F.col("rank") <= int(1.3 * wanted) + 1).collect()
    return [(r["lang"], r["part"]) for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["part"]))]


def predict_language(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row and column of ``docs``; a narrow map over whole texts."""
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in blocks(texts):
                languages, scores = tables.predict(texts[a:b]) if tables else ([UNDETERMINED] * (b - a), np.zeros(b - a))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*(f"`{n}`" for n in names)).mapInArrow(run, schema)


def has_letter(text: Column) -> Column:
    """Whether a text has a letter; numbers of any form are none."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _draw() -> Column:
    """A number from 0 to 1 from a row's id."""
    return F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) / (1 << 30)


def fit(docs: DataFrame) -> ByteNet | None:
    return train(training_sample(docs))
