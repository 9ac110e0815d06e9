"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a built-in lexicon by kind, densities and weights of a lexicon
learned from the training rows (words and word beginnings that toxic rows hold far more often), the
nearness of hits to the second person, capitals, punctuation, elongation and obfuscation rates. Trees
are fitted on binned features with logistic loss; out-of-fold margins are calibrated by pool adjacent
violators. A training row's own label is taken out of the learned lexicon's counts before its
features are formed, so the trees see the lexicon as a new text would.

Cases: null counts as the empty text and is scored like any other; very long texts are counted whole, a
bounded block at a time; repeated rows get equal scores; labels are the greatest of a doc_id's rows,
null labels are left out; without labels of both kinds every score is the share of toxic labels (0 if
there are none); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import blocks, fold, materialize

# The built-in lexicon, lower case, by kind.
INSULTS = frozenset("idiot idiots moron morons stupid dumb fool fools loser losers clown clowns trash garbage scum filth filthy pathetic worthless useless disgusting ugly creep coward liar pig rat vermin imbecile dimwit jerk freak ignorant lowlife parasite".split())
PROFANITY = frozenset("damn hell crap shit shitty bullshit fuck fucking fucker bitch bastard ass asshole dick piss merde putain connard salope con idiota imbécil mierda puta cabrón estúpido basura dummkopf idiot arschloch scheiße blöd trottel abschaum".split())
THREATS = frozenset("kill die dead hurt destroy beat hang shoot burn crush suffer punish rape attack".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes tú ti tus".split())
#: Letters that stand for others in disguised words.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"[0-9@$!]*[^\W\d_]+(?:[0-9@$!]+[^\W\d_]+)+")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
FEATURES = [
    "log_words", "insult_rate", "insult_log", "profanity_rate", "threat_rate", "learned_rate", "learned_log", "learned_top", "learned_mean",
    "second_rate", "nearest_second", "near_second_share", "capital_rate", "shout_rate", "exclaim_rate", "question_rate", "mark_rate",
    "digit_rate", "stretched_rate", "disguised_rate", "disguised_hits", "other_script_rate", "distinct_rate", "word_length",
]
#: Bounds: labelled rows that training uses, terms of the learned lexicon, lengths of word beginnings.
TRAINING_ROWS, LEARNED_TERMS, BEGINNINGS = 12_000, 4000, (3, 4, 5, 6, 7)
#: Toxic rows that must hold a term, and the log-odds it needs.
LEAST_ROWS, LEAST_WEIGHT = 3, 2.0
NEAR = 6


def terms_of(words: set[str]) -> set[str]:
    """Words and their marked beginnings."""
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


@dataclass
class Lexicon:
    """Rows of each kind that hold a term, and the rows of each kind."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    toxic: int = 0
    clean: int = 0

    def weight(self, term: str, own: int | None = None) -> float:
        """Log-odds of a term, 0 if too rare or weak; ``own``: the label of a row to leave out."""
        found = self.counts.get(term)
        if not found:
            return 0.0
        t, n, toxic, clean = *found, self.toxic, self.clean
        if own == 1:
            t, toxic = t - 1, toxic - 1
        elif own == 0:
            n, clean = n - 1, clean - 1
        if t < LEAST_ROWS:
            return 0.0
        w = math.log((t + 0.5) / (toxic + 1)) - math.log((max(n, 0) + 0.5) / (max(clean, 0) + 1))
        return w if w >= LEAST_WEIGHT else 0.0


def text_features(text: str, lexicon: Lexicon, own: int | None = None, memo: dict[str, float] | None = None) -> list[float]:
    """The values of :data:`FEATURES` for one whole text."""
    out = dict.fromkeys(FEATURES, 0.0)
    lower = text.lower()
    words = WORD.findall(lower)
    n = len(words)
    counts = Counter(words)
    learned: dict[str, float] = {}
    for w in counts:
        if memo is not None and own is None and w in memo:
            best = memo[w]
        else:
            best = max([lexicon.weight(w, own), *(lexicon.weight(w[:k] + "*", own) for k in BEGINNINGS if len(w) > k)])
            if memo is not None and own is None:
                memo[w] = best
        if best:
            learned[w] = best
    kinds = {kind: {w for w in kind if w in counts} for kind in (INSULTS, PROFANITY, THREATS, SECOND_PERSON)}
    total = {kind: sum(counts[w] for w in kinds[kind]) for kind in kinds}
    n1 = max(n, 1)
    out["log_words"] = math.log1p(n)
    out["insult_rate"], out["insult_log"] = total[INSULTS] / n1, math.log1p(total[INSULTS])
    out["profanity_rate"], out["threat_rate"], out["second_rate"] = total[PROFANITY] / n1, total[THREATS] / n1, total[SECOND_PERSON] / n1
    hits = sum(counts[w] for w in learned)
    out["learned_rate"], out["learned_log"] = hits / n1, math.log1p(hits)
    if learned:
        out["learned_top"] = max(learned.values())
        out["learned_mean"] = sum(learned[w] * counts[w] for w in learned) / hits
    marked = kinds[INSULTS] | kinds[PROFANITY] | set(learned)
    if marked and kinds[SECOND_PERSON]:
        kind = np.fromiter(((w in marked) + 2 * (w in SECOND_PERSON) for w in words), np.int8, n)
        at, you = np.flatnonzero(kind & 1), np.flatnonzero(kind & 2)
        right = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(right, len(you) - 1)]), np.abs(at - you[np.maximum(right - 1, 0)]))
        out["nearest_second"], out["near_second_share"] = 1 / (1 + float(gap.min())), float((gap <= NEAR).mean())
    data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    capitals, letters, size = int(data[65:91].sum()), int(data[65:91].sum() + data[97:123].sum()), max(int(data.sum()), 1)
    out["capital_rate"] = capitals / max(letters, 1)
    if capitals > 1:
        out["shout_rate"] = sum(w.isupper() for w in WORD.findall(text) if len(w) > 2) / n1
    out["exclaim_rate"], out["question_rate"] = data[33] / n1, data[63] / n1
    out["mark_rate"], out["digit_rate"] = int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum()) / size, int(data[48:58].sum()) / size
    out["stretched_rate"] = sum(c for w, c in counts.items() if len(w) > 3 and STRETCHED.search(w)) / n1
    if data[48:58].sum() + data[33] + data[36] + data[64]:
        disguised = DISGUISED.findall(lower)
        out["disguised_rate"] = len(disguised) / n1
        out["disguised_hits"] = float(sum(w.translate(LOOKALIKES) in INSULTS or w.translate(LOOKALIKES) in PROFANITY for w in disguised))
    out["other_script_rate"] = int(data[128:].sum()) / size
    out["distinct_rate"] = len(counts) / n1
    out["word_length"] = sum(map(len, words)) / n1
    return [float(out[f]) for f in FEATURES]


@dataclass
class Trees:
    """Trees of fixed depth as arrays: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    base: float
    features: list[np.ndarray]
    cuts: list[np.ndarray]
    leaves: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0) -> Trees:
    """Boosted trees for labels ``y`` in 0, 1 by second-order gains on feature quantiles."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    p = min(max(y.mean(), 1e-6), 1 - 1e-6)
    model, margin = Trees(math.log(p / (1 - p)), [], [], []), np.full(len(y), math.log(p / (1 - p)))
    inner = 2**depth - 1
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-9)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best_gain = np.full(count, 1e-9)
            chosen_bin = np.full(count, width, np.int64)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - first) * width + binned[:, j]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                at = gain[:, : len(e)].argmax(axis=1)
                top = gain[np.arange(count), at]
                better = top > best_gain
                best_gain[better], chosen_bin[better] = top[better], at[better]
                feature[first : first + count][better] = j
                cut[first : first + count][better] = e[at[better]]
            left = binned[np.arange(len(y)), feature[node]] <= chosen_bin[node - first]
            node = 2 * node + 2 - left
        gs, hs = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        leaf = -rate * gs / (hs + ridge)
        margin += leaf[node - inner]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(leaf)
    return model


def isotonic(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps by pool adjacent violators: the margins where steps lie and their smoothed rates."""
    order, rate = np.argsort(margins, kind="stable"), y.mean()
    smoothed = lambda pool: (pool[0] + rate) / (pool[1] + 1)
    pools: list[list[float]] = []  # sum of labels, rows, mean margin
    for m, v in zip(margins[order].tolist(), y[order].tolist()):
        pools.append([v, 1, m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, at = pools.pop()
            top = pools[-1]
            top[2] = (top[2] * top[1] + at * n) / (top[1] + n)
            top[0], top[1] = top[0] + s, top[1] + n
    rising: list[list[float]] = []  # a small pool is drawn further towards the mean, so the smoothed rates are pooled again
    for pool in pools:
        rising.append(pool)
        while len(rising) > 1 and smoothed(rising[-2]) >= smoothed(rising[-1]):
            s, n, at = rising.pop()
            top = rising[-1]
            rising[-1] = [top[0] + s, top[1] + n, (top[2] * top[1] + at * n) / (top[1] + n)]
    return np.array([p[2] for p in rising]), np.array([smoothed(p) for p in rising])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    steps: np.ndarray
    rates: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities: the isotonic steps joined by straight lines, with a slight slope by margin to keep order."""
        if self.trees is None:
            return np.full(len(x), float(self.rates[0]))
        margin = self.trees.margin(x)
        p = np.interp(margin, self.steps, self.rates)
        return np.clip(0.995 * p + 0.005 / (1 + np.exp(-margin)), 0, 1)


def fit_model(rows: list[tuple[int, list[float]]], lexicon: Lexicon, folds: int = 3) -> Model:
    """Trees on all rows; calibration on margins of rows that the trees of another fold have not seen."""
    y = np.array([label for label, _ in rows], np.float64)
    if len(y) < 2 * folds or not 0 < y.sum() < len(y):
        return Model(lexicon, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    x = np.array([f for _, f in rows])
    part = np.arange(len(y)) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        out[part == k] = boost(x[part != k], y[part != k]).margin(x[part == k])
    return Model(lexicon, boost(x, y), *isotonic(out, y))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """``(doc_id, text, toxic)`` of at most ``bound`` labelled rows outside the held-out fold, stored.

    Half the bound goes to each label first; rows are drawn by a hash of the id. Of several rows of one id
    the one whose text comes first counts, so no more than ``bound`` rows are stored and collected.
    """
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(fold() != 2)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic = min(counts.get(1, 0), bound // 2)
    room = {1: toxic, 0: bound - toxic}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) / (1 << 30)
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, 0.95 * room[1] / max(counts.get(1, 0), 1)))).otherwise(F.lit(min(1.0, 0.95 * room[0] / max(counts.get(0, 0), 1))))
    if counts.get(1, 0) <= bound // 2:
        rate = F.when(F.col("toxic") == 1, F.lit(1.0)).otherwise(rate)
    chosen = known.filter(drawn < rate).orderBy(drawn, "doc_id").limit(bound)  # the bound is proven by this limit, so the join may broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return materialize(rows, "toxicity-training")


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Counts of the terms that toxic rows hold more often; counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def drain() -> pa.RecordBatch:
            keys = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["term", "toxic", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts.update((t, toxic) for t in terms_of(set(WORD.findall((text or "").lower()))))
                counts["", toxic] += 1
                if len(counts) > 400_000:
                    yield drain()
        yield drain()

    counted = rows.select("text", "toxic").mapInArrow(run, "term string, toxic int, n bigint")
    totals = counted.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    totals = materialize(totals.filter(F.col("t") >= LEAST_ROWS), "toxicity-terms")
    whole = totals.filter("term = ''").first()
    if not whole:
        return Lexicon()
    odds = F.log((F.col("t") + 0.5) / (whole["t"] + 1)) - F.log((F.col("c") + 0.5) / (whole["c"] + 1))
    top = totals.filter("term <> ''").withColumn("odds", odds).filter(F.col("odds") >= LEAST_WEIGHT)
    found = top.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "term").limit(LEARNED_TERMS).collect()
    return Lexicon({r["term"]: (r["t"], r["c"]) for r in found}, whole["t"], whole["c"])


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Model:
    rows = training_rows(docs, labels, bound)
    lexicon = learn_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(text or "", lexicon, own=toxic) for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "toxic", "features"])

    found = rows.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, features array<double>").collect()
    ordered = sorted(found, key=lambda r: (r["doc_id"], r["features"]))
    return fit_model([(r["toxic"], r["features"]) for r in ordered], lexicon)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs``; a narrow map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in blocks(texts):
                if len(memo) > 300_000:
                    memo.clear()
                x = np.array([text_features(t, model.lexicon, memo=memo) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
