"""Toxicity and language scores of whole queries against slow doubles: features word by word, trees node by node, filters place by place."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import language, toxicity
from tessella.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
ODD = ["", "   ", "YOU are a stupid idiot!!! sooo bad", "1d10t and st@pid you", "Plain words, no more.", "слово и ещё", "a" * 3000 + " you idiot", "?!?! 12 34", "tu es con con con", None]


def weight(lexicon, term):
    t, c = lexicon.counts.get(term, (0, 0))
    if t < toxicity.LEAST_ROWS:
        return 0.0
    w = math.log((t + 0.5) / (lexicon.toxic + 1)) - math.log((c + 0.5) / (lexicon.clean + 1))
    return w if w >= toxicity.LEAST_WEIGHT else 0.0


def features(text, lexicon):
    words = re.findall(r"[^\W\d_]+", text.lower())
    n = max(len(words), 1)
    learned = [max(weight(lexicon, w), *(weight(lexicon, w[:k] + "*") if len(w) > k else 0.0 for k in toxicity.BEGINNINGS)) for w in words]
    count = lambda kind: sum(w in kind for w in words)
    hits = [w for w in learned if w]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    marked = [i for i, w in enumerate(words) if w in toxicity.INSULTS or w in toxicity.PROFANITY or learned[i]]
    gaps = [min(abs(i - j) for j in you) for i in marked] if you else []
    data = text.encode("utf-8", "replace")
    ascii_ = lambda low, high: sum(low <= b <= high for b in data)
    capitals, small, size = ascii_(65, 90), ascii_(97, 122), max(len(data), 1)
    digits = ascii_(48, 57)
    disguised = re.findall(r"[0-9@$!]*[^\W\d_]+(?:[0-9@$!]+[^\W\d_]+)+", text.lower()) if digits + data.count(b"!") + data.count(b"$") + data.count(b"@") else []
    undone = [w.translate(toxicity.LOOKALIKES) for w in disguised]
    return [
        math.log1p(len(words)), count(toxicity.INSULTS) / n, math.log1p(count(toxicity.INSULTS)), count(toxicity.PROFANITY) / n, count(toxicity.THREATS) / n,
        len(hits) / n, math.log1p(len(hits)), max(hits, default=0.0), sum(hits) / len(hits) if hits else 0.0,
        len(you) / n, 1 / (1 + min(gaps)) if gaps else 0.0, sum(g <= toxicity.NEAR for g in gaps) / len(gaps) if gaps else 0.0,
        capitals / max(capitals + small, 1), sum(w.isupper() and len(w) > 2 for w in re.findall(r"[^\W\d_]+", text)) / n if capitals > 1 else 0.0,
        data.count(b"!") / n, data.count(b"?") / n, (ascii_(33, 47) + ascii_(58, 64) + ascii_(91, 96) + ascii_(123, 126)) / size,
        digits / size, sum(len(w) > 3 and bool(re.search(r"([^\W\d_])\1\1", w)) for w in words) / n, len(disguised) / n, float(sum(w in toxicity.INSULTS or w in toxicity.PROFANITY for w in undone)),
        sum(b > 127 for b in data) / size, len(set(words)) / n, sum(map(len, words)) / n,
    ]


def probability(model, x):
    margin = model.trees.base
    for feature, cut, leaf in zip(model.trees.features, model.trees.cuts, model.trees.leaves):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        margin += leaf[node - len(feature)]
    steps, rates = model.steps, model.rates
    k = int(np.searchsorted(steps, margin))
    p = rates[0] if k == 0 else rates[-1] if k == len(steps) else rates[k - 1] + (rates[k] - rates[k - 1]) * (margin - steps[k - 1]) / (steps[k] - steps[k - 1])
    return min(max(0.995 * p + 0.005 / (1 + math.exp(-margin)), 0.0), 1.0)


def test_toxicity_query_equals_double(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.trees is not None
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    found = {r["doc_id"]: r for r in QUERIES["op7_toxicity"](spark, SF_DIR).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        want = probability(model, features(text, model.lexicon))
        assert found[i]["score"] == pytest.approx(want, abs=1e-9) and found[i]["predicted"] == int(found[i]["score"] >= 0.3)
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd, model).collect()} == pytest.approx({i: probability(model, features(t or "", model.lexicon)) for i, t in enumerate(ODD)}, abs=1e-9)


def test_features_equal_double():
    lexicon = toxicity.Lexicon({"stupid": (9, 0), "idi*": (8, 1), "rare": (2, 0), "weak": (5, 40), "con": (7, 0)}, 20, 60)
    for text in ODD:
        assert toxicity.text_features(text or "", lexicon) == pytest.approx(features(text or "", lexicon), abs=1e-12)


def windows_of(text):
    data = [int(language.FOLD[b]) for b in text.encode("utf-8", "replace")]
    return [data[at : at + language.WINDOW] for at in range(0, len(data), language.WINDOW)]


def predicted(net, text):
    """Every filter at every place of every window, in double precision."""
    if not any(map(str.isalpha, text)):
        return language.UNDETERMINED, 0.0
    total, length = np.zeros(len(net.languages)), 0
    for own in windows_of(text):
        x = own + [0] * (language.WINDOW - len(own))
        pooled = []
        for w, kernel, bias in zip(language.WIDTHS, net.kernels, net.biases):
            rows = np.stack([net.embedding[x[at : at + w]].reshape(-1) for at in range(language.WINDOW - w + 1)]).astype(np.float64)
            pooled.append((rows @ kernel + bias).max(axis=0))
        logits = np.maximum(np.concatenate(pooled), 0) @ net.dense + net.shift
        total += (logits - logits.max() - math.log(np.exp(logits - logits.max()).sum())) * len(own)
        length += len(own)
    p = np.exp(total / length - (total / length).max())
    p /= p.sum()
    return net.languages[int(p.argmax())], float(p.max())


def test_language_query_equals_double(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    net = language.fit(docs)  # the same for the same rows
    texts = {r["doc_id"]: r["text"] or "" for r in docs.filter(F.length("text") < 4000).select("doc_id", "text").collect()}
    found = {r["doc_id"]: r for r in QUERIES["op10_language"](spark, SF_DIR).collect()}
    assert len(texts) > 100
    for i, text in texts.items():
        lang, score = predicted(net, text)
        assert found[i]["lang_pred"] == lang and found[i]["score"] == pytest.approx(score, abs=1e-4)


def test_language_stage_keeps_texts_labelled_und(spark):
    """The network learns ``und`` as any label; only texts without a letter go."""
    import corpus_pipeline

    rows = [(i, f"some english words number {'abcdefgh'[i % 8]} here", "en") for i in range(40)] + [(100 + i, f"русские слова {'абвгдежз'[i % 8]} здесь", "und") for i in range(40)]
    more = [(200, "русские слова без языка", None), (201, "12 + 3", "und"), (202, None, "und"), (203, "", "en")]
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string"), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted([r[0] for r in rows] + [200]) and all(r["lang"] for r in kept)
