"""Quality and toxicity models against plain computations over all rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import quality, toxicity


def _stats(text):
    """The statistics by their definitions, one character or word at a time."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * quality.N_STATS
    share = lambda test: sum(map(test, raw)) / len(raw)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / len(sizes)
    upper, lower, digit = share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122), share(lambda c: 48 <= c <= 57)
    high, blank = share(lambda c: c > 127), share(lambda c: c in b" \t\n\v\f\r")
    lines, known = raw.split(b"\n"), Counter(words)
    letter = lambda w: 97 <= w[0] <= 122 or 65 <= w[0] <= 90 or w[0] > 127
    return [
        math.log(1 + len(raw)), math.log(1 + len(words)), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)), math.log(1 + max(sizes)),
        upper, lower, digit, high, blank, 1 - upper - lower - digit - high - blank,
        len(known) / len(words), max(known.values()) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words),
        len(set(zip(words, words[1:]))) / len(words), len(set(lines)) / len(lines), math.log(1 + len(raw) / len(lines)), sum(not letter(w) for w in known) / len(known),
        *[math.sqrt(raw.count(bytes([m])) / len(words)) for m in quality._MARKS],
    ]


def test_statistics_by_definition():
    for text in ["One two, TWO two\nthree 3! é", "  a\n\na b a b", "<<x>> 42 %% \r\n\tend.", "", None, " \n", "solo"]:
        assert quality.statistics((text or "").encode()) == pytest.approx(_stats(text), abs=1e-12)


def _texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    texts = []
    for k in range(300):
        words = [word() for _ in range(rng.randint(3, 60))]
        if k % 3 == 0:
            words += ["!!" if rng.random() < 0.7 else word() for _ in range(8)]
        texts.append(" ".join(words))
    labels = [int(k % 3 != 0) if rng.random() < 0.9 else int(k % 3 == 0) for k in range(300)]
    return texts, labels


def test_quality_model_over_all_rows(spark):
    texts, y = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stats = quality.add_statistics(docs)
    model = quality.fit(stats, spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int"), waves=40)
    x, y = np.array([_stats(t) for t in texts]), np.array(y, float)
    centre, spread = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-12))
    z = np.cos(np.clip((x - centre) / spread, -8, 8) @ model.waves + model.phases) * math.sqrt(2 / 40)
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    weights = np.linalg.solve(z.T @ z + 1e-4 * len(z) * np.eye(41), z.T @ y)
    raw = z @ weights
    assert np.allclose(model.raw(x), raw, atol=1e-6)
    at = np.clip(np.searchsorted(np.linspace(-0.5, 1.5, quality.BINS + 1), raw, side="right") - 1, 0, quality.BINS - 1)
    bins = sorted(set(at))
    w = np.array([(at == b).sum() for b in bins], float)
    m = np.array([y[at == b].mean() for b in bins])
    mean = lambda i, j: (w[i : j + 1] * m[i : j + 1]).sum() / w[i : j + 1].sum()
    levels = [max(min(mean(i, j) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]  # the isotonic fit by its definition
    places = [raw[at == b].mean() for b in bins]
    want = np.clip(np.interp(raw, places, levels), 0, 1)
    got = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    assert np.allclose([got[k] for k in range(300)], want, atol=1e-4)


def test_quality_of_no_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words", "old", 3)], "doc_id long, text string, score string, stats int")
    stats = quality.add_statistics(docs)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score(stats, quality.fit(stats, labels)).columns == ["doc_id", "score"]
    none = quality.add_statistics(docs.limit(0))
    assert quality.score(none, quality.fit(none, labels)).count() == 0


def _grams(text):
    raw = " ".join((text or "").lower().split()).encode()
    raw = b" " + raw + b" "
    return {raw[i : i + n] for n in toxicity.ORDERS for i in range(len(raw) - n + 1)}


def _key(gram):
    key = 0
    for byte in gram:
        key = (key << 8) | byte
    return key & ((1 << 56) - 1) | len(gram) << 56 if len(gram) < 8 else None


def test_toxicity_model_over_all_rows(spark):
    texts, labels = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = 60
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"), features=size)
    sets = [_grams(t) for t in texts]
    pos, neg = Counter(), Counter()
    for grams, y in zip(sets, labels):
        (pos if y else neg).update(grams)
    p, n = sum(labels), len(labels) - sum(labels)
    differs = lambda g: (pos[g] / p - neg[g] / n) ** 2 / ((pos[g] + neg[g]) / (p + n))
    ranked = sorted(((differs(g), _key(g), g) for g in {*pos, *neg}), key=lambda r: (-r[0], r[1]))[:size]
    least = ranked[-1][0]
    # The screen leaves out what stands once in a partition of the sample, so only commoner n-grams are sure.
    sure = {k for d, k, g in ranked if d > least + 1e-12 and pos[g] + neg[g] > 16}
    assert len(sure) > 20 and sure <= set(model.keys.tolist()) and len(model.keys) == size
    gram_of = {k: g for _, k, g in ((0, _key(g), g) for g in {*pos, *neg})}
    chosen = [gram_of[k] for k in model.keys.tolist()]
    ratio = np.array([math.log((pos[g] + 1) / (p + 2)) - math.log((neg[g] + 1) / (n + 2)) for g in chosen])
    x = np.array([[g in grams for g in chosen] for grams in sets]) * ratio
    beta = model.weights / ratio
    assert np.allclose(model.weights[ratio == 0], 0)
    odds = x @ beta + model.intercept
    slope = 1 / (1 + np.exp(-odds)) - np.array(labels)
    assert np.abs(x.T @ slope / len(x) + 3e-4 * beta).max() < 2e-3 and abs(slope.mean()) < 2e-3  # the minimum of the stated loss
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], 1 / (1 + np.exp(-odds)), atol=1e-9)


def test_toxicity_without_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
