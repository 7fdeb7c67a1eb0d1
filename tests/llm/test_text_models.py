"""Language, toxicity and quality on small tables: held-out accuracy and odd rows."""

import random

import pytest

from sensorloom.llm import language, quality, toxicity

ODD = [None, "", " \n\t", "12 34 !?", "é" * 50, "word " * 40_000]


def _docs(spark, texts, **more):
    rows = [(k, t, *[v[k] for v in more.values()]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in more))


@pytest.fixture(scope="module")
def tongues():
    rng = random.Random(3)
    words = {"aa": ["mora", "luno", "tisa", "pelo"], "bb": ["krunk", "stolz", "brecht", "wurm"]}
    texts, langs = [], []
    for k in range(120):
        lang = "aa" if k % 2 else "bb"
        texts.append(" ".join(rng.choice(words[lang]) for _ in range(12)))
        langs.append(lang)
    return texts, langs


def test_language_known_and_unseen_words(spark, tongues):
    texts, langs = tongues
    model = language.fit(_docs(spark, texts, lang=langs))
    found = language.predict(_docs(spark, [*texts, "morano lunotisa", "krunkstolz wurmbrecht", *ODD]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found[: len(texts)]] == langs
    assert [r.lang_pred for r in found[len(texts) : len(texts) + 2]] == ["aa", "bb"]
    assert [r.lang_pred for r in found[len(texts) + 2 : len(texts) + 6]] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in found)


def test_language_backoff_matches_brute_force(spark, tongues):
    texts, langs = tongues
    model = language.fit(_docs(spark, texts, lang=langs), orders=3)
    scorer = language.Scorer(model)
    for word in ("moranox", "stw", "q", "zzz"):
        for order in (3, 2, 1):
            rows = {g: k for k, g in enumerate(model.items[order].split("\n"))}
            known = [model.scores[order][rows[g]] for g in language.grams(word, order) if g in rows]
            if known:
                assert scorer.backoff(word) == pytest.approx(sum(known) / len(known))
                break
        else:
            assert not scorer.backoff(word).any()


def test_language_without_labels(spark):
    docs = _docs(spark, ["abc", None], lang=[None, None])
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs)).collect()} == {"und"}
    assert language.predict(docs.limit(0), language.fit(docs.limit(0))).count() == 0


def _toxic(rng, k):
    words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(40)]
    if k % 4 == 0:
        words[rng.randrange(40)] = "blorgface"
    return " ".join(words)


def test_toxicity(spark):
    rng = random.Random(5)
    docs = _docs(spark, [_toxic(rng, k) for k in range(200)])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(150)] + [(None, 1), (7, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in range(150, 200))
    odd = toxicity.score(_docs(spark, ODD, score=["x"] * len(ODD)), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_toxic_keys_match_brute_force():
    raw = toxicity.normal(b"Ab\n cd\xc3\xa9  x")
    want = {raw[i : i + n] for n in toxicity.ORDERS for i in range(len(raw) - n + 1)}
    got = set()
    for keys in toxicity.keys_of(raw):
        for key in keys.tolist():
            n = key >> 56
            got.add((key & ((1 << 8 * n) - 1)).to_bytes(n, "big") if n < 7 else (key & ((1 << 56) - 1)).to_bytes(7, "big"))
    assert got == want


def test_quality(spark):
    rng = random.Random(8)
    good = lambda: ". ".join(" ".join(rng.choice(["sun", "moon", "tree", "river", "stone"]) for _ in range(8)) for _ in range(6))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW###", "$$$"]) for _ in range(40))
    docs = _docs(spark, [good() if k % 2 else bad() for k in range(240)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)], "doc_id long, quality int")
    stats = quality.add_statistics(docs)
    model = quality.fit(stats, labels)
    got = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in range(160, 240))
    odd = quality.score(quality.add_statistics(_docs(spark, ODD)), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality.score(stats, quality.fit(stats, labels.limit(0))).collect()} == {0.0}


def test_pool_adjacent_is_monotone():
    import numpy as np

    out = quality.pool_adjacent(np.array([0.3, 0.1, 0.2, 0.9, 0.8]), np.ones(5))
    assert list(out) == pytest.approx([0.2, 0.2, 0.2, 0.85, 0.85])
