"""Language identification against a brute-force model, with many languages and odd letters."""

import math
import random
import unicodedata
from collections import Counter

import pytest

from sensorloom.llm import language


def _words(text):
    """Runs that start with a letter and go on with letters and marks."""
    out, word = [], ""
    for c in (text or "").lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (word and kind == "M"):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def _brute(labelled, texts, orders, share, smoothing=0.5):
    langs = sorted({lang for _, lang in labelled if lang})
    counts = {(lang, n): Counter() for lang in langs for n in range(orders + 1)}
    for text, lang in labelled:
        if lang:
            for w in _words(text):
                counts[lang, 0][w] += 1
                for n in range(1, orders + 1):
                    counts[lang, n].update(language.grams(w, n))
    items = [{i for lang in langs for i, _ in sorted(counts[lang, n].items(), key=lambda x: (-x[1], x[0].encode()))[:share]} for n in range(orders + 1)]
    log = lambda lang, n, i: math.log((counts[lang, n][i] + smoothing) / (sum(counts[lang, n].values()) + smoothing * (len(items[n]) + 1)))
    out = []
    for text in texts:
        words = _words(text)
        total = dict.fromkeys(langs, 0.0)
        for w in words:
            for lang in langs:
                if w in items[0]:
                    total[lang] += log(lang, 0, w)
                    continue
                for n in range(orders, 0, -1):
                    known = [g for g in language.grams(w, n) if g in items[n]]
                    if known:
                        total[lang] += sum(log(lang, n, g) for g in known) / len(known)
                        break
        best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x])) if words else "und"
        out.append((best, 1 / sum(math.exp(total[x] - total[best]) for x in langs) if words else 0.0))
    return out


@pytest.mark.parametrize("max_items", [60_000, 60])
def test_predictions_match_brute_force(spark, max_items):
    rng = random.Random(5)
    letters = {"aa": "abcdeé", "bb": "bcdfgü", "cc": "aeioux"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7)))
    labelled = [(" ".join(word(lang) for _ in range(rng.randint(0, 30))), lang) for lang in letters for _ in range({"aa": 60, "bb": 8, "cc": 20}[lang])]
    labelled += [("no language", None), (None, "aa"), ("", "bb")]
    texts = [t for t, _ in labelled] + [" ".join(word(rng.choice("abc") * 2) for _ in range(9)) for _ in range(40)] + ["x" * 300 + " " + "x" * 299, "½ ² Ⅷ 12", "éte", "́"]
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(labelled)], "doc_id long, text string, lang string")
    model = language.fit(docs, orders=3, max_items=max_items)
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(asked, model).collect()}
    for k, (lang, score) in enumerate(_brute(labelled, texts, 3, max_items // 3)):
        assert got[k][0] == lang and got[k][1] == pytest.approx(score, abs=1e-4), texts[k]


def test_every_language_is_learned(spark):
    names = [f"l{k:03d}" for k in range(201)]
    own = {lang: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}{c}" for c in "mnopq"] for k, lang in enumerate(names)}
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(own[lang]) for _ in range(20)), lang) for k, lang in enumerate(names * 2 + ["l000"] * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.predict(docs, language.fit(docs)).collect()
    assert len(found) == len(rows) and all(r.lang_pred == r.lang for r in found)


def test_numbers_are_no_letters_and_columns_give_way(spark):
    docs = spark.createDataFrame([(k, "mora luno", "aa", "old") for k in range(4)] + [(9, "½ ² Ⅷ ١٢", "bb", "old"), (10, "krunk", "bb", "old")], "doc_id long, text string, lang string, lang_pred string")
    docs = docs.withColumn("_lang_text", docs.text)
    found = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    assert found[9].lang_pred == "und" and found[9].score == 0 and found[1].lang_pred == "aa" and found[10].lang_pred == "bb"
    assert found[1]._lang_text == "mora luno" and sorted(found[1].asDict()) == ["_lang_text", "doc_id", "lang", "lang_pred", "score", "text"]
