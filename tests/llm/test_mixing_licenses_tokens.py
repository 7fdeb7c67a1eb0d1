"""Mixing, license scans, byte-level BPE and the pipeline."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from sensorloom.llm import byte_bpe, licenses, mixing, queries
from tests.oracle import compare

ODD = [None, "", "   ", "MIT License", "the mit\n license mit license", "cc  by-NC 4.0", "Apache-License " * 3, "é" * 5000, "word " * 30_000]


@pytest.mark.parametrize("name", ["op2_topk", "op3_mixing", "op6_licenses"])
def test_queries_match_sql(spark, name):
    from tests.oracle import connect

    sf = "/root/testdata/sf0.001"
    assert compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None


def _sources(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string, copies int")


def test_mix_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(0, 60), rng.choice(["a"] * 6 + ["b", "c", "d", None]), "t", 7) for k in range(3000)]
    rows += [(k, None, "e", "t", 7) for k in range(3000, 3005)] + [rows[0]] * 3
    df = _sources(spark, rows)
    sized = df.select("doc_id", "source", mixing.word_count().alias("size"))
    targets = {r._source: r for r in mixing.source_targets(sized).collect()}
    total = sum(r.source_size for r in targets.values())
    assert sum(r.target for r in targets.values()) == pytest.approx(1.5 * total)
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in targets.values())
    taken = mixing.add_copies(sized, mixing.source_targets(sized)).collect()
    assert len(taken) == len(rows) and all(0 <= r.copies <= 2 for r in taken)
    for source, t in targets.items():
        assert abs(sum(r.copies * r["size"] for r in taken if r.source == source) - t.target) <= 120
    mixed = mixing.mix(df)
    again = mixing.add_copies(df.withColumn("size", mixing.word_count()), mixing.source_targets(sized), tie_cols=["text"])
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in again.collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_water_filling_by_rounds(spark):
    sizes = [5, 100, 7, 400, 0, 33]
    df = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, size long")
    weights, caps, total = [3.0, 1.0, 2.0] * 2, [2.0 * s for s in sizes], 1.5 * sum(sizes)
    full, want = set(), {}
    while True:
        rest = [k for k in range(6) if k not in full]
        level = (total - sum(caps[k] for k in full)) / sum(weights[k] for k in rest)
        over = [k for k in rest if weights[k] * level >= caps[k]]
        want = {k: caps[k] if k in full else weights[k] * level for k in range(6)}
        if not over:
            break
        full |= set(over)
    got = {r._source: r.target for r in mixing.source_targets(df).collect()}
    assert [got[f"s{k}"] for k in range(6)] == pytest.approx([want[k] for k in range(6)])


def test_license_scan_of_odd_texts(spark):
    con = duckdb.connect()
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "MIT License"), (None, "Licensed under the Apache License, Version 2.0.\nx")]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert compare(licenses.scan(df), con, queries.ORACLES["op6_licenses"]) is None
    assert licenses.scan(df.limit(0)).count() == 0
    clash = licenses.scan(spark.createDataFrame([(1, "mit license", "x", "y", 2)], "doc_id long, text string, labels string, key string, score int"))
    assert [tuple(r[c] for c in ("doc_id", "labels", "key", "score")) for r in clash.collect()] == [(1, "mit", "y", 1.0)]


@pytest.fixture(scope="module")
def coder():
    ranks = byte_bpe.read_ranks(queries.VOCABULARY)
    return byte_bpe.Coder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(coder):
    mine, theirs = coder
    rng = random.Random(4)
    letters = "ab !?'sèé\u0085\x1c  　\n\t0١你\U0001f600aaİK​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 500]))) for _ in range(300)]
    texts += ["a" * 5000, "ab" * 2000 + "abc" * 777, "!" * 20_000, "".join(rng.choice("abcdeth") for _ in range(5000)), "<|endoftext|>"]
    for text, ids in zip(texts, mine.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hello wörld", "z"), (3, "Hello wörld", "z")], "doc_id long, text string, ids string")
    rows = byte_bpe.encode(df, queries.VOCABULARY, public_tokenizers.PATTERN, out_col="codes", decoded_col="back").collect()
    assert [bytes(r.back).decode() for r in rows] == ["", "", "Hello wörld", "Hello wörld"] and [r.ids for r in rows] == ["x", "y", "z", "z"]
    coded = byte_bpe.encode(df.drop("ids"), queries.VOCABULARY, public_tokenizers.PATTERN)
    again = byte_bpe.decode(coded, queries.VOCABULARY, public_tokenizers.PATTERN).collect()
    assert [bytes(r.decoded) for r in again] == [bytes(r.back) for r in rows]
    assert byte_bpe.encode(df.limit(0).drop("ids"), queries.VOCABULARY, public_tokenizers.PATTERN).count() == 0


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(7)
    words = ["sun", "moon", "tree", "river", "stone", "cloud", "grass", "field", "house", "road"]
    text = lambda n=60: " ".join(rng.choice(words) + str(rng.randrange(10)) * rng.randrange(2) for _ in range(n))
    passage = text(110)
    rows = [(k, text() + (" " + passage if k in (3, 4) else ""), "en", rng.choice("ab"), 0, "e") for k in range(30)]
    rows += [(50, rows[0][1], "en", "a", 0, "e"), (51, rows[0][1], "en", None, 0, "e"), rows[1], (60, None, "en", "a", 0, "e"), (61, "", None, "a", 0, None), (62, "?! 12", "en", "b", 0, "e"), (None, text(), "en", "b", 0, "e")]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, "")
    assert known.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()} == {60, 61, 62}
    single = stages["near_copies"](spark, known, "")
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == list(range(30)) and single.count() == 31
    cut = stages["repeated_passages"](spark, single, "")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and sum(passage in texts[k] for k in (3, 4)) == 1
    assert all(texts[k] == rows[k][1] for k in range(30) if k not in (3, 4))
    assert all(r.n_chars == (len(r.text) if r.text != rows[r.doc_id][1] else 0) for r in cut.collect() if r.doc_id is not None)
    mixed = stages["mixing"](spark, cut, "")
    assert mixed.columns == docs.columns
    coded = stages["tokens"](spark, mixed, "").collect()
    assert all(bytes(r.decoded).decode() == r.text and r.n_tokens == len(r.ids) // 4 for r in coded)


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_license_notices_however_wrapped(spark):
    bsd = "# Redistribution and use in source and binary\n# forms, with or without modification,\n# are permitted provided that"
    mit = "Permission is hereby granted,\r\n * free of charge, to any\n * person obtaining a copy\n * of this software"
    scattered = " ".join(f"this pad{i} work is pad dedicated to some the public pad" if i % 9 == 0 else f"filler{i} words{i} that{i} say{i} nothing{i}" for i in range(400))
    rows = [(1, bsd), (2, "x " * 37 + mit + " y" * 333), (3, scattered.replace("public", "republic")), (4, "word " * 100_000 + mit), (5, "Released under the Kit License"), (6, "cc bK"), (7, "Mİt License")]
    rows += [(10 + k, "pad " * k + bsd + " pad" * 50) for k in range(45)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "bsd" and found[2].labels == "mit" and found[4].labels == "mit" and found[3].labels == ""
    assert {found[10 + k].labels for k in range(45)} == {"bsd"} and {found[10 + k].score for k in range(45)} == {1.0}
    assert found[6].n_base == found[7].n_base == 0
