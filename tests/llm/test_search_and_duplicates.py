"""Top-k, nearest neighbours, SimHash components and repeated passages against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sensorloom.llm import blocks, queries, simhash, suffix_dedup, topk, vptree

TEXTS = "doc_id long, text string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(1300)]
    rows += [(2000 + k, rows[20][1]) for k in range(40)]  # ties
    rows += [(3000, None), (3100, [1.0, None]), (3200, [float("nan")] * 8), (3300, [float("inf")] * 8), (3400, [0.0] * 8), (None, [1.0] * 8), (0, rows[0][1])]
    usable = [(k, v) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), usable


def _brute(rows, every, score, top):
    """The results of each query row; rows that share an id are rows of their own, null ids come last."""
    out = []
    for q, (query_id, vector) in enumerate(rows):
        if query_id is not None and query_id % every == 0:
            ranked = sorted(((-score(vector, v), k is None, k or 0, k) for c, (k, v) in enumerate(rows) if c != q), key=lambda r: r[:3])[:top]
            out.append((query_id, tuple((k, -s) for s, _, _, k in ranked)))
    return Counter(out)


def _found(df):
    """The same of a result; rows of queries that share an id are told apart by their ranks where they agree."""
    by_id = defaultdict(lambda: defaultdict(list))
    for r in df.collect():
        by_id[r.query_id][r["rank"]].append((r.vec_id, r.score))
    return by_id


def _same(df, want):
    got = _found(df)
    wanted = defaultdict(lambda: defaultdict(list))
    for (query_id, found), times in want.items():
        for rank, row in enumerate(found, 1):
            wanted[query_id][rank] += [row] * times
    order = lambda pairs: sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    assert {q: {k: order(v) for k, v in r.items()} for q, r in got.items()} == {q: {k: order(v) for k, v in r.items()} for q, r in wanted.items()}


def _product(a, b):
    total = 0.0
    for x, y in zip(a, b):  # sum() would round otherwise
        total += x * y
    return total


def test_topk_exact(spark, vectors):
    df, rows = vectors
    rows = [(k, [int(np.floor(1024 * x)) for x in map(float, v)]) for k, v in rows]
    _same(topk.search(df, "id % 100 = 0"), _brute(rows, 100, lambda a, b: sum(x * y for x, y in zip(a, b)), 10))


def test_blocks_do_not_change_results(spark, vectors):
    df, _ = vectors
    each = blocks.keyed(df, "vec_id", "embedding")
    one = blocks.search(each.filter("id % 50 = 0"), each, topk.best_of_block(10), "long", 10)
    many = blocks.search(each.filter("id % 50 = 0"), each, topk.best_of_block(10), "long", 10, query_rows=7, candidate_rows=100)
    assert _found(one) == _found(many)


def test_vptree_exact_with_factor_one(spark, vectors):
    df, rows = vectors
    _same(vptree.search(df, "id % 20 = 0", factor=1.0), _brute([(k, list(map(float, v))) for k, v in rows if any(v)], 20, _product, 20))


def test_one_id_for_all_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(100, rng.normal(size=4).tolist()) for _ in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(k, [int(np.floor(1024 * x)) for x in v]) for k, v in rows]
    _same(topk.search(df, "id % 100 = 0"), _brute(whole, 100, lambda a, b: sum(x * y for x, y in zip(a, b)), 10))
    _same(vptree.search(df, "id % 20 = 0"), _brute(rows, 20, _product, 20))


def test_components_beyond_64_bits_are_refused():
    with pytest.raises(OverflowError):
        topk.quantise(np.array([[1e17]]))
    with pytest.raises(OverflowError):
        topk.best_of_block(1)(np.array([0]), np.array([[1e12]]), np.array([1]), np.array([[1e12]]))


def test_recall_of_the_registered_search(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids, matrix = np.array(list(rows)), np.array(list(rows.values()))
    got = _found(queries.QUERIES["op7_vptree"](spark, sf))
    hits = []
    for q, found in got.items():
        scores = matrix @ rows[q]
        scores[ids == q] = -np.inf
        hits.append(len(set(ids[np.argsort(-scores)[:20]]) & {k for row in found.values() for k, _ in row}) / 20)
    assert len(got) == sum(k % 20 == 0 for k in rows) and np.mean(hits) >= 0.9


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [3.0]), (5, [])], "vec_id long, embedding array<double>")
    assert _found(vptree.search(df, "id % 20 = 0")) == {0: {1: [(20, 3.0)]}, 20: {1: [(0, 3.0)]}}
    assert topk.search(df.limit(0), "id % 100 = 0").count() == 0
    assert vptree.search(df.limit(0), "id % 20 = 0").count() == 0


def _print(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_are_those_of_spark_hashes(spark):
    texts = ["", "One", "a B c", "x y z x y z x y z w", "é ß q r"]
    for text in texts:
        assert simhash.fingerprint(text.encode()) == _print(text)
    signed = spark.range(1).selectExpr("xxhash64('a b c') AS h").first().h
    assert simhash.fingerprint(b"a b c") == signed % 2**64


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 150)]
    prints = list(base)
    for x in base[:80]:  # chains of near prints, exact copies, and one dense ball
        for _ in range(3):
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    prints += [base[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))]
    ids = rng.permutation(len(prints)).tolist()
    df = spark.createDataFrame([(i, (p + 2**63) % 2**64 - 2**63) for i, p in zip(ids, prints)], "doc_id long, fingerprint long")
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    want = {ids[i]: ids[find(i)] for i in range(len(prints))}
    assert {r.doc_id: r.component_id for r in simhash.components(df).collect()} == want


def test_blocks_of_a_crowded_anchor(spark, monkeypatch):
    rng = np.random.default_rng(6)
    prints = {int(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64))) for _ in range(500)}
    nodes = spark.createDataFrame([((p + 2**63) % 2**64 - 2**63,) for p in prints], "fp long")
    whole = simhash.links(nodes).count()
    monkeypatch.setattr(simhash, "BLOCK", 50)
    df = nodes.selectExpr("fp AS doc_id", "fp AS fingerprint")
    parts = simhash.components(df).select("component_id").distinct().count()
    monkeypatch.undo()
    assert whole and parts == simhash.components(df).select("component_id").distinct().count()


@pytest.fixture(scope="module")
def repeated():
    rng = random.Random(9)
    words = ["alpha", "beta", "gämma", "delta", "eps", "zeta"]
    passage = " ".join(rng.choice(words) for _ in range(40))
    docs = {}
    for k in range(60):
        own = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 90)))
        docs[k] = own() + (passage[rng.randint(0, 30) :] if k % 3 else "") + own()
    docs.update({100: docs[1], 101: docs[1], 102: "", 103: None, 104: "xy" * 60, 105: "z" * 100})
    return docs


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("shard_bytes", [suffix_dedup.SHARD_BYTES, 600])
def test_repeats_match_brute_force(spark, repeated, keep_first, shard_bytes):
    length = 40
    df = spark.createDataFrame(list(repeated.items()), TEXTS)
    order = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    raws = {k: (t or "").encode() for k, t in repeated.items()}
    places = defaultdict(list)
    for k in sorted(raws, key=order.get):
        for i in range(len(raws[k]) - length + 1):
            places[raws[k][i : i + length]].append((k, i))
    gone = {k: bytearray(len(r)) for k, r in raws.items()}
    for found in places.values():
        if len(found) > 1:
            for k, i in found[int(keep_first) :]:
                gone[k][i : i + length] = b"\1" * length
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, length=length, keep_first=keep_first, shard_bytes=shard_bytes).collect()}
    assert set(got) == set(raws)
    for k, raw in raws.items():
        assert bytes(got[k].kept) == bytes(x for x, g in zip(raw, gone[k]) if not g)
        assert sum(r.b - r.a for r in got[k].removed) == sum(gone[k])


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        length = rng.choice([8, 20])
        base = [bytes(rng.choice(b"abc") for _ in range(rng.randint(length, 60))) for _ in range(4)]
        parts = [p[rng.randint(0, len(p) - length) :] for p in (rng.choice(base) for _ in range(9))]
        repeats, first, borders = suffix_dedup._repeating(parts, np.ones(len(parts), int), length)
        counts = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        seen, begin = set(), 0
        for p in parts:
            for i in range(len(p) - length + 1):
                assert repeats[begin + i] == (counts[p[i : i + length]] > 1)
                assert first[begin + i] == (p[i : i + length] not in seen)
                seen.add(p[i : i + length])
            begin += len(p)


def test_no_documents(spark):
    none = spark.createDataFrame([], TEXTS)
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert simhash.components(simhash.add_fingerprints(none)).count() == 0


def test_long_repetitive_texts_and_repeated_rows(spark):
    rng = random.Random(3)
    steps = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(suffix_dedup.STEP + 1000))  # crosses a step
    rows = [(1, "a" * 1_000_000), (2, "ab" * 300_000), (3, steps), (4, "x" + steps[suffix_dedup.STEP - 300 : suffix_dedup.STEP + 300])]
    rows += [(5, "left alone " * 3)] * 40 + [(6, steps[:500])] * 400
    df = spark.createDataFrame(rows, TEXTS)
    got = {(r.doc_id, len(r.kept), tuple((s.a, s.b) for s in r.removed)) for r in suffix_dedup.remove_repeats(df).collect()}
    step = suffix_dedup.STEP
    assert got == {
        (1, 0, ((0, 1_000_000),)), (2, 0, ((0, 600_000),)), (3, step + 1000 - 1100, ((0, 500), (step - 300, step + 300))),
        (4, 1, ((1, 601),)), (5, 33, ()), (6, 0, ((0, 500),)),
    }
    assert suffix_dedup.remove_repeats(df).count() == len(rows)


def test_columns_named_as_the_results(spark):
    df = spark.createDataFrame([(1, "q" * 50, 7, "old")], TEXTS + ", kept long, removed string")
    assert [tuple(r) for r in suffix_dedup.remove_repeats(df, length=40).select("doc_id", "kept").collect()] == [(1, bytearray())]
