"""Whitening, archive conversion and lexical search against brute force."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import archives, lexical, queries, whitening
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, n string"


def _brute_whitening(rows, counts=False):
    x = np.array([[math.floor(256 * c) for c in v] for v in rows])
    fit, m = np.unique(x, axis=0, return_counts=True)
    w = m if counts else np.ones(len(fit), int)
    n, sums = int(w.sum()), (fit * w[:, None]).sum(axis=0)
    centred = fit - sums / n
    e, vectors = np.linalg.eigh(centred.T @ (centred * w[:, None]) / n)
    return n, sums, x, e[::-1], vectors.T[::-1]


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_matches_numpy(spark, weights):
    rng = np.random.default_rng(5)
    spread = np.linspace(3, 0.2, 9)
    rows = [(k, (100 + rng.normal(size=9) * spread).astype(np.float32).tolist(), "a") for k in range(900)]
    rows += [(2000 + k, rows[7][1], "copy") for k in range(500)] + [(None, rows[9][1], "null id"), (7, rows[7][1], "again")]
    odd = [(5000, None, "x"), (5001, [1.0, None] + [0.0] * 7, "x"), (5002, [float("nan")] * 9, "x"), (5003, [float("-inf")] * 9, "x")]
    df = spark.createDataFrame(rows + odd, VECTORS)
    n, sums, x, e, vectors = _brute_whitening([r[1] for r in rows], weights == "count")
    got = whitening.whiten(df, components=4, weights=weights).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    by_id = {r.vec_id: r for r in got}
    for (vec_id, _, _), own in zip(rows, x):
        r = by_id[vec_id]
        want = (vectors[:4] @ (own - sums / n)) / np.sqrt(e[:4])
        assert r.n == n and r.deviation == int(((n * own - sums) ** 2).sum())
        assert np.allclose(np.abs(r.whitened), np.abs(want), atol=1e-7)
        assert np.allclose(r.explained, e[:4] / e.sum(), rtol=1e-9) and r.identity_error < 1e-8
    fit = np.unique(np.array([r.whitened for r in got]), axis=0) if weights == "one" else np.array([r.whitened for r in got])
    if weights == "count":
        assert np.allclose(np.cov(fit.T, bias=True), np.eye(4), atol=1e-8)


def test_whitening_of_odd_tables(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "b")], VECTORS)
    assert [(r.n, r.deviation, r.whitened) for r in whitening.whiten(same).collect()] == [(1, 0, [])] * 2
    assert whitening.whiten(same.limit(0)).count() == 0
    mixed = spark.createDataFrame([(1, [], "a"), (2, [1.0], "b"), (3, [2.0, 3e38], "c"), (4, [-2.0, 0.5], "d")], VECTORS)
    found = {r.vec_id: r for r in whitening.whiten(mixed).collect()}
    assert len(found) == 4 and all(r.deviation is None for r in found.values())
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], "a") for k in range(20)], VECTORS)
    found = whitening.whiten(line).collect()
    assert {len(r.whitened) for r in found} == {1} and abs(found[0].explained[0] - 1) < 1e-12


def test_registered_whitening(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, sums, x, e, vectors = _brute_whitening(list(rows.values()))
    got = queries.QUERIES["op11_whitening"](spark, SF).collect()
    assert len(got) == 4 * len(rows) and {r.component for r in got} == {1, 2, 3, 4}
    place = {k: i for i, k in enumerate(rows)}
    sign = {}
    for r in got:
        want = vectors[r.component - 1] @ (x[place[r.vec_id]] - sums / n) / math.sqrt(e[r.component - 1])
        if abs(want) > 1e-3:
            assert sign.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(want) - abs(r.whitened)) < 1e-7 and r.n == n
        assert r.deviation == int(((n * x[place[r.vec_id]] - sums) ** 2).sum())
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-8


PAGES = "page_id long, url string, html string, file int"


def _pages():
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abc é\r\n\n<>") for _ in range(n))
    big = [noise(1200) for _ in range(4)]
    rows = [(k, f"http://e.org/{k}", rng.choice([*big, noise(1500), "short", "", None, "WARC/1.1\r\n\r\n" + noise(5)]), 0) for k in range(300)]
    rows += [(None, None, big[0], 1), (None, "http://a b\n", big[0], 1), (299, "dup", big[1], 1), (299, "dup", big[1], 1), (-5, "", "x" * 400_000, 1)]
    return rows + [(900, "u", "é" * 499 + "a", 2), (901, "u", "é" * 499 + "a", 2), (902, "u", "é" * 500, 2), (903, "u", "é" * 500, 2)]


def _wanted(rows):
    last = {}
    for k, (i, _, html, _) in enumerate(rows):
        text = html or ""
        last[text] = max(last.get(text, (False, 0, -1)), (i is not None, i or 0, k))
    out = []
    for k, (i, _, html, _) in enumerate(rows):
        text = html or ""
        raw = text.encode()
        to = last[text]
        revisit = len(raw) >= 1000 and to[2] != k
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", (to[1] if to[0] else None) if revisit else None))
    return Counter(out)


def test_archives_there_and_back(spark, tmp_path):
    rows = _pages()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    for version in (1, 2):
        archives.write_arc(df, str(tmp_path / f"arc{version}"), version, key_col="page_id", url_col="url", payload_col="html")
        read = archives.read_arc(spark, [str(tmp_path / f"arc{version}")])
        assert Counter((r.key, r.url, bytes(r.payload)) for r in read.collect()) == Counter(
            (None if i is None else str(i), archives._escaped(u) if u else None, (t or "").encode()) for i, u, t, _ in rows
        )
        assert {r.version for r in read.select("version").collect()} == {version}
        archives.convert(spark, [str(tmp_path / f"arc{version}")], str(tmp_path / f"warc{version}"), archives.F.col("key").cast("long"))
        back = archives.read_warc(spark, [str(tmp_path / f"warc{version}")])
        assert back.filter("type = 'warcinfo'").count() >= 1 and back.filter("digest_ok = false OR truncated").count() == 0
        found = archives.with_targets(back.filter("type <> 'warcinfo'"))
        number = lambda s: None if s is None else int(s)
        assert Counter((number(r.key), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to)) for r in found.collect()) == _wanted(rows)
        assert back.select("record_id").distinct().count() == back.count()
        assert {r.date for r in back.filter("type <> 'warcinfo'").select("date").collect()} == {"2024-01-01T00:00:00Z"}


def test_legacy_headers(spark, tmp_path):
    v1 = archives.arc_head(1, "19960901000000") + b"\n"
    v1 += b"http://x/a b 1.2.3.4 199609010203 text/html 25\nHTTP/1.0 200 OK\n\n<p>hi</p\n"
    v1 += b"junk that is no header\n\ndns:x 0.0.0.0 19960901020304 text/dns 5\n1.2.3\n"
    v1 += b"http://x/c 1.2.3.4 19960901020305 text/plain 99\ncut off"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.arc").write_bytes(v1)
    with gzip.open(tmp_path / "a" / "two.arc.gz", "wb") as out:  # members one after another, as crawlers write them
        out.write(archives.arc_head(2, "20010101000000") + b"\n")
    with gzip.open(tmp_path / "a" / "two.arc.gz", "ab") as out:
        out.write(b"http://y/ 5.6.7.8 20010203040506 text/html 200 checksum - 300 two.arc 22\nHTTP/1.1 200 OK\r\n\r\nbye\n")
    plain = archives.read_arc(spark, [str(tmp_path / "a" / "one.arc")], whole=True).orderBy("offset").collect()
    assert [(r.url, r.ip, r.date, r.mime, bytes(r.payload), r.truncated) for r in plain] == [
        ("http://x/a b", "1.2.3.4", "19960901020300", "text/html", b"<p>hi</p", False),
        ("dns:x", "0.0.0.0", "19960901020304", "text/dns", b"1.2.3", False),
        ("http://x/c", "1.2.3.4", "19960901020305", "text/plain", b"cut off", True),
    ]
    packed = archives.read_arc(spark, [str(tmp_path / "a" / "two.arc.gz")]).collect()
    assert [(r.url, r.version, r.date, bytes(r.http), bytes(r.payload)) for r in packed] == [("http://y/", 2, "20010203040506", b"HTTP/1.1 200 OK\r\n\r\n", b"bye")]
    archives.convert(spark, [str(tmp_path / "a" / "one.arc")], str(tmp_path / "w"), archives.F.col("key"), whole=True)
    back = {r.url: r for r in archives.read_warc(spark, [str(tmp_path / "w")]).collect()}
    assert back["http://x/a b"].type == "response" and back["dns:x"].type == "resource" and back["http://x/c"].truncated
    assert back["http://x/a b"].date == "1996-09-01T02:03:00Z" and back["dns:x"].mime == "text/dns"


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    archives.write_arc(none, str(tmp_path / "arc"), key_col="page_id", url_col="url", payload_col="html")
    archives.convert(spark, [str(tmp_path / "arc")], str(tmp_path / "warc"), archives.F.col("key"))
    assert archives.with_targets(archives.read_warc(spark, [str(tmp_path / "warc")]).filter("type <> 'warcinfo'")).count() == 0


def _brute_search(docs, items, top=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    total, words = len(found), sum(sum(c.values()) for _, c in found)
    holding = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * total // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize(("group", "terms"), [(lexical.GROUP_DOCS, lexical.BLOCK_TERMS), (64, 30)])
def test_search_matches_brute_force(spark, monkeypatch, group, terms):
    monkeypatch.setattr(lexical, "GROUP_DOCS", group)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", terms)
    rng = random.Random(4)
    words = [f"W{k}" if k % 3 else f"é{k}Ü" for k in range(120)]
    text = lambda n: " ".join(words[min(119, int(rng.expovariate(0.05)))] for _ in range(n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(700)]
    docs += [(1000 + k, docs[5][1]) for k in range(200)] + [(None, docs[5][1]), (3, docs[3][1]), (3, "w1-w2"), (2000, None), (2001, "--"), (2002, "w7 " * 50_000)]
    items = [(k, text(rng.randint(1, 90))) for k in range(25)] + [(50, None), (51, "..."), (52, "nowhere else"), (1, "w1 W1 w2"), (None, "w4"), (53, docs[5][1])]
    items.append((54, " ".join(words)))  # masks of more than 64 terms
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()) == _brute_search(docs, items)


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 800)))]


@pytest.mark.parametrize("name", ["op12_warc", "op13_lexical"])
def test_registered_against_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None
