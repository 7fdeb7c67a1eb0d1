"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorloom.llm import archives, byte_bpe, language, lexical, licenses, mixing, quality, simhash, suffix_dedup, topk, toxicity, vptree, whitening
from sensorloom.llm.common import crc_mod
from sensorloom.session import materialize, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Pruning of the vantage-point trees: one is exact search. Larger factors lose neighbours as norms spread.
ANN_FACTOR = 1.0
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = language.fit(docs.filter(crc_mod("doc_id", 3) != 1))
    found = language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@_register
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "id % 100 = 0")


ORACLES["op2_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@_register
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    sized = materialize(docs, "mixing-sizes")
    mixed = mixing.add_copies(sized, mixing.source_targets(sized))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLES["op3_mixing"] = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS size FROM documents
), each AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
         (SUM(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, (SUM(n) OVER ())::BIGINT AS all_rows
  FROM each
), filled AS (
  SELECT *, cap * (SUM(w) OVER () - coalesce(SUM(w) OVER before, 0)) <= (total - coalesce(SUM(cap) OVER before, 0)) * w AS is_full
  FROM weighed WINDOW before AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, all_rows,
         CASE WHEN is_full THEN cap ELSE w * ((total - SUM(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
              / (SUM(w) OVER () - SUM(CASE WHEN is_full THEN w ELSE 0 END) OVER ())) END AS target
  FROM filled
), placed AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, md5(coalesce(s.doc_id::VARCHAR, '')) AS h,
         ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT % (all_rows // {mixing.BUCKET_ROWS} + 1) AS bucket
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, size, h, doc_id) AS k,
         (('0x' || substr(md5('0:' || coalesce(source, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM placed
)
SELECT doc_id, size, source_size, target, (floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT * size AS taken FROM ordered
"""


@_register
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_mod("doc_id", 5) != 0)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    found = toxicity.score(docs.withColumn("held_out", held_out), toxicity.fit(docs, labels))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_register
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = materialize(simhash.add_fingerprints(docs), "fingerprints")
    return simhash.components(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@_register
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _license_sql() -> str:
    """The scan in SQL: phrases by list positions, every window of words against every template."""

    def starts(phrase: str) -> str:
        words = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(words))
        return f"list_filter(range(greatest(len(w) - {len(words) - 1}, 0)), lambda i: {test})"

    places = ", ".join(f"{starts(p)} AS p{k}" for k, p in enumerate(licenses.PHRASES))
    every = "flatten([" + ", ".join(f"p{k}" for k in range(len(licenses.PHRASES))) + "])"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(licenses.PHRASES.values())) + "], lambda x: x IS NOT NULL)"
    templates = ", ".join(f"('{label}', string_split('{text}', ' '))" for text, label in licenses.TEMPLATES.items())
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), worded AS (
  SELECT k, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs
), based AS (
  SELECT k, doc_id, len(w)::BIGINT AS n_words, {places} FROM worded
), summed AS (
  SELECT k, doc_id, n_words, {every} AS places, {base} AS base FROM based
), windows AS (
  SELECT k, list_distinct(w[i * {licenses.STRIDE} + 1 : (i + 2) * {licenses.STRIDE}]) AS b
  FROM (SELECT k, w, unnest(range(0, 1 + greatest(ceil(len(w) / {licenses.STRIDE}.0) - 2, 0)::BIGINT)) AS i FROM worded)
), templates AS (
  SELECT label, list_distinct(words) AS words FROM (VALUES {templates}) AS v(label, words)
), found AS (
  SELECT k, label, len(list_intersect(b, words)) / len(words)::DOUBLE AS share
  FROM windows, templates WHERE len(list_intersect(b, words)) >= ceil(0.8 * len(words) - 1e-9)
), matched AS (
  SELECT k, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY k
)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
       CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM summed LEFT JOIN matched USING (k)
"""


ORACLES["op6_licenses"] = _license_sql()


@_register
def op7_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "id % 20 = 0", factor=ANN_FACTOR)


@_register
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return kept.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_register
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").filter(crc_mod("doc_id", 3) != 1)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    stats = materialize(quality.add_statistics(docs), "quality-statistics")
    found = quality.score(stats, quality.fit(stats, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_register
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs.select("doc_id", "text"), VOCABULARY, public_tokenizers.PATTERN, decoded_col="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_register
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)
    each = white.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("k")].alias("explained"), "identity_error")


@_register
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    old = F.coalesce(F.pmod("page_id", F.lit(2)) == 0, F.lit(True))
    legacy = [scratch_path(spark, f"arc-{version}") for version in (1, 2)]
    for version, own in ((1, old), (2, ~old)):
        archives.write_arc(pages.filter(own), legacy[version - 1], version, key_col="page_id", url_col="url", payload_col="html")
    path = scratch_path(spark, "warc")
    archives.convert(spark, legacy, path, F.col("key").cast("long"))
    found = archives.with_targets(archives.read_warc(spark, [path]).filter("type <> 'warcinfo'"))
    return found.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to")
    )


ORACLES["op12_warc"] = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload, row_number() OVER () AS k FROM pages
), sized AS (
  SELECT *, strlen(payload)::BIGINT AS payload_bytes, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, k) AS place,
         first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, k) AS last_id
  FROM rows
)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN last_id END AS refers_to
FROM sized
"""


@_register
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"), top=10)


ORACLES["op13_lexical"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, TERMS AS w FROM documents
), items AS (
  SELECT row_number() OVER () AS i, item_id, list_distinct(TERMS) AS w FROM benchmark
), sizes AS (
  SELECT d, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0
), totals AS (
  SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS words FROM sizes
), counts AS (
  SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS term FROM docs) GROUP BY d, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM counts, totals GROUP BY term, documents
), scored AS (
  SELECT i, item_id, doc_id, d, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // words))))::BIGINT AS score
  FROM (SELECT i, item_id, unnest(w) AS term FROM items) JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (d), totals GROUP BY i, item_id, doc_id, d
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, d)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""".replace(
    "TERMS",
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')",
)
