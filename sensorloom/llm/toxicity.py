"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 3 to 7 bytes of the lower-cased text, white space as one blank, each present or
absent. Training works on a bounded, reproducible sample of labelled rows: document counts of hashed n-grams
screen the candidates (those that stand once in a partition of the sample do not count there), exact counts choose the features, and a logistic regression is fitted on presences
scaled by the log ratio of how often a class contains the n-gram. A score is the logistic of the sum of the
weights that a whole text contains.

Results: null and empty texts score as a text without any n-gram; without labelled rows of both classes every
score is 0. Several labels of one document count as the largest; null labels are left out. Of n-grams that tell as
much the smaller keys are taken. Texts of any length are read whole, an empty table gives no rows. Repeated rows
repeat their result; other columns stay, one named as the score gives way. Only bounded samples are shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.common import bounded_batches, bounded_sample, held, map_batches
from sensorloom.session import materialize

ORDERS = (3, 4, 5, 6, 7)
BUCKET_BITS = 20
#: Bytes of a text that are looked at together; longer texts are taken in overlapping steps.
STEP = 1 << 20
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


@dataclass
class Model:
    """Sorted n-gram keys with their weights, and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float


def normal(raw: bytes | None) -> bytes:
    return b" " + _BLANKS.sub(b" ", (raw or b"").lower()).strip() + b" "


def keys_of(raw: bytes) -> Iterator[np.ndarray]:
    """Packed n-grams of each order, step by step; the order is in the highest byte."""
    longest = max(ORDERS)
    for start in range(0, len(raw), STEP):
        text = np.frombuffer(raw[start : start + STEP + longest - 1], np.uint8).astype(np.uint64)
        key = text
        for n in range(1, longest + 1):
            if n > 1:
                if len(text) < n:
                    break
                key = (key[:-1] << np.uint64(8)) | text[n - 1 :]
            if n in ORDERS:
                yield key[:STEP] | np.uint64(n << 56)


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Matcher:
    """Finds which of a set of sorted keys a text contains."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.screen = np.zeros(1 << BUCKET_BITS, bool)
        self.screen[bucket_of(keys)] = True

    def present(self, raw: bytes) -> np.ndarray:
        found = []
        for keys in keys_of(raw):
            near = keys[self.screen[bucket_of(keys)]]
            if len(near):
                at = np.searchsorted(self.keys, near)
                at[at == len(self.keys)] = 0
                found.append(at[self.keys[at] == near])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _per_partition(sample: DataFrame, count, schema: str) -> DataFrame:
    """``count(raw texts, labels)`` gives columns for the whole of a partition of the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]):
        out = count((normal(raw), y) for b in batches for raw, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[s.split()[0] for s in schema.split(", ")])

    return sample.mapInArrow(run, schema)


def _chi_square(pos: str, neg: str, positives: int, negatives: int):
    """How far the share of documents differs between the classes, against what chance would do."""
    p, n = F.col(pos) / positives, F.col(neg) / negatives
    return (p - n) * (p - n) / ((F.col(pos) + F.col(neg)) / (positives + negatives))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *,
    rows_per_class: int = 4000, candidates: int = 16384, features: int = 4096, regularisation: float = 3e-4,
) -> Model:
    """Learn from at most ``rows_per_class`` labelled documents of each class; both bounds hold at every size."""
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    ids = bounded_sample(one.filter("_y = 1"), id_col, rows_per_class).unionByName(bounded_sample(one.filter("_y = 0"), id_col, rows_per_class))
    bounded_batches(docs.sparkSession)
    few = F.broadcast(ids.select(F.col(id_col).alias("_id"), F.col("_y").cast("int")))  # two ids a class bound at most
    sample = materialize(docs.join(few, F.col(id_col) == F.col("_id")).select(F.col(text_col).cast("binary").alias("text"), "_y").repartition(8), "toxic-sample")
    size = {r[0]: r[1] for r in sample.groupBy("_y").count().collect()}
    positives, negatives = size.get(1, 0), size.get(0, 0)
    if not positives or not negatives:
        return Model(np.empty(0, np.uint64), np.empty(0), float("-inf") if not positives else float("inf"))

    def hashed(rows):
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for raw, y in rows:
            seen = [np.unique(bucket_of(k)) for k in keys_of(raw)]
            if seen:
                counts[y][np.unique(np.concatenate(seen))] += 1
        at = np.flatnonzero(counts.sum(axis=0) > 1)
        return at, counts[1][at], counts[0][at]

    kind = "bucket long, pos long, neg long"
    top = _per_partition(sample, hashed, kind).groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    chosen = [r[0] for r in top.orderBy(F.desc(_chi_square("pos", "neg", positives, negatives)), "bucket").limit(candidates).collect()]
    screen = np.zeros(1 << BUCKET_BITS, bool)
    screen[chosen] = True

    def exact(rows):
        counts: dict[int, list[int]] = {}
        for raw, y in rows:
            near = [np.unique(k[screen[bucket_of(k)]]) for k in keys_of(raw)]
            for key in np.unique(np.concatenate(near)).tolist() if near else ():
                counts.setdefault(key, [0, 0])[y] += 1
        return list(counts), [c[1] for c in counts.values()], [c[0] for c in counts.values()]

    ngrams = _per_partition(sample, exact, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = ngrams.orderBy(F.desc(_chi_square("pos", "neg", positives, negatives)), "key").limit(features).toPandas().sort_values("key")
    keys = best["key"].to_numpy().astype(np.uint64)
    if not len(keys):
        return Model(keys, np.empty(0), float(np.log(positives / negatives)))
    ratio = np.log((best["pos"].to_numpy() + 1) / (positives + 2)) - np.log((best["neg"].to_numpy() + 1) / (negatives + 2))

    def presences(rows):
        matcher, at, out = Matcher(keys), [], []
        for raw, y in rows:
            at.append(matcher.present(raw).tolist())
            out.append(y)
        return at, out

    scale = ratio.tolist()
    vector = F.udf(lambda at: Vectors.sparse(len(scale), at, [scale[i] for i in at]), VectorUDT())
    design = _per_partition(sample, presences, "at array<long>, y long").select(vector("at").alias("features"), F.col("y").cast("double").alias("label"))
    found = LogisticRegression(regParam=regularisation, standardization=False, maxIter=60).fit(materialize(design, "toxic-design"))
    return Model(keys, found.coefficients.toArray() * ratio, float(found.intercept))


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability that the label of the text is 1."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    kept = [c for c in df.columns if c != score_col]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{score_col}` double"])
    spare = "_toxic_text"
    while spare in kept:
        spare += "_"

    def run(batch: pa.RecordBatch):
        known = shipped.value
        matcher = held(name, lambda: Matcher(known.keys))
        at = batch.schema.get_field_index(spare)
        sums = np.array([known.weights[matcher.present(normal(raw))].sum() for raw in batch.column(at).to_pylist()]) + known.intercept
        with np.errstate(over="ignore"):
            scores = 1 / (1 + np.exp(-sums))
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns) if i != at] + [pa.array(scores)], names=[*kept, score_col])

    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("binary").alias(spare)), run, schema, name)
