"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each document gives a row of statistics (lengths, byte classes, repetition of words, word pairs and lines).
Random Fourier features of the standardised statistics approximate a Gaussian kernel; the normal equations of
the ridge fit are summed over the partitions of a bounded, reproducible sample of labelled rows, and the
fitted values are calibrated by isotonic regression over sums in score bins.

Results: null and empty texts have statistics of zero and get a score like any other text; without labelled
rows the score is 0. Several labels of one document count as the smallest, null labels are left out. Repeated
rows repeat their result, an empty table gives no rows, texts of any length are read whole, equal fitted values share a score,
and columns named as the results give way. Statistics are made where the text is; only ids and numbers are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.common import bounded_batches, bounded_sample, map_batches
from sensorloom.session import materialize

_MARKS = b"!#$%&*|@/.,-<{=_"
N_STATS = 18 + len(_MARKS)
#: Partitions whose sums reach the driver; each sum has a fixed size.
SUM_PARTS = 8
BINS = 512


def statistics(raw: bytes | None) -> list[float]:
    """Numbers that describe a text; all zero without text."""
    raw = raw or b""
    words = raw.split()
    if not words:
        return [0.0] * N_STATS
    size, n = len(raw), len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    vocabulary = Counter(words)
    lines = raw.split(b"\n")
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    high, blank = count[128:].sum(), count[9:14].sum() + count[32]
    other = size - upper - lower - digits - high - blank
    edge = sum(not 97 <= w[0] | 32 <= 122 and w[0] < 128 for w in vocabulary)
    return [
        np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        upper / size, lower / size, digits / size, high / size, blank / size, other / size,
        len(vocabulary) / n, max(vocabulary.values()) / n, sum(map(eq, words, words[1:])) / n,
        len(set(pairwise(words))) / n, len(set(lines)) / len(lines), np.log1p(size / len(lines)), edge / len(vocabulary),
        *(np.sqrt(count[list(_MARKS)] / n)),
    ]


def add_statistics(df: DataFrame, text_col: str = "text", out_col: str = "stats") -> DataFrame:
    """The other columns of ``df`` and ``out_col``, an array of numbers for the whole text."""
    kept = [c for c in df.columns if c not in (text_col, out_col)]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{out_col}` array<double>"])

    def run(batch: pa.RecordBatch):
        rows = [np.asarray(statistics(raw), float) for raw in batch.column(len(kept)).to_pylist()]
        flat = pa.array(np.concatenate(rows))
        stats = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * N_STATS, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], stats], names=[*kept, out_col])

    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("binary")), run, schema)


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.spread, -8, 8)
        waves = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / self.waves.shape[1])
        return np.concatenate([waves, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.zeros(len(stats))
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0, 1)


def _table(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.asarray(batch.column(at).flatten()).reshape(-1, N_STATS)


def _summed(sample: DataFrame, part) -> np.ndarray:
    """Sum over partitions of ``part(stats, labels)``, an array of fixed shape for every batch."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for b in batches:
            if b.num_rows:
                here = part(_table(b, 0), np.asarray(b.column(1), dtype=float))
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["sums"])

    rows = sample.mapInArrow(run, "sums array<double>").collect()
    return np.sum([np.array(r[0]) for r in rows], axis=0)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) weighted least-squares fit."""
    blocks: list[list[float]] = []
    for value, weight in zip(values, weights):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, n = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + n]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(
    stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", stats_col: str = "stats", label_col: str = "quality", *,
    rows_per_class: int = 10_000, waves: int = 256, width: float = 1.0, ridge: float = 1e-4, seed: int = 7,
) -> Model:
    """Learn from at most ``rows_per_class`` labelled rows of each class of a table of statistics."""
    spark = stats.sparkSession
    bounded_batches(spark)
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_y"))
    size = {int(r[0]): r[1] for r in one.filter("_y in (0, 1)").groupBy("_y").count().collect()}
    ids = bounded_sample(one.filter("_y = 1"), id_col, rows_per_class).unionByName(bounded_sample(one.filter("_y = 0"), id_col, rows_per_class))
    few = F.broadcast(ids.select(F.col(id_col).alias("_id"), F.col("_y").cast("double")))
    sample = materialize(stats.join(few, F.col(id_col) == F.col("_id")).select(F.col(stats_col).alias("stats"), "_y").repartition(SUM_PARTS), "quality-sample")
    random = np.random.default_rng(seed)
    w = random.normal(size=(N_STATS, waves)) / (width * np.sqrt(N_STATS))
    phases = random.uniform(0, 2 * np.pi, waves)
    if not size or sample.isEmpty():
        none = np.empty(0)
        return Model(np.zeros(N_STATS), np.ones(N_STATS), w, phases, np.zeros(waves + 1), none, none)
    # Each class is sampled on its own: a row stands for as many labelled rows as it was drawn from.
    share = {y: size.get(y, 0) / max(1, min(size.get(y, 0), rows_per_class)) for y in (0, 1)}
    mass = lambda y: np.where(y == 1, share[1], share[0])
    moments = _summed(sample, lambda x, y: np.stack([np.full(N_STATS, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])).reshape(3, N_STATS)
    centre = moments[1] / moments[0]
    spread = np.sqrt(np.maximum(moments[2] / moments[0] - centre**2, 1e-12))
    model = Model(centre, spread, w, phases, np.zeros(waves + 1), np.empty(0), np.empty(0))

    def normal_equations(x, y):
        z = model.features(x)
        weighted = z * mass(y)[:, None]
        return np.concatenate([weighted.T @ z, (weighted.T @ y)[:, None]], axis=1)

    sums = _summed(sample, normal_equations).reshape(waves + 1, waves + 2)
    total = max(1.0, sums[-1, -2])
    model.weights = np.linalg.solve(sums[:, :-1] + ridge * total * np.eye(waves + 1), sums[:, -1])
    ends = np.linspace(-0.5, 1.5, BINS + 1)

    def binned(x, y):
        at = np.clip(np.searchsorted(ends, model.raw(x), side="right") - 1, 0, BINS - 1)
        return np.stack([np.bincount(at, mass(y), BINS), np.bincount(at, mass(y) * y, BINS), np.bincount(at, mass(y) * model.raw(x), BINS)])

    weight, ones, place = _summed(sample, binned).reshape(3, BINS)
    full = weight > 0
    model.levels = pool_adjacent(ones[full] / weight[full], weight[full])
    model.edges = np.maximum.accumulate(place[full] / weight[full])
    return model


def score(stats: DataFrame, model: Model, stats_col: str = "stats", score_col: str = "score") -> DataFrame:
    """The other columns of ``stats`` and the calibrated score (0 to 1)."""
    shipped = stats.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in stats.columns if c not in (stats_col, score_col)]
    kinds = dict(stats.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{score_col}` double"])

    def run(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(shipped.value.scores(_table(batch, len(kept))))], names=[*kept, score_col])

    return map_batches(stats.select(*[F.col(f"`{c}`") for c in kept], stats_col), run, schema)
