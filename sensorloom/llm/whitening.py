"""Whitening of embeddings by the covariance of their distinct quantised vectors.

1. Components become whole numbers ``x = floor(scale * c)``. Identical x vectors are one row with a count; Spark
   counts before it shuffles, so copies of one vector cost little.
2. The fit list weighs each distinct vector by one or by its count (``weights``). Sums per dimension are exact;
   every task adds up one centred product matrix over its rows, and Spark sums the matrices.
3. The driver decomposes the one matrix, whose size is the square of the vectors' width.
4. Each distinct vector is whitened once and joined back to its rows; vectors that very many rows share are
   joined by broadcast.

Results: rows whose vector is null or holds null or non-finite components are dropped; all others stay,
repeated rows and null ids included. Shorter vectors end in zeros, an empty vector is all zeros. Quantised
components beyond 64 bits become the nearest 64-bit number; a deviation beyond 64 bits is null. Components whose
eigenvalue is below ``RANK`` of the largest are not returned, so a table of equal vectors gives none, and an empty
table gives no rows. Eigenvectors have their largest entry positive, so reruns agree; of equal eigenvalues any
basis may come. Columns named as the results give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.llm.blocks import usable
from sensorloom.llm.common import bounded_batches, join_back, map_batches
from sensorloom.session import materialize

SCALE = 256
#: Components whose variance is smaller than this share of the largest carry rounding, not data.
RANK = 1e-11
_SAFE = 2.0**62


@dataclass
class Whitener:
    """``n`` and the exact sums of the fit list, unit eigenvectors (rows), their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def quantised(vec_col: str, scale: float = SCALE) -> Column:
    return F.transform(F.col(vec_col), lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0), np.int64)


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(float)).max()) if x.size else 0.0


def _weighted_sums(x: np.ndarray, weights: np.ndarray) -> list[int]:
    """Exact sums per dimension: in 64 bits where they fit, else in Python's integers."""
    if _largest(x) * float(weights.sum()) >= _SAFE:
        x, weights = x.astype(object), weights.astype(object)
    return [int(v) for v in weights @ x] if x.size else [0] * x.shape[1]


def apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact."""
    if n * _largest(x) + max(map(abs, sums), default=0) < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(away: np.ndarray) -> list[int | None]:
    if away.dtype != object and away.size and _largest(away) ** 2 * away.shape[1] < _SAFE:
        return (away * away).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in away.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def fit(distinct: DataFrame, width: int, components: int, weight_col: str | None = None) -> Whitener | None:
    """Learn from ``distinct`` (``x`` of ``width`` longs, and the weights); None without rows."""
    weight = F.col(weight_col) if weight_col else F.lit(1).cast("long")
    rows = distinct.select("x", weight.alias("w"))
    bounded_batches(rows.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * width
        for batch in filter(len, batches):
            part = _weighted_sums(_matrix(batch.column(0)), batch.column(1).to_numpy())
            totals = [a + b for a, b in zip(totals, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(Decimal, totals), pa.decimal128(38, 0))], names=["i", "s"])

    n = int(rows.agg(F.sum("w")).first()[0] or 0)
    if not n:
        return None
    found = rows.mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = [int(r.s) for r in sorted(found, key=lambda r: r.i)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in filter(len, batches):
            centred = apart(_matrix(batch.column(0)), n, sums).astype(float) / n
            total += centred.T @ (centred * batch.column(1).to_numpy()[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.mapInArrow(multiply, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    covariance = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        covariance[r.i, r.j] = r.v / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = np.linalg.eigh(covariance) if width else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1], vectors.T[::-1]
    kept = int(np.sum(values[:components] > RANK * max(values[0], 0))) if width else 0
    vectors = vectors[:kept]
    sign = np.sign(vectors[np.arange(kept), np.abs(vectors).argmax(axis=1)]) if kept else np.ones(0)
    return Whitener(n, sums, vectors * sign[:, None], values[:kept], float(np.trace(covariance)))


def _project(distinct: DataFrame, model: Whitener) -> DataFrame:
    """``x, m, whitened, deviation`` of every distinct vector."""
    scaled = (model.vectors / np.sqrt(model.values)[:, None]).T if len(model.values) else np.zeros((len(model.sums), 0))

    def run(batch: pa.RecordBatch):
        away = apart(_matrix(batch.column(0)), model.n, model.sums)
        white = (away.astype(float) / model.n) @ scaled
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(list(white), pa.list_(pa.float64())), pa.array(_squares(away), pa.int64())],
            names=["x", "m", "whitened", "deviation"],
        )

    return map_batches(distinct.select("x", "m"), run, "x array<long>, m long, whitened array<double>, deviation long")


def _identity_error(white: DataFrame, weight: Column, components: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    if not components:
        return 0.0
    total = F.sum(weight)
    means = white.agg(*[(F.sum(F.col("whitened")[k] * weight) / total).alias(f"m{k}") for k in range(components)]).first()
    centred = [F.col("whitened")[k] - F.lit(means[k]) for k in range(components)]
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    entries = white.agg(*[(F.sum(centred[a] * centred[b] * weight) / total).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(entries[k] - (a == b)) for k, (a, b) in enumerate(pairs))


def whiten(df: DataFrame, vec_col: str = "embedding", *, components: int = 4, scale: float = SCALE, weights: str = "one") -> DataFrame:
    """The usable rows with ``n``, ``deviation``, ``whitened``, ``explained`` (arrays by component) and ``identity_error``.

    ``n`` is the weight of the fit list: its distinct vectors (``weights="one"``) or the rows (``"count"``).
    """
    if weights not in ("one", "count"):
        raise ValueError("weights: one or count")
    added = ["n", "deviation", "whitened", "explained", "identity_error"]
    columns = [c for c in df.columns if c not in added]
    quant = df.filter(usable(vec_col)).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), quantised(vec_col, scale).alias("x"))
    least, width = quant.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != width:
        quant = quant.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    rows = materialize(quant, "whitening-rows")
    distinct = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("m")), "whitening-distinct")
    by_count = weights == "count"
    model = fit(distinct, width or 0, components, "m" if by_count else None)
    if model is None:
        model = Whitener(0, [0] * (width or 0), np.zeros((0, width or 0)), np.zeros(0), 0.0)
    white = materialize(_project(distinct, model), "whitened")
    error = _identity_error(white, F.col("m") if by_count else F.lit(1), len(model.values))
    total = white.agg(F.sum("m")).first()[0] or 0
    joined = join_back(rows, white, ["x"], "m", total)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    results = {"n": F.lit(model.n).cast("long"), "deviation": F.col("deviation"), "whitened": F.col("whitened"), "explained": shares, "identity_error": F.lit(float(error))}
    return joined.select(*[F.col("row")[c].alias(c) for c in columns], *[results[c].alias(c) for c in added])
