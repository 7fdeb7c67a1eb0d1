"""Fourier spectra of segments of any length.

Segments that fit a task are transformed where their rows lie, equal lengths together. A longer segment becomes a
convolution with a chirp, so that its length may be any number, and the power-of-two transforms of that
convolution are cut in two: rows are grouped by the remainder of their index, then by the remainder of the
frequency, and back. Groups hold about the square root of the padded length, so no task holds a segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.ordered import SLICE_US, row_index
from sensorloom.session import materialize

SEGMENT_KEYS = ("device", "event_us", "segment")
#: Rows of a segment that one task transforms.
TASK_ROWS = 65_536


def segment_fft(
    rows: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = SEGMENT_KEYS,
    us: str = "us",
    tie: Sequence[str] = (),
    slice_us: int = SLICE_US,
    k_max: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Magnitudes of all Fourier coefficients up to half the rows: ``keys, column, k, fft_abs, n_rows``.

    NULL values count as 0; ``k_max`` leaves higher coefficients out of the result. Results do not depend on
    ``task_rows``, rounding aside.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{j}") for j, c in enumerate(columns)]
    indexed = materialize(row_index(rows, "_i", keys, us, tie, slice_us).join(sizes, list(keys)).select(*keys, "n_rows", F.col("_i").cast("long").alias("_i"), *values), "indexed")
    found = _local(indexed.filter(F.col("n_rows") <= task_rows), keys, len(columns))
    if not indexed.filter(F.col("n_rows") > task_rows).isEmpty():
        found = found.unionByName(_chirp(indexed.filter(F.col("n_rows") > task_rows), keys, len(columns)))
    names = F.array(*[F.lit(c) for c in columns])
    spectrum = found.select(*keys, "n_rows", F.posexplode("_abs").alias("_c", "fft_abs"), "k")
    if k_max is not None:
        spectrum = spectrum.filter(F.col("k") <= k_max)
    return spectrum.select(*keys, "n_rows", names[F.col("_c")].alias("column"), "k", "fft_abs")


def dominant_frequency(
    spectrum: DataFrame, rate_hz: float, samples: int | None = None, keys: Sequence[str] = SEGMENT_KEYS, slack: float = 1e-9
) -> DataFrame:
    """Frequency of the strongest coefficient per segment and column; the lowest of those within ``slack`` of it."""
    each = [*keys, "column", "n_rows"]
    most = spectrum.groupBy(*each).agg(F.max("fft_abs").alias("_most"))
    near = spectrum.join(most, each).filter(F.col("fft_abs") >= F.col("_most") * (1 - slack))
    n = F.col("n_rows") if samples is None else F.lit(samples)
    return near.groupBy(*each).agg(F.min("k").alias("_k")).select(*keys, "column", (F.col("_k") * F.lit(float(rate_hz)) / n).alias("dominant_hz"))


def _key_types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)


def _local(rows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Whole segments as consecutive rows of a task; all of one length in one call."""
    names = [*keys, "n_rows", "_i", *[f"_x{j}" for j in range(width)]]
    dealt = rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, "_i")

    def transform(table: pa.Table) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(table.column("_i").to_numpy() == 0)
        sizes = table.column("n_rows").to_numpy()[heads]
        x = np.stack([table.column(f"_x{j}").to_numpy() for j in range(width)], axis=1)
        for n in np.unique(sizes):
            own = heads[sizes == n]
            strength = np.abs(np.fft.rfft(x[own[:, None] + np.arange(n)], axis=1))  # segments, coefficients, columns
            m = strength.shape[1]
            picked = table.select([*keys, "n_rows"]).take(pa.array(np.repeat(own, m))).combine_chunks()
            lists = pa.FixedSizeListArray.from_arrays(pa.array(strength.ravel()), width).cast(pa.list_(pa.float64()))
            yield from pa.table([*picked.columns, pa.array(np.tile(np.arange(m), len(own)), pa.int64()), lists], names=[*keys, "n_rows", "k", "_abs"]).to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in filter(len, batches):
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = int(np.flatnonzero(held.column("_i").to_numpy() == 0)[-1])
            complete = len(held) - last == held.column("n_rows")[last].as_py()
            ready, held = (held, None) if complete else (held.slice(0, last), held.slice(last))
            if len(ready):
                yield from transform(ready)

    return dealt.mapInArrow(run, f"{_key_types(rows, keys)}, n_rows long, k long, _abs array<double>")


def _chirp_at(i: np.ndarray, n: int) -> np.ndarray:
    """exp(-pi sqrt(-1) i^2 / n), the square reduced in whole numbers."""
    return np.exp(-1j * math.pi * ((i.astype(np.int64) ** 2) % (2 * n)) / n)


def _shape(n: int) -> tuple[int, int]:
    """Groups by index and their length: powers of two that hold the convolution of ``n`` values."""
    bits = max(2, (2 * n - 2).bit_length())
    return 1 << (bits // 2), 1 << (bits - bits // 2)


def _chirp(rows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The three passes of the convolution; complex values travel as pairs of doubles."""
    kinds = _key_types(rows, keys)
    bits = F.greatest(F.lit(2), F.ceil(F.log2(2 * F.col("n_rows") - 1)))
    first = F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long")

    def packed(pdf: pd.DataFrame, name: str, at: np.ndarray, values: np.ndarray, n: int) -> pd.DataFrame:
        """Rows of one group: the keys, n, the next place, and the columns' values side by side."""
        flat = np.ascontiguousarray(values).view(float).reshape(len(at), -1)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(at) for k in keys}, "n_rows": n, name: at, "_v": list(flat)})

    def unpacked(pdf: pd.DataFrame, at: str, size: int, columns: int) -> np.ndarray:
        out = np.zeros((size, columns), complex)
        out[pdf[at].to_numpy()] = np.stack(pdf["_v"].to_list()).view(complex)
        return out

    def by_index(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows whose index has one remainder: their part of the frequencies, with that of the chirp beside them."""
        n = int(pdf["n_rows"].iloc[0])
        r, m = _shape(n)
        j1 = int(pdf["_i"].iloc[0]) % r
        index = pdf["_i"].to_numpy()
        values = np.zeros((m, width + 1), complex)
        values[index // r, :width] = pdf[[f"_x{j}" for j in range(width)]].to_numpy() * _chirp_at(index, n)[:, None]
        j = r * np.arange(m) + j1
        far = np.minimum(j, r * m - j)
        values[:, width] = np.where(far < n, np.conj(_chirp_at(far, n)), 0)
        k1 = np.arange(m)
        made = np.fft.fft(values, axis=0) * np.exp(-2j * math.pi * ((j1 * k1) % (r * m)) / (r * m))[:, None]
        return packed(pdf, "_k1", k1, made, n).assign(_j1=j1)

    def by_frequency(pdf: pd.DataFrame) -> pd.DataFrame:
        """Frequencies of one remainder: multiply, and their part of the way back."""
        n, k1 = int(pdf["n_rows"].iloc[0]), int(pdf["_k1"].iloc[0])
        r, m = _shape(n)
        both = np.fft.fft(unpacked(pdf, "_j1", r, width + 1), axis=0)
        m2 = np.arange(r)
        back = np.fft.ifft(both[:, :width] * both[:, width:], axis=0) * r
        back *= np.exp(2j * math.pi * ((k1 * m2) % (r * m)) / (r * m))[:, None]
        return packed(pdf, "_m2", m2, back, n).assign(_k1=k1)

    def to_strength(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m2 = int(pdf["n_rows"].iloc[0]), int(pdf["_m2"].iloc[0])
        r, m = _shape(n)
        k = m2 + r * np.arange(m)
        strength = np.abs(np.fft.ifft(unpacked(pdf, "_k1", m, width), axis=0) / r)[k <= n // 2]
        k = k[k <= n // 2]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(k) for c in keys}, "n_rows": n, "k": k, "_abs": list(strength)})

    placed = rows.withColumn("_j1", F.col("_i") % first)
    half = placed.groupBy(*keys, "_j1").applyInPandas(by_index, f"{kinds}, n_rows long, _k1 long, _v array<double>, _j1 long")
    turned = half.groupBy(*keys, "_k1").applyInPandas(by_frequency, f"{kinds}, n_rows long, _m2 long, _v array<double>, _k1 long")
    return turned.groupBy(*keys, "_m2").applyInPandas(to_strength, f"{kinds}, n_rows long, k long, _abs array<double>")
