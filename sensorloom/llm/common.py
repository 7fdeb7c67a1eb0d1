"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Records and bytes that Spark hands to Python at once; documents may be very long, and what a batch turns into is several
#: times its size in every worker.
BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of the texts in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor`` (null for null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


#: What an operator keeps in a Python worker between tasks: one entry, dropped when another operator runs there.
_HELD: dict[str, object] = {}


def held(key: str, build: Callable[[], object]) -> object:
    """The object that this worker keeps under ``key`` (also given as ``state`` to ``map_batches``)."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, state: str | None = None) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``; ``state`` is the key of what ``fn`` holds in its worker.

    Workers serve one task after another, so memory that an earlier operator needed is given back first.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if state not in _HELD:
            _HELD.clear()
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def text_of(value: bytes | None) -> str:
    """A UTF-8 value as text; bytes that are no UTF-8 become replacement characters."""
    return "" if value is None else value.decode("utf-8", "replace")


def as_bytes(column: str) -> Column:
    """A text column as its UTF-8 bytes, so that Python decodes only where it has to."""
    return F.col(column).cast("binary").alias(column)


def bounded_sample(df: DataFrame, id_col: str, rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows, the same in every run: those with the smallest hash of their id."""
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    return df.orderBy(order, id_col).limit(rows)


#: A key that more than one in so many rows have is joined by broadcast. There are fewer such keys than this.
HOT = 200


def join_back(rows: DataFrame, table: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row of ``table`` a key, without a task that takes all rows of a common key.

    ``count_col`` says how many of the ``total`` rows have the key. Keys of over ``total / HOT`` rows, of which
    there are fewer than ``HOT``, are broadcast; the other rows are shuffled. ``count_col`` is dropped.
    """
    hot = F.broadcast(table.filter(F.col(count_col) * HOT > total).drop(count_col))
    rest = table.filter(F.col(count_col) * HOT <= total).drop(count_col)
    common = rows.join(hot, keys)
    return common.unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))
