"""A stated set of query vectors against all vectors, in pairs of bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.session import materialize


def usable(vec_col: str) -> Column:
    """Vectors without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vec_col).isNotNull() & ~F.exists(vec_col, bad)


def keyed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``row, id, vec`` (doubles) of the usable vectors, written out; ``row`` tells rows that share an id."""
    found = df.filter(usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row keys, ids in rising order (null last), and their vectors; shorter vectors end in zeros."""
    ids = table.column("id").combine_chunks()
    lists = table.column("vec").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    flat, ends = np.asarray(lists.flatten(), dtype=float), np.asarray(lists.value_lengths(), dtype=np.int64)
    out = np.zeros((len(ids), int(ends.max()) if len(ids) else 0))
    out[np.arange(out.shape[1]) < ends[:, None]] = flat
    order = np.lexsort((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())))
    return np.asarray(table.column("row"))[order], ids.take(pa.array(order)), out[order]


def _ids_of(found: np.ndarray, rows: np.ndarray, ids: pa.Array) -> pa.Array:
    order = np.argsort(rows)
    return ids.take(pa.array(order[np.searchsorted(rows, found, sorter=order)]))


def search(queries: DataFrame, vectors: DataFrame, compare: Callable, score_type: str, top: int, *, query_rows: int = 8192, candidate_rows: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``top`` largest scores, ties to the smaller id (null last).

    ``compare(query rows, queries, candidate rows, candidates)`` gives arrays (query row, candidate row, score) with
    the best of one pair of blocks; candidates stand in the order of their ids. Block
    sizes have a bound, so memory has one, however many rows there are; rows are dealt by a hash of their own
    key, so repeated vectors and ids spread. Each pair keeps ``top`` rows a query before the merge.
    """
    spark = vectors.sparkSession
    n_queries, n = queries.count(), vectors.count()
    wide = min(spark.sparkContext.defaultParallelism, math.ceil(n / 1024))
    gq, gc = max(1, math.ceil(n_queries / query_rows)), max(1, math.ceil(n / candidate_rows), wide)
    block = lambda count, salt: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("row", "id", "vec", block(gq, 1).alias("q"), all_of(gc).alias("c"))
    right = vectors.select("row", "id", "vec", all_of(gq).alias("q"), block(gc, 2).alias("c"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        kind = pa.int64() if score_type == "long" else pa.float64()
        if not a.num_rows or not b.num_rows:
            nothing = pa.array([], pa.int64())
            return pa.table({"query_row": nothing, "query_id": nothing, "vec_id": nothing, "score": pa.array([], kind)})
        (qr, qi, qv), (cr, ci, cv) = matrix(a), matrix(b)
        width = max(qv.shape[1], cv.shape[1])
        q, c, scores = compare(qr, np.pad(qv, ((0, 0), (0, width - qv.shape[1]))), cr, np.pad(cv, ((0, 0), (0, width - cv.shape[1]))))
        return pa.table({"query_row": pa.array(q), "query_id": _ids_of(q, qr, qi), "vec_id": _ids_of(c, cr, ci), "score": pa.array(scores).cast(kind)})

    best = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(run, f"query_row long, query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
