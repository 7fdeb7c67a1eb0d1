"""Exact top-k search by inner product over integer vectors, term at a time.

The components of the candidates are postings: for every term (dimension) the candidates that have it and
their weights. Each term of the queries scatters its weighted postings into dense score arrays; then the k-th
largest score of every query is found by partition, and what reaches it is kept. Blocks are merged by Spark.

Results: rows whose vector is null or holds null or non-finite components take no part; an empty vector scores 0 with
all, and shorter vectors end in zeros. Rows that share an id are each a candidate and, if the condition selects them, each
a query; a query only leaves out its own row. Null ids are candidates, last among equals. With fewer candidates than k
all come back, and an empty table gives no rows. Components of 2^53 and more, and sums beyond 64 bits, are refused
with an error by ``quantise`` and ``best_of_block`` rather than wrapped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sensorloom.llm import blocks

#: Queries whose dense scores are held at once.
AT_ONCE = 256


def quantise(vectors: np.ndarray) -> np.ndarray:
    scaled = np.floor(1024 * vectors)
    if scaled.size and np.abs(scaled).max() >= 2.0**63:
        raise OverflowError("a component times 1024 does not fit into 64 bits")
    return scaled.astype(np.int64)


def best_of_block(top: int):
    def compare(query_rows, queries, rows, candidates):
        weights, terms = quantise(candidates), quantise(queries)
        if weights.size and float(np.abs(weights.astype(float)).max()) * float(np.abs(terms.astype(float)).max(initial=0)) * weights.shape[1] >= 2.0**63:
            raise OverflowError("scores do not fit into 64 bits")
        postings = [np.flatnonzero(weights[:, t]) for t in range(weights.shape[1])]
        found = []
        for start in range(0, len(query_rows), AT_ONCE):
            part = terms[start : start + AT_ONCE]
            scores = np.zeros((len(part), len(rows)), np.int64)
            for t, holders in enumerate(postings):
                users = np.flatnonzero(part[:, t])
                if not len(users) or not len(holders):
                    continue
                if len(holders) == len(rows):
                    for u in users:
                        scores[u] += part[u, t] * weights[:, t]
                else:
                    for u in users:
                        scores[u, holders] += part[u, t] * weights[holders, t]
            for q, score in enumerate(scores, start):
                others = np.flatnonzero(rows != query_rows[q])
                own = score[others]
                if len(own) > top:
                    least = np.partition(own, len(own) - top)[len(own) - top]
                    keep = np.flatnonzero(own >= least)
                    keep = keep[np.lexsort((others[keep], -own[keep]))][:top]
                else:
                    keep = np.arange(len(own))
                found.append((np.full(len(keep), query_rows[q]), rows[others[keep]], own[keep]))
        return tuple(np.concatenate(c) for c in zip(*found))

    return compare


def search(vectors: DataFrame, queries: str, top: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``top`` best other rows of every row that the SQL condition ``queries`` (on ``id``) selects."""
    each = blocks.keyed(vectors, id_col, vec_col)
    return blocks.search(each.filter(queries), each, best_of_block(top), "long", top)
