"""Nearest neighbours by largest inner product with vantage-point trees.

One more component, the root of the largest squared length less a vector's own, turns the largest inner
product into the smallest Euclidean distance. Every shard builds a tree: a vantage point splits its rows at
the median distance, and each side keeps the range of its distances. A side is skipped when the triangle
inequality, its margin multiplied by ``factor``, says that it holds nothing nearer than the k-th best so far;
factor one, the default, is exact search. What a larger factor loses depends on the norms: one long vector puts every
query far from all rows, and half a shard is closed. Scores are sums in the order of the components, in double precision.

Results: rows whose vector is null, zero, empty or holds null or non-finite components take no part, and shorter
vectors end in zeros. Rows that share an id are each a candidate and, if the condition selects them, each a query; a query only
leaves out its own row. Equal scores go by the smaller id, null ids last; with fewer candidates than k all come
back, and an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm import blocks

LEAF = 512
#: Rows of a shard; a tree is built for each.
SHARD_ROWS = 16384


@dataclass
class Node:
    """A leaf (``rows``) or a vantage point with the distance ranges of its near and far side."""

    rows: np.ndarray
    vantage: int = -1
    near: "Node | None" = None
    far: "Node | None" = None
    near_range: tuple[float, float] = (0.0, 0.0)
    far_range: tuple[float, float] = (0.0, 0.0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed component by component so that equal vectors score equally."""
    out = np.zeros(len(a))
    for t in range(a.shape[1]):
        out += a[:, t] * b[:, t]
    return out


class Tree:
    def __init__(self, names: np.ndarray, vectors: np.ndarray, reach: float, seed: int = 1):
        """``names`` are the row keys; rows stand in the order that decides ties."""
        self.names, self.vectors, self.reach = names, vectors, reach
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.lifted = np.concatenate([vectors, np.sqrt(np.maximum(reach - squares, 0))[:, None]], axis=1)
        self.random = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(names)))

    def _build(self, rows: np.ndarray) -> Node:
        if len(rows) <= LEAF:
            return Node(rows)
        vantage = rows[self.random.integers(len(rows))]
        rest = rows[rows != vantage]
        apart = np.sqrt(((self.lifted[rest] - self.lifted[vantage]) ** 2).sum(axis=1))
        order = np.argsort(apart, kind="stable")
        rest, apart, half = rest[order], apart[order], len(rest) // 2
        return Node(
            rows[:0], int(vantage), self._build(np.sort(rest[:half])), self._build(np.sort(rest[half:])),
            (apart[0], apart[half - 1]), (apart[half], apart[-1]),
        )

    def search(self, query_names: np.ndarray, queries: np.ndarray, top: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of queries and of the rows found for them, and their scores."""
        self.query_names, self.queries, self.top, self.factor = query_names, queries, top, factor
        self.base = np.einsum("ij,ij->i", queries, queries) + self.reach
        self.scores = np.full((len(queries), top), -np.inf)
        self.found = np.full((len(queries), top), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(queries)))
        q, k = np.nonzero(self.scores > -np.inf)
        return self.query_names[q], self.names[self.found[q, k]], self.scores[q, k]

    def _offer(self, active: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Keep the best of the rows for the active queries; gives their scores, the last bits aside.

        A matrix product screens with some room for its rounding; what may enter is scored in double precision
        in the order of the components.
        """
        rough = self.queries[active] @ self.vectors[rows].T
        room = 1e-9 * (1 + self.base[active])
        q, r = np.nonzero((rough >= (self.scores[active, -1] - room)[:, None]) & (self.names[rows][None, :] != self.query_names[active][:, None]))
        if len(q):
            better, start, at, count = np.unique(q, return_index=True, return_inverse=True, return_counts=True)
            offered = np.full((len(better), count.max()), -np.inf)
            places = np.full(offered.shape, np.iinfo(np.int64).max)
            place = np.arange(len(q)) - start[at]
            offered[at, place] = products(self.queries[active[q]], self.vectors[rows[r]])
            places[at, place] = rows[r]
            better = active[better]
            every = np.concatenate([self.scores[better], offered], axis=1)
            places = np.concatenate([self.found[better], places], axis=1)
            best = np.lexsort((places, -every), axis=1)[:, : self.top]
            self.scores[better] = np.take_along_axis(every, best, axis=1)
            self.found[better] = np.take_along_axis(places, best, axis=1)
        return rough

    def _open(self, active: np.ndarray, apart: np.ndarray, side: tuple[float, float]) -> np.ndarray:
        """Which queries may still find something on a side."""
        worst = self.scores[active, -1]
        tau = np.sqrt(np.maximum(self.base[active] - 2 * worst, 0))
        margin = np.maximum(side[0] - apart, apart - side[1])
        return margin * self.factor <= tau * (1 + 1e-9) + 1e-9

    def _visit(self, node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if node.near is None:
            if len(node.rows):
                self._offer(active, node.rows)
            return
        score = self._offer(active, np.array([node.vantage]))[:, 0]
        apart = np.sqrt(np.maximum(self.base[active] - 2 * score, 0))
        first = apart <= (node.near_range[1] + node.far_range[0]) / 2
        for side, bounds, mine in ((node.near, node.near_range, first), (node.far, node.far_range, ~first), (node.near, node.near_range, ~first), (node.far, node.far_range, first)):
            chosen = np.flatnonzero(mine)
            self._visit(side, active[chosen[self._open(active[chosen], apart[chosen], bounds)]])


def search(vectors: DataFrame, queries: str, top: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``top`` nearest other rows found for every row that the SQL condition ``queries`` (on ``id``) selects."""
    each = blocks.keyed(vectors.filter(F.exists(vec_col, lambda x: x != 0)), id_col, vec_col)
    square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    reach = (each.agg(F.max(square)).first()[0] or 0.0) * (1 + 1e-12)

    def compare(query_rows, query_vectors, rows, candidates):
        return Tree(rows, candidates, reach).search(query_rows, query_vectors, top, factor)

    return blocks.search(each.filter(queries), each, compare, "double", top, candidate_rows=SHARD_ROWS)
