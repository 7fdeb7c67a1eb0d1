"""The registered nearest-neighbour search where norms differ."""

import numpy as np
import pytest

from sensorloom.llm import queries, vptree


def _recall(vectors, factor, shards):
    ids = np.arange(len(vectors))
    reach = float((vectors**2).sum(axis=1).max()) * (1 + 1e-12)
    asked = ids[ids % 20 == 0]
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    got = [[] for _ in asked]
    for shard in range(shards):
        rows = ids[ids % shards == shard]
        for q, k, score in zip(*vptree.Tree(rows, vectors[rows], reach).search(asked, vectors[asked], 20, factor)):
            got[q // 20].append((-score, k))
    return np.mean([len({k for _, k in sorted(g)[:20]} & set(w)) / 20 for g, w in zip(got, want.tolist())])


def _vectors(kind, n=6000):
    rng = np.random.default_rng(8)
    units = rng.normal(size=(n, 64)) + 2 * rng.normal(size=(40, 64))[rng.integers(0, 40, n)]
    units /= np.linalg.norm(units, axis=1)[:, None]
    if kind == "heavy tail":
        return units * (1 + rng.pareto(1.5, n))[:, None]
    units[1] *= {"units": 1, "one of 3": 3, "one of 10": 10}[kind]
    return units


@pytest.mark.parametrize("shards", [1, 3])
@pytest.mark.parametrize("kind", ["units", "one of 3", "one of 10", "heavy tail"])
def test_recall_does_not_depend_on_norms(kind, shards):
    assert _recall(_vectors(kind), queries.ANN_FACTOR, shards) == 1.0
