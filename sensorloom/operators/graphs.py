"""Connected components of keyed graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.session import by_sorting, materialize


def connected_components(edges: DataFrame, keys: Sequence[str], a: str = "id_a", b: str = "id_b") -> DataFrame:
    """``keys, id, root``: each node that has an edge with the smallest id of its component.

    Every round points each node to its smallest neighbour and follows the pointers, whose chains halve with each step,
    to nodes that have no smaller neighbour. Edges are drawn anew between those, at most half of the nodes, so that rounds
    shrink. Rounds are written out; only whether pointers changed and edges are left reaches the driver, and no join
    broadcasts nodes.
    """
    on = [*keys, "id"]
    left = materialize(edges.select(*keys, F.greatest(a, b).alias("id"), F.least(a, b).alias("to")), "edges")
    alone = left.filter("id = to").select(*on)
    left = left.filter("id <> to")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        rounds.append(_follow(materialize(left.groupBy(*on).agg(F.min("to").alias("root")), "pointers"), keys))
        ends = [by_sorting(rounds[-1].select(*keys, F.col("id").alias(end), F.col("root").alias(f"_{end}"))) for end in ("id", "to")]
        drawn = left.join(ends[0], on).join(ends[1], [*keys, "to"], "left").select(*keys, "_id", F.coalesce("_to", "to").alias("_to"))
        drawn = drawn.filter("_id <> _to").select(*keys, F.greatest("_id", "_to").alias("id"), F.least("_id", "_to").alias("to"))
        left = materialize(drawn.distinct(), "edges")
    if not rounds:
        return alone.distinct().withColumn("root", F.col("id"))
    found = rounds.pop()
    while rounds:  # nodes that went earlier point to nodes that went later or stayed
        onward = by_sorting(found.select(*keys, F.col("id").alias("root"), F.col("root").alias("_far")))
        first = rounds.pop()
        moved = first.join(onward, [*keys, "root"], "left").select(*on, F.coalesce("_far", "root").alias("root"))
        found = materialize(moved.unionByName(found), "labels")
    stayed = found.select(*keys, F.col("root").alias("id"))
    if not alone.isEmpty():
        stayed = stayed.unionByName(alone.join(by_sorting(found.select(*on)), on, "left_anti"))
    return materialize(found.unionByName(stayed.distinct().withColumn("root", F.col("id"))), "labels")


def _follow(pointers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``pointers(keys, id, root)`` to smaller ids, followed to ids that have none."""
    while True:
        onward = by_sorting(pointers.select(*keys, F.col("id").alias("root"), F.col("root").alias("_far")))
        stepped = pointers.join(onward, [*keys, "root"], "left").select(*keys, "id", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved"))
        stepped = materialize(stepped, "pointers")
        pointers = stepped.drop("_moved")
        if stepped.filter("_moved").isEmpty():
            return pointers
