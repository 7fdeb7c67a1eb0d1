"""SimHash fingerprints and near-duplicate components by covering anchors.

A pair that differs in at most three of 64 bits differs in at most one bit of one of its two halves. The
anchors of a half are the words of a covering code: the Hamming code of length 31 with the last bit free,
which has covering radius one. Every distinct fingerprint goes to all anchors within the radius plus one of
each half (17 at most) and is at home at the nearest; the nearest anchor of either fingerprint of a close pair
holds both, so comparing the fingerprints at home with all at the same anchor finds every link.

Equal fingerprints are one node from the start. Anchors that hold many nodes are cut into blocks, and pairs of
blocks are compared apart. A block gives a spanning set of its links, not every pair. Links lose nothing:
they join all fingerprints that any chain of links joins.

Results: texts without words (null, empty, blank) have fingerprint zero and link like any other; repeated
rows repeat their result; ids that are null take part but name no component; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.common import bounded_batches, map_batches
from sensorloom.operators.graphs import connected_components
from sensorloom.session import materialize

SEED = 42
#: Differing bits that still link; the halves and their code below are made for three.
BITS = 3
#: Nodes at one anchor that are compared in one go.
BLOCK = 4096
#: Anchors up to this many nodes are compared all together.
SMALL = 32


def fingerprint(raw: bytes | None, width: int = 3) -> int:
    """The 64-bit SimHash of the shingles of ``width`` words, as an unsigned number."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[width - 1 :].tolist() if len(words) >= width else [len(text)]
    counts = np.zeros(64, np.int64)
    first = starts[:n].tolist()
    for k in range(0, n, 1 << 16):
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(first[k : k + (1 << 16)], last[k : k + (1 << 16)])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def add_fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", width: int = 3) -> DataFrame:
    """The other columns of ``df`` and the fingerprint as a long with the same 64 bits."""
    kept = [c for c in df.columns if c not in (text_col, out_col)]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{out_col}` long"])

    def run(batch: pa.RecordBatch):
        made = np.array([fingerprint(raw, width) for raw in batch.column(len(kept)).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(made)], names=[*kept, out_col])

    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("binary")), run, schema)


def _neighbours() -> np.ndarray:
    """For each syndrome of the Hamming code the bit pairs that lead to a code word, as masks (0: none)."""
    out = np.zeros((32, 15), np.uint64)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        out[s, : len(pairs)] = [(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs]
    return out


_PAIRS = _neighbours()


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, index, home)``: every anchor that each fingerprint goes to, and whether it is at home there."""
    keys, at, home = [], [], []
    every = np.arange(len(prints))
    for half in range(2):
        part = (prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        syndrome = np.zeros(len(prints), np.int64)
        for bit in range(31):
            syndrome ^= np.where((part >> np.uint64(bit)) & np.uint64(1), bit + 1, 0)
        nearest = part ^ np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))
        top = np.uint64(1 << 31)
        far = _PAIRS[syndrome]
        there = far > 0
        for key, index, own in (
            (nearest, every, True),
            (nearest ^ top, every, False),
            ((part[:, None] ^ far)[there], np.broadcast_to(every[:, None], far.shape)[there], False),
        ):
            keys.append(key | np.uint64(half << 32))
            at.append(index)
            home.append(np.full(len(index), own))
    return np.concatenate(keys).view(np.int64), np.concatenate(at), np.concatenate(home)


def _at_anchors(nodes: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        prints = np.asarray(batch.column(0)).view(np.uint64)
        key, at, home = anchors(prints)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[at].view(np.int64)), pa.array(home)], names=["key", "fp", "home"])

    return map_batches(nodes.select("fp"), run, "key long, fp long, home boolean")


def _small_links(prints: np.ndarray, home: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs in many small groups at once: each node at home against its group."""
    size = ends - starts
    group = np.repeat(np.arange(len(starts)), size)
    rows = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
    at = rows[home[rows]]
    mine = group[home[rows]]
    count = size[mine]
    left = np.repeat(at, count)
    right = np.repeat(starts[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
    near = np.bitwise_count(prints[left] ^ prints[right]) <= BITS
    near &= prints[left] != prints[right]
    return prints[left[near]], prints[right[near]]


def _block_links(prints: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between the nodes at home and all nodes of one block pair."""
    nodes, at = np.unique(prints, return_inverse=True)
    root = np.arange(len(nodes))
    for i in np.unique(at[home]):
        near = np.flatnonzero(np.bitwise_count(nodes ^ nodes[i]) <= BITS)
        roots = np.unique(root[near])
        if len(roots) > 1:
            root[np.isin(root, roots[1:])] = roots[0]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by (key, i, j); a group may reach over several batches."""
    rest: list[pa.RecordBatch] = []

    def links(table: pa.Table) -> pa.RecordBatch:
        columns = [np.asarray(table.column(n)) for n in ("key", "i", "j")]
        prints, home = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("home")).astype(bool)
        changes = np.logical_or.reduce([np.diff(c) != 0 for c in columns])
        starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
        ends = np.append(starts[1:], len(prints))
        small = (ends - starts > 1) & (ends - starts <= SMALL)
        found = [_small_links(prints, home, starts[small], ends[small])] if small.any() else []
        found += [_block_links(prints[a:b], home[a:b]) for a, b in zip(starts, ends) if b - a > SMALL]
        a = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.uint64)
        b = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(n)[batch.num_rows - 1] for n in range(3)]
        tail = np.logical_and.reduce([np.asarray(batch.column(n)) == last[n].as_py() for n in range(3)])
        cut = batch.num_rows - int(tail.sum())
        if cut:
            yield links(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
            rest = []
        elif rest and [rest[-1].column(n)[0].as_py() for n in range(3)] != [x.as_py() for x in last]:
            yield links(pa.Table.from_batches(rest))
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield links(pa.Table.from_batches(rest))


def links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links that join the distinct fingerprints ``fp`` of ``nodes`` as all links of at most three bits do."""
    bounded_batches(nodes.sparkSession)
    placed = _at_anchors(nodes)
    counts = (
        placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("homes"))
        .filter("n > 1 AND homes > 0")
        .select("key", F.ceil(F.col("homes") / BLOCK).alias("gi"), F.ceil(F.col("n") / BLOCK).alias("gj"))
    )
    counts = materialize(counts, "anchors")
    met = placed.join(counts, "key")
    slot = F.xxhash64("fp")
    small = met.filter("gi = 1 AND gj = 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home")
    # A block pair (i, j) compares the nodes at home in block i with all nodes in block j.
    large = met.filter("gj > 1")
    homes = large.filter("home").select("key", F.pmod(slot, F.col("gi")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), (F.col("gj") - 1).cast("int"))).alias("j"), "fp", "home")
    guests = large.select("key", F.explode(F.sequence(F.lit(0), (F.col("gi") - 1).cast("int"))).alias("i"), F.pmod(slot, F.col("gj")).cast("int").alias("j"), "fp", F.lit(False).alias("home"))
    blocks = small.unionByName(homes).unionByName(guests)
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def components(prints: DataFrame, id_col: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """The rows of ``prints`` (id and fingerprint) with ``component_id``, the smallest id that links reach."""
    nodes = materialize(prints.groupBy(F.col(print_col).alias("fp")).agg(F.min(id_col).alias("least")), "prints")
    joined = connected_components(links(nodes).select(F.col("a").alias("id_a"), F.col("b").alias("id_b")), [])
    rooted = nodes.join(joined.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"), "components")
    return prints.drop("component_id").join(named, F.col(print_col) == F.col("_fp")).drop("_fp")
