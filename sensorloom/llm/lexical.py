"""Ranked lexical search by presence masks: a set of items against all documents.

1. Items are taken in blocks of a bounded number of terms. Documents are cut into terms once a block, and the
   counts of its terms are written with the document's length; one pass over them gives the statistics.
2. Tasks look at some thousand documents at a time. Every term has a bitmap of the documents that hold it; the
   bitmaps of an item's terms, read across, give each document's mask of matched terms, and equal masks are a group.
3. The most a mask can score is the sum of the best its terms reach in these documents. Masks are evaluated by
   descending maximum, their documents scored exactly, until no further mask can reach the worst of the
   item's best; that bound stays from one group of documents to the next. Equal maxima are evaluated, as
   ties go to the smaller id.
4. Every task hands on at most ``top`` documents an item, which Spark ranks.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z in lower case; so texts are cut
by bytes. Scores are whole numbers in 64 bits (see ``weight`` and ``Statistics.length``).

Results: null and empty texts have no term and count nowhere; rows that repeat an id are documents of their own, null
ids rank last among equals; items without terms, or whose terms no document holds, give no rows, and each item row is
an item of its own; a document scores once for a term however often the item has it; no documents or no items give no
rows. Texts are read whole; the longest text has to fit a task's memory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sensorloom.llm.common import bounded_batches, map_batches
from sensorloom.session import materialize

#: Distinct terms of a block of items; an item with more is a block of its own.
BLOCK_TERMS = 32_768
BLOCK_ITEMS = 4_096
#: Bits of the bitmaps of a group of documents, and documents in a group at most.
BITMAP_BITS = 1 << 26
GROUP_DOCS = 8_192

_LOWER = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_LOWER).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Items:
    """A block of items; ``terms`` are numbers of entries of ``vocabulary``."""

    ids: list[int | None] = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def add(self, item_id: int | None, terms: list[bytes]) -> None:
        self.ids.append(item_id)
        self.terms.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms], np.int64))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items with terms, partition by partition, in blocks of bounded size."""
    block = Items()
    for item_id, raw in items.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary")).toLocalIterator():
        terms = list(dict.fromkeys(terms_of(raw)))
        if block.ids and (len(block.ids) >= BLOCK_ITEMS or len(block.vocabulary) + len(terms) > BLOCK_TERMS):
            yield block
            block = Items()
        if terms:
            block.add(item_id, terms)
    if block.ids:
        yield block


def count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``id, n, terms, counts`` of every document with a term; ``terms`` only of the vocabulary."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch):
        known = shipped.value
        ids, sizes, held, counts = [], [], [], []
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = terms_of(raw)
            if found:
                own = [(known[t], c) for t, c in Counter(found).items() if t in known]
                ids.append(doc_id)
                sizes.append(len(found))
                held.append([t for t, _ in own])
                counts.append([c for _, c in own])
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, sizes, held, counts), kinds)], names=["id", "n", "terms", "counts"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary"))
    return map_batches(rows, run, "id long, n long, terms array<int>, counts array<int>")


@dataclass
class Statistics:
    """Documents, their terms in all, and the weight of each term."""

    documents: int
    words: int
    weights: np.ndarray

    def length(self, sizes: np.ndarray) -> np.ndarray:
        """``m`` of documents of these sizes: 100 for the mean size, 10 at least."""
        most = 90 * int(sizes.max(initial=0)) * self.documents
        exact = sizes if most < 1 << 63 else sizes.astype(object)
        return (10 + 90 * exact * self.documents // self.words).astype(np.int64)


def statistics(counted: DataFrame, terms: int) -> Statistics:
    def run(batches: Iterator[pa.RecordBatch]):
        holding = np.zeros(terms, np.int64)
        for batch in batches:
            holding += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(holding[at])], names=["term", "df"])

    documents, words = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    weights = np.zeros(terms, np.int64)
    for term, holding in counted.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        weights[term] = weight(documents, holding)
    return Statistics(documents, words or 0, weights)


class Best:
    """The best documents of every item so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * items
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * items
        self.unnamed: list[np.ndarray] = [np.empty(0, bool)] * items

    def least(self, item: int) -> int:
        """What a document has to reach."""
        return int(self.scores[item][-1]) if len(self.scores[item]) == self.top else 1

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores, ids, unnamed = (np.concatenate(p) for p in ((self.scores[item], scores), (self.ids[item], ids), (self.unnamed[item], unnamed)))
        order = np.lexsort((ids, unnamed, -scores))[: self.top]
        order = order[scores[order] > 0]
        self.scores[item], self.ids[item], self.unnamed[item] = scores[order], ids[order], unnamed[order]


def masks_of(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bits of terms by documents: the first document of every distinct mask, and each document's mask."""
    ids = np.zeros(bits.shape[1], np.int64)
    first = ids[:1]
    for k in range(0, max(1, len(bits)), 40):
        part = bits[k : k + 40].astype(np.int64)
        keys = (ids << 40) | ((np.int64(1) << np.arange(len(part), dtype=np.int64)) @ part)
        _, first, ids = np.unique(keys, return_index=True, return_inverse=True)
    return first, ids


class Group:
    """Some documents with their counts as postings, bitmaps by term, and the best each term reaches here."""

    def __init__(self, ids: np.ndarray, unnamed: np.ndarray, sizes: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, known: Statistics):
        self.ids, self.unnamed, self.ends, self.terms = ids, unnamed, ends, terms
        per_doc = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(ids)), per_doc)
        self.scores = known.weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * known.length(sizes)[doc]))
        present = np.zeros((len(known.weights), len(ids)), bool)
        present[terms, doc] = True
        self.bitmaps = np.packbits(present, axis=1)
        self.most = np.zeros(len(known.weights), np.int64)
        np.maximum.at(self.most, terms, self.scores)
        self.wanted = np.zeros(len(known.weights), bool)

    def exact(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The documents' scores for an item with these terms."""
        ends = self.ends[docs]
        sizes = ends - np.where(docs > 0, self.ends[docs - 1], 0)
        stops = np.cumsum(sizes)
        at = np.arange(stops[-1]) + np.repeat(ends - stops, sizes)
        self.wanted[terms] = True
        sums = np.concatenate([[0], np.cumsum(np.where(self.wanted[self.terms[at]], self.scores[at], 0))])
        self.wanted[terms] = False
        return sums[stops] - sums[stops - sizes]

    def search(self, item: int, terms: np.ndarray, best: Best) -> None:
        terms = terms[self.most[terms] > 0]
        most = self.most[terms]
        if most.sum() < best.least(item):
            return
        bits = np.unpackbits(self.bitmaps[terms], axis=1, count=len(self.ids))
        first, mask = masks_of(bits)
        bound = most @ bits[:, first].astype(np.int64)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        members = np.argsort(mask, kind="stable")
        stops = np.cumsum(np.bincount(mask, minlength=len(first)))
        starts = np.concatenate([[0], stops[:-1]])
        at = 0
        while at < len(order) and bound[order[at]] >= best.least(item):
            taken = [members[starts[order[at]] : stops[order[at]]]]
            room = 4 * best.top - len(taken[0])
            at += 1
            while at < len(order) and room > 0 and bound[order[at]] >= best.least(item):
                taken.append(members[starts[order[at]] : stops[order[at]]])
                room -= len(taken[-1])
                at += 1
            docs = np.concatenate(taken)
            best.offer(item, self.exact(docs, terms), self.ids[docs], self.unnamed[docs])


def _groups(batches: Iterator[pa.RecordBatch], docs: int, known: Statistics) -> Iterator[Group]:
    def flat(name: str, table: pa.Table) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy() for c in table.column(name).chunks]).astype(np.int64)

    def group(table: pa.Table) -> Group:
        ids = table.column("id")
        ends = np.cumsum(np.concatenate([c.value_lengths().to_numpy() for c in table.column("terms").chunks]), dtype=np.int64)
        return Group(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), table.column("n").to_numpy(), ends, flat("terms", table), flat("counts", table), known)

    held: list[pa.RecordBatch] = []
    for batch in filter(len, batches):
        for k in range(0, len(batch), docs):
            part = batch.slice(k, docs)
            if held and sum(map(len, held)) + len(part) > docs:
                yield group(pa.Table.from_batches(held))
                held = []
            held.append(part)
    if held:
        yield group(pa.Table.from_batches(held))


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``top`` best documents with a score above 0, for every item."""
    spark = docs.sparkSession
    out: DataFrame | None = None
    for block in item_blocks(items, item_id, item_text):
        counted = materialize(count_terms(docs, doc_id, doc_text, block.vocabulary), "lexical-counts")
        found = _search_block(counted, block, top)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _search_block(counted: DataFrame, block: Items, top: int) -> DataFrame:
    spark = counted.sparkSession
    bounded_batches(spark)
    terms = len(block.vocabulary)
    shipped = spark.sparkContext.broadcast((block.ids, block.terms, statistics(counted, terms)))
    size = min(GROUP_DOCS, max(64, BITMAP_BITS // terms))

    def run(batches: Iterator[pa.RecordBatch]):
        ids, wanted, known = shipped.value
        best = Best(len(ids), top)
        for group in _groups(batches, size, known):
            for item, own in enumerate(wanted):
                group.search(item, own, best)
        for item, item_id in enumerate(ids):
            scores = best.scores[item]
            if len(scores):
                columns = (pa.array([item] * len(scores), pa.int32()), pa.array([item_id] * len(scores), pa.int64()), pa.array(best.ids[item], mask=best.unnamed[item]), pa.array(scores))
                yield pa.RecordBatch.from_arrays(list(columns), names=["item", "item_id", "doc_id", "score"])

    found = counted.filter(F.size("terms") > 0).mapInArrow(run, "item int, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
