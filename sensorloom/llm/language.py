"""Language identification: known words first, shorter and shorter character n-grams for the rest.

Training counts words and the n-grams of words per language on a bounded, reproducible sample of labelled
rows. Words start with a letter and go on with letters and combining marks. A known word scores the log frequency it has
in each language. An unseen word scores the mean log frequency of its longest n-grams of which any is known, and
falls back from the longest order to single letters. A document sums the scores of its words; ties go to the
smallest language name.

Every language value is learned. The model's size is shared among them: each language brings its own commonest words and
n-grams of each order, so common languages do not push out the words of rare ones.

Results: a text that is null, empty or without letters gives ``und`` and score 0; so does every text when
no row is labelled, and an empty table gives none. Texts of any length are read whole; a word of over 64 letters is known by its
first letters and a hash of all. Repeated rows repeat their result, other columns stay as they are, and columns
named as the results give way. Only the bounded training sample is shuffled; prediction runs where the rows are.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.llm.common import held, map_batches, text_of
from sensorloom.session import materialize

UNKNOWN = "und"
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
#: Unseen words a worker remembers with their scores, and scores it remembers; results do not depend on them.
CACHE_WORDS, CACHE_CELLS = 100_000, 4_000_000


@dataclass
class Model:
    """Log frequencies per language of words (order 0) and of n-grams (orders 1 and up).

    The items of an order are one text with line ends between them, so that a shipped model stays small.
    """

    languages: list[str]
    items: list[str]
    scores: list[np.ndarray]


def grams(word: str, order: int) -> list[str]:
    """The n-grams of a word with its ends marked; single letters carry no marks."""
    if order == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def word_key(word: str) -> str:
    """What the model knows a word by."""
    return word if len(word) <= 64 else f"{word[:32]}\0{xxhash.xxh3_128_hexdigest(word.encode('utf-8', 'surrogatepass'))}"


def training_sample(labelled: DataFrame, id_col: str, lang_col: str, counts: dict[str, int], rows_per_language: int) -> DataFrame:
    """About ``rows_per_language`` rows of each language (all, if fewer), chosen by a hash of their id.

    ``counts`` holds the rows of each language to learn. The choice is a filter, without any shuffle.
    """
    share = F.shiftrightunsigned(F.xxhash64(id_col), 11) / float(1 << 53)
    least = _looked_up(lang_col, {lang: rows_per_language / count for lang, count in counts.items()})
    return labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).filter(share < least)


def _looked_up(column: str, values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(column)] if values else F.lit(None).cast("double")


def count_features(sample: DataFrame, text_col: str, lang_col: str, orders: int) -> DataFrame:
    """``lang, n (order, 0 for words), item, count`` over the sample, summed in each batch first."""

    def run(batch: pa.RecordBatch):
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(_WORDS(text_of(text).lower()))
        rows: list[tuple[str, int, str, int]] = []
        for lang, counts in words.items():
            rows += [(lang, 0, word_key(w), c) for w, c in counts.items()]
            for order in range(1, orders + 1):
                pieces: Counter = Counter()
                for word, count in counts.items():
                    for piece in grams(word, order):
                        pieces[piece] += count
                rows += [(lang, order, g, c) for g, c in pieces.items()]
        if rows:
            langs, kinds, items, counts = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(kinds, pa.int32()), pa.array(items), pa.array(counts, pa.int64())], names=["lang", "n", "item", "count"])

    parts = sample.select(F.col(text_col).cast("binary"), F.col(lang_col))
    return map_batches(parts, run, "lang string, n int, item string, count long").groupBy("lang", "n", "item").agg(F.sum("count").alias("count"))


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
    rows_per_language: int = 2500, max_items: int = 60_000, max_cells: int = 24_000_000, orders: int = 5, smoothing: float = 0.5,
) -> Model:
    """Learn every language from a sample of about ``rows_per_language`` of its rows.

    Each language brings an equal share of ``max_items`` commonest words and n-grams of each order, one of each at
    least; with very many languages the shares shrink so that all scores stay within ``max_cells``.
    """
    found = labelled.filter(F.col(lang_col).isNotNull()).groupBy(lang_col).count()
    rows_of = {r[0]: r[1] for r in found.collect()}
    languages = sorted(rows_of)
    if not languages:
        return Model([], [], [])
    counts = materialize(count_features(training_sample(labelled, id_col, lang_col, rows_of, rows_per_language), text_col, lang_col, orders), "language")
    totals = {(r[0], r[1]): r[2] for r in counts.groupBy("lang", "n").agg(F.sum("count")).collect()}
    share = max(1, min(max_items, max_cells // ((orders + 1) * len(languages))) // len(languages))
    place = F.row_number().over(Window.partitionBy("n", "lang").orderBy(F.desc("count"), "item"))
    chosen = counts.withColumn("place", place).filter(F.col("place") <= share).select("n", "item").distinct()
    number = _looked_up("lang", {lang: float(k) for k, lang in enumerate(languages)}).cast("int")
    by_item = counts.join(chosen, ["n", "item"]).groupBy("n", "item").agg(F.collect_list(F.struct(number.alias("k"), "count")).alias("c"))
    table = by_item.select("n", "item", "c.k", "c.count").toArrow().sort_by([("n", "ascending"), ("item", "ascending")]).combine_chunks()
    kinds = table.column("n").to_numpy()
    items: list[str] = []
    scores: list[np.ndarray] = []
    for order in range(orders + 1):
        start, end = np.searchsorted(kinds, [order, order + 1])
        part = table.slice(start, end - start).combine_chunks()
        seen = np.zeros((len(part), len(languages)))
        for chunk, first in _with_starts(part):
            rows = np.repeat(np.arange(len(chunk)), chunk.column("k").value_lengths().to_numpy()) + first
            seen[rows, chunk.column("k").flatten().to_numpy()] = chunk.column("count").flatten().to_numpy()
        total = np.array([totals.get((lang, order), 0) for lang in languages], float)
        items.append("\n".join(part.column("item").to_pylist()))
        scores.append(np.log((seen + smoothing) / (total + smoothing * (len(part) + 1))).astype(np.float32))
    return Model(languages, items, scores)


def _with_starts(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, int]]:
    first = 0
    for batch in table.to_batches():
        yield batch, first
        first += len(batch)


class Scorer:
    """Scores words with a model and remembers the unseen ones."""

    def __init__(self, model: Model):
        self.languages, self.scores = model.languages, model.scores
        self.rows = [{item: k for k, item in enumerate(text.split("\n") if text else ())} for text in model.items]
        self.base = len(self.rows[0]) if self.rows else 0
        self.room = min(CACHE_WORDS, max(2, CACHE_CELLS // max(1, len(model.languages))))
        self.table = np.zeros((self.base + self.room, len(model.languages)), np.float32)
        if self.rows:
            self.table[: self.base] = model.scores[0]
        self.seen: dict[str, int] = {}

    def backoff(self, word: str) -> np.ndarray:
        for order in range(len(self.rows) - 1, 0, -1):
            hits = [row for g in grams(word, order) if (row := self.rows[order].get(g)) is not None]
            if hits:
                return self.scores[order][hits].mean(axis=0, dtype=float)
        return np.zeros(len(self.languages))

    def row(self, word: str) -> int:
        key = word_key(word)
        at = self.rows[0].get(key)
        if at is None:
            at = self.seen.get(key)
        if at is None:
            at = self.base + len(self.seen)
            self.seen[key] = at
            self.table[at] = self.backoff(word)
        return at

    def predict(self, text: str) -> tuple[str, float]:
        counts = Counter(_WORDS(text.lower()))
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.languages))
        words = list(counts)
        for k in range(0, len(words), self.room // 2):
            part = words[k : k + self.room // 2]
            if len(self.seen) + len(part) > self.room:
                self.seen.clear()
            rows = [self.row(w) for w in part]
            total += np.array([counts[w] for w in part], float) @ self.table[rows]
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with the predicted language and its share of the likelihood (0 to 1)."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    kept = [c for c in df.columns if c not in (lang_col, score_col)]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{lang_col}` string", f"`{score_col}` double"])
    spare = "_lang_text"
    while spare in kept:
        spare += "_"

    def run(batch: pa.RecordBatch):
        scorer = held(key, lambda: Scorer(shipped.value))
        at = batch.schema.get_field_index(spare)
        found = [scorer.predict(text_of(v)) for v in batch.column(at).to_pylist()]
        made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns) if i != at] + made, names=[*kept, lang_col, score_col])

    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("binary").alias(spare)), run, schema, key)
