"""Byte-level BPE encoding and decoding with a given rank file.

Texts are cut into pieces by a pattern; the distinct pieces of a batch are merged together in padded numpy
matrices, one matrix for each bucket of lengths. In every round each row merges its leftmost pair of the
smallest rank, rows without a pair leave the matrix, and the rest close up. Ranks of pairs come from an
open-addressing hash table held in two arrays.

Results: a null or empty text has no tokens and an empty table no rows; texts of any length are read whole; bytes that are no UTF-8 count as U+FFFD; repeated rows repeat
their result; every other column stays as it is. Nothing is shuffled, so skew does not matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.common import held, map_batches, text_of

_NONE = np.int64(1 << 40)
#: Pieces above this length are merged one by one, all places of the smallest rank in one round. Results are
#: the same as in the matrix (tested); only memory and time differ.
LONG_PIECE = 256
#: Distinct pieces a worker remembers; beyond that it starts again. Results do not depend on it.
CACHE_PIECES = 200_000
#: Characters of texts that are cut into pieces together.
TEXT_STEP = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PairTable:
    """Rank of the token that two neighbouring tokens make, by hashing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.made = np.full(1 << self.bits, _NONE, np.int64)
        values, slot = np.array(made, np.int64), self._slot(keys)
        while len(keys):
            free = self.keys[slot] == np.iinfo(np.uint64).max
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.made[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; a negative token on either side has none."""
        shape = left.shape
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        out = np.full(keys.shape, _NONE, np.int64)
        open_at = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        slot = self._slot(keys[open_at])
        while len(open_at):
            found, want = self.keys[slot], keys[open_at]
            hit = found == want
            out[open_at[hit]] = self.made[slot[hit]]
            on = ~hit & (found != np.iinfo(np.uint64).max)
            open_at, slot = open_at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Coder:
    """Encodes pieces and decodes ids with one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs = PairTable(ranks)
        self.first = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.whole = ranks
        self.find = regex.compile(pattern).findall
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    def _merge_bucket(self, pieces: list[bytes], width: int) -> list[bytes]:
        rows = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        cells = np.full((rows, width), -1, np.int64)
        cells[np.arange(width) < sizes[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        done = np.full((rows, width), -1, np.int64)
        owner = np.arange(rows)
        ranks = self.pairs.ranks(cells[:, :-1], cells[:, 1:])
        while len(owner):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(owner), np.int64)
            best = ranks[np.arange(len(owner)), at] if ranks.shape[1] else np.full(len(owner), _NONE)
            ended = best == _NONE
            if ended.any():
                done[owner[ended], : cells.shape[1]] = cells[ended]
                cells, ranks, owner, at, best = cells[~ended], ranks[~ended], owner[~ended], at[~ended], best[~ended]
                if not len(owner):
                    break
            every = np.arange(len(owner))
            cells[every, at] = best
            last = cells.shape[1] - 1
            on = np.arange(last) > at[:, None]
            cells = np.where(on, cells[:, 1:], cells[:, :-1])
            ranks = np.where(on[:, : last - 1] | (np.arange(last - 1) == at[:, None]), ranks[:, 1:], ranks[:, :-1])
            left, right = every[at > 0], every[at < last - 1]
            ranks[left, at[left] - 1] = self.pairs.ranks(cells[left, at[left] - 1], cells[left, at[left]])
            ranks[right, at[right]] = self.pairs.ranks(cells[right, at[right]], cells[right, at[right] + 1])
        filled = done >= 0
        ids, ends = done[filled].astype("<u4").tobytes(), (np.cumsum(filled.sum(axis=1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One long row. All places of the smallest rank merge at once unless that would make a smaller rank."""
        cells = self.first[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.ranks(cells[:-1], cells[1:])
        while len(ranks):
            best = ranks.min()
            if best == _NONE:
                break
            at = np.flatnonzero(ranks == best)
            fresh = np.r_[True, np.diff(at) != 1]
            run = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            at = at[(at - run) % 2 == 0]
            for places in (at, at[:1]):
                merged = cells.copy()
                merged[places] = best
                keep = np.ones(len(cells), bool)
                keep[places + 1] = False
                merged = merged[keep]
                again = self.pairs.ranks(merged[:-1], merged[1:])
                if len(places) == 1 or not len(again) or again.min() >= best:
                    break
            cells, ranks = merged, again
        return cells

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        buckets: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.whole.get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                out[piece] = self._merge_long(raw).astype("<u4").tobytes()
            else:
                names, raws = buckets.setdefault((len(raw) + 3) // 4 * 4, ([], []))
                names.append(piece)
                raws.append(raw)
        for width, (names, raws) in buckets.items():
            for k in range(0, len(raws), 4096):
                out.update(zip(names[k : k + 4096], self._merge_bucket(raws[k : k + 4096], width)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the distinct new pieces of texts that are taken together are merged together."""
        out: list[bytes] = []
        step: list[str] = []
        size = 0
        for text in texts:
            if step and size + len(text) > TEXT_STEP:
                out += self._encode_step(step)
                step, size = [], 0
            step.append(text)
            size += len(text)
        return out + self._encode_step(step)

    def _encode_step(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        new = {p for pieces in split for p in pieces if p not in self.cache}
        got = self.encode_pieces(new)
        self.cache.update((p, i) for p, i in got.items() if len(p) <= 64)
        long = {p: i for p, i in got.items() if len(p) > 64}
        if long:
            return [b"".join([self.cache.get(p) or long.get(p) or b"" for p in pieces]) for pieces in split]
        look = self.cache.__getitem__
        return [b"".join(map(look, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.blob[np.repeat(self.starts[tokens] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


def _state(name: str, pattern: str) -> str:
    return f"bpe {name} {pattern}"


def _coder(name: str, pattern: str) -> Coder:
    return held(_state(name, pattern), lambda: Coder(read_ranks(SparkFiles.get(name)), pattern))


def _ship(df: DataFrame, vocab_path: str) -> str:
    """Hand the rank file (of fixed size) to every executor and return the name they find it by."""
    df.sparkSession.sparkContext.addFile(vocab_path)
    return vocab_path.rsplit("/", 1)[-1]


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``TEXT_STEP`` bytes of text, so that what they turn into stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + TEXT_STEP, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode(df: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text_col`` as little-endian unsigned 32-bit integers (binary).

    With ``decoded_col`` the ids are decoded again in the same pass and the bytes go to that column.
    """
    name = _ship(df, vocab_path)
    columns = df.columns
    added = [out_col, *([decoded_col] if decoded_col else [])]
    spare = "_bpe_text"
    while spare in columns:
        spare += "_"
    kept = [c for c in columns if c not in added]
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in kept] + [f"`{c}` binary" for c in added])

    def run(whole: pa.RecordBatch):
        coder = _coder(name, pattern)
        at = whole.schema.get_field_index(spare)
        for batch in _slices(whole, at):
            yield coded(coder, batch, at)

    def coded(coder: Coder, batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        ids = coder.encode([text_of(v) for v in batch.column(at).to_pylist()])
        made = [pa.array(ids, pa.binary())]
        if decoded_col:
            made.append(pa.array([coder.decode(i) for i in ids], pa.binary()))
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns) if i != at] + made, names=[*kept, *added])

    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("binary").alias(spare)), run, schema, _state(name, pattern))


def decode(df: DataFrame, vocab_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids of ``ids_col`` stand for; null ids give empty bytes."""
    name = _ship(df, vocab_path)
    kept = [c for c in df.columns if c != out_col]
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in kept] + [f"`{out_col}` binary"])

    def run(batch: pa.RecordBatch):
        coder = _coder(name, pattern)
        ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([coder.decode(i or b"") for i in ids], pa.binary())], names=[*kept, out_col])

    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept]), run, schema, _state(name, pattern))


def ids_as_array(column: str):
    """Column expression: the little-endian ids as an array of integers."""
    byte = lambda i, k: F.conv(F.hex(F.substring(F.col(column), i * 4 + k + 1, 1)), 16, 10).cast("int")
    return F.transform(
        F.sequence(F.lit(0), (F.octet_length(column) / 4).cast("int") - 1),
        lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216,
    )
