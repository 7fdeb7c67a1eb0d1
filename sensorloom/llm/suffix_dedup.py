"""Removal of repeated passages with per-shard suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes. Strings never cross
documents and are judged on the input.

1. Routing. Each string is sent by its anchor, the leftmost smallest hash among the grams of a quarter of its length.
   That depends on the string alone, so equal strings meet; the starts that share an anchor form one short
   context of text. Anchors that stand once in the corpus end here.
2. Equal contexts become one row with a multiplicity. Where an anchor has a single context its strings repeat
   exactly as often as the context does. All other contexts fetch their text.
3. Shards of contexts, bounded in size, get a suffix array by Larsson-Sadakane refinement in numpy: ranks of the
   first bytes, then only groups that are still equal are refined with the rank further on, doubling the depth
   up to ``length``. Kasai's common prefixes follow: along the text they fall by one from each position to the
   next except where the preceding bytes differ, and only there bytes are compared. A string repeats where the
   common prefix with a neighbour reaches ``length``.
4. An anchor with more contexts than a shard holds is cut into several shards by content. Their strings that
   stay single are merged across the shards: the sorted 128-bit keys of all shards of a range are searched
   binarily for strings that another shard holds too.
5. Repeating starts go back to the documents, and the covered bytes leave.

Results: null and empty texts have no bytes and lose none; texts shorter than ``length`` stay; a repeated row
repeats its strings; ids may be null or repeat; an empty table gives none. That contexts of one anchor are
equal rests on a 64-bit hash beside that of the anchor, strings across shards on 128-bit keys.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.llm.common import bounded_batches, map_batches
from sensorloom.session import materialize

LENGTH = 400
#: Starts of a text that are looked at together.
STEP = 1 << 19
#: Bytes of the contexts of one anchor that a shard takes; a shard takes further anchors up to half of that
#: before. Positions in a shard must fit into 20 bits.
SHARD_BYTES = 550_000

#: Bytes that stand for a word where passages are told by words.
CODE = 6
_WORDS = re.compile(rb"\S+").finditer

_ROOT = 0x9E3779B97F4A7C15
_PLACE_BITS = np.uint64(20)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if size not in _POWERS:
        both = []
        for base in (_ROOT, pow(_ROOT, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            both.append(np.cumprod(factors, dtype=np.uint64))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(text: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes."""
    n = len(text)
    powers, inverse = _powers(max(STEP + LENGTH, n + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    return _mixed((sums[width:] - sums[:-width]) * inverse[: n - width + 1])


def anchors(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor hash, first start, end of starts)`` of the runs of starts that share an anchor."""
    gram = max(1, length // 4)
    width, starts = length - gram + 1, len(text) - length + 1
    hashes = rolling(text, gram)
    mask = np.uint64((1 << int(_PLACE_BITS)) - 1)
    order = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.concatenate([order, np.full(-len(order) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(right[:starts], left[width - 1 : width - 1 + starts]) & mask).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    return hashes[place[first]], first, np.append(first[1:], starts)


def suffix_array(text: np.ndarray, borders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``length`` bytes, and each position's rank (equal for equal prefixes).

    ``borders`` are the ends of the separate texts; a prefix stops at its border.
    """
    n = len(text)
    left = np.repeat(borders, np.diff(borders, prepend=0)) - np.arange(n)
    symbols = np.zeros(n + 4, np.uint64)
    symbols[:n] = text.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = (key << np.uint64(9)) | np.where(left > k, symbols[k : n + k], np.uint64(0))
    bits = np.uint64(20)
    low = np.uint64((1 << 20) - 1)
    packed = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    heads = np.concatenate([[True], np.diff(packed >> bits) != 0]) if n else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(heads, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = group
    depth = 4
    while depth < length:
        further = min(depth, length - depth)  # the last step overlaps, which compares the same bytes again
        follows = np.concatenate([heads[1:], [True]]) if n else heads
        slots = np.flatnonzero(~(heads & follows) & (left[order] >= depth))
        if not len(slots):
            break
        members = order[slots]
        after = members + further
        second = np.where(left[members] > further, rank[np.minimum(after, n - 1)] + 1, 0)
        # Groups of prefixes that ended before this depth are equal for good; one that ends here goes in front.
        packed = np.sort((rank[members].astype(np.uint64) << np.uint64(42)) | (second.astype(np.uint64) << np.uint64(21)) | np.arange(len(members), dtype=np.uint64))
        at = (packed & np.uint64((1 << 21) - 1)).astype(np.int64)
        members = members[at]
        fresh = np.concatenate([[True], np.diff(packed >> np.uint64(21)) != 0])
        order[slots] = members
        heads[slots] |= fresh
        group = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[members] = group
        depth += further
    return order, rank


def common_prefixes(text: np.ndarray, borders: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each position with the one before it in suffix order, up to the border.

    Kasai's rule: from a position to the next it falls by one where both are preceded by the same byte; only
    elsewhere are bytes compared, eight at a time.
    """
    n = len(text)
    left = np.repeat(borders, np.diff(borders, prepend=0)) - np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= padded[k : n + k] << np.uint64(8 * k)
    here = np.arange(n)
    has = before >= 0
    previous = np.where(has, before, 0)
    inherits = has & (here > 0) & (previous > 0)
    inherits &= (text[here - 1] == text[previous - 1]) & (left[here - 1] > left[here]) & (left[previous - 1] > left[previous])
    inherits[1:] &= before[:-1] == previous[1:] - 1
    found = np.zeros(n, np.int64)
    active = np.flatnonzero(has & ~inherits)
    most = np.minimum(left, left[previous])
    done = 0
    while len(active):
        differ = words[active + done] ^ words[previous[active] + done]
        same = np.full(len(active), 8, np.int64)
        unequal = np.flatnonzero(differ)
        low = differ[unequal] & (~differ[unequal] + np.uint64(1))
        same[unequal] = np.log2(low.astype(np.float64)).astype(np.int64) // 8
        found[active] += same
        done += 8
        active = active[(same == 8) & (most[active] > done)]
    start = np.maximum.accumulate(np.where(inherits, 0, here))
    return np.minimum(np.where(inherits, found[start] - (here - start), found), most)


def _repeating(parts: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a shard of contexts in the order of their first places: which positions repeat, which are the first of
    their equal strings, and the ends of the parts."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    borders = np.cumsum([len(p) for p in parts])
    order, rank = suffix_array(text, borders, length)
    prefix = common_prefixes(text, borders, order)
    repeats = prefix >= length
    repeats[order[:-1][prefix[order[1:]] >= length]] = True
    starts = np.concatenate([np.arange(b - len(p), b - length + 1) for p, b in zip(parts, borders)])
    first = np.zeros(len(text), bool)
    first[starts[np.unique(rank[starts], return_index=True)[1]]] = True
    return repeats | (np.repeat(counts, np.diff(borders, prepend=0)) > 1), first, borders


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges[::2].tolist(), edges[1::2].tolist()


def _doc_key(text_col: str) -> Column:
    """Tells the text of rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))


def find_anchors(df: DataFrame, length: int, code: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """``h, c, doc, t, places, m, size``: the contexts of every document; equal ones of a document are one row.

    ``code`` gives the bytes that are compared; places are places in them.
    """
    schema = "h long, c long, doc long, t long, places array<int>, m int, size int"

    def run(batch: pa.RecordBatch):
        out: list[list] = [[] for _ in range(7)]
        for doc, t, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = code(raw)
            if len(raw) < length:
                continue
            rows: dict[tuple[int, int, int], list[int]] = {}
            for offset in range(0, len(raw) - length + 1, STEP):
                piece = raw[offset : offset + STEP + length - 1]
                hashes, first, ends = anchors(np.frombuffer(piece, np.uint8), length)
                for h, a, b in zip(hashes.view(np.int64).tolist(), first.tolist(), (ends + length - 1).tolist()):
                    rows.setdefault((h, xxhash.xxh3_64_intdigest(piece[a:b]), b - a), []).append(a + offset)
            for (h, c, size), places in rows.items():
                for column, value in zip(out, (h, c - (1 << 63), doc, t, places, len(places), size)):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["h", "c", "doc", "t", "places", "m", "size"])

    return map_batches(df, run, schema)


def _shard_results(length: int, shard_bytes: int):
    """Over rows sorted by (h, part, c): for each context the runs of starts to remove everywhere (``a, b``) and
    everywhere but at its first place (``a1, b1``); for divided anchors also the first of equal strings."""

    def emit(rows: list[tuple]):
        rows = [r for k, r in enumerate(rows) if not k or r[:3] != rows[k - 1][:3]]
        rows.sort(key=lambda r: r[6])
        parts, counts = [r[5] for r in rows], np.array([r[3] for r in rows])
        repeats, first, borders = _repeating(parts, counts, length)
        out: list[list] = [[] for _ in range(8)]
        for (h, _, c, _, divided, raw, _), end in zip(rows, borders.tolist()):
            own = slice(end - len(raw), end - length + 1)
            strings = np.flatnonzero(first[own]).tolist() if divided else []
            keys = b"".join(hashlib.blake2b(raw[s : s + length], digest_size=16).digest() for s in strings)
            for column, value in zip(out, (h, c, *_runs(repeats[own] & ~first[own]), *_runs(repeats[own] & first[own]), strings, keys)):
                column.append(value)
        ints = pa.list_(pa.int32())
        kinds = (pa.int64(), pa.int64(), ints, ints, ints, ints, ints, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["h", "c", "a", "b", "a1", "b1", "s", "keys"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                new = not held or held[-1][:2] != row[:2]
                if new and size > shard_bytes // 2:
                    yield emit(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield emit(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of one range of keys, sorted by key and place: those that another shard holds too.

    ``later`` tells that an earlier place has the string. A key may go on in the next batch.
    """
    tail: list = []  # the last key of the batch before and its row

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.array(batch.column(0).to_pylist(), "S32")
        where = np.searchsorted(keys, keys, side="left")
        until = np.searchsorted(keys, keys, side="right")
        h, c, s = (batch.column(i).to_pylist() for i in (1, 2, 3))
        goes_on = bool(tail) and tail[0] == keys[0]
        later = (np.arange(len(keys)) > where) | (goes_on & (where == 0))
        shared = (until - where > 1) | later
        rows = [(h[i], c[i], s[i], bool(later[i])) for i in np.flatnonzero(shared)]
        if goes_on and not tail[2]:
            rows.append(tail[1])
        last = len(keys) - 1
        tail = [keys[last], (h[last], c[last], s[last], bool(later[last])), bool(shared[last])]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["h", "c", "s", "later"])


def repeated_starts(
    df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, keep_first: bool = False, shard_bytes: int = SHARD_BYTES,
    code: Callable[[bytes], bytes] = bytes,
) -> DataFrame:
    """``doc, t, spans``: for each document the runs of starts [from, to) whose string also starts elsewhere, each as
    one long (``from`` in the upper 32 bits), in no order.

    With ``keep_first`` the first place of each string, by a hash of the id and then by position, is left out. Strings are
    those of ``code`` of a text, in the same pass of Python that looks at them.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    docs = df.select(F.xxhash64(id_col).alias("doc"), _doc_key(text_col).alias("t"), raw.alias("raw"))
    found = materialize(find_anchors(docs, length, code), "anchors")
    place = F.struct("doc", "t", F.col("places")[0].alias("a"), "size")
    heads = found.groupBy("h").agg(F.sum("m").alias("total"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(place).alias("at")).filter("total > 1")
    heads = materialize(heads.select("h", (F.col("c0") == F.col("c1")).alias("alone"), "at"), "heads")
    live = materialize(found.join(heads, "h"), "live")
    contexts = materialize(live.filter("NOT alone").groupBy("h", "c").agg(F.sum("m").alias("n"), F.min(place).alias("at")), "contexts")
    widths = materialize(contexts.groupBy("h").agg(F.ceil(F.count(F.lit(1)) * (2 * length) / shard_bytes).alias("parts")), "widths")
    want = F.struct("h", F.pmod(F.col("c"), F.col("parts")).cast("int").alias("part"), "c", "n", (F.col("parts") > 1).alias("divided"), "at.a", "at.size")
    wanted = contexts.join(widths, "h").groupBy(F.col("at.doc").alias("_doc"), F.col("at.t").alias("_t")).agg(F.collect_list(want).alias("want"))
    texts = docs.join(materialize(wanted, "wanted"), (F.col("doc") == F.col("_doc")) & (F.col("t") == F.col("_t")))

    def cut(batch: pa.RecordBatch):
        out: list[list] = [[] for _ in range(7)]
        for doc, t, raw_text, want in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw_text = code(raw_text)
            for w in want:
                order = b"".join((x + (1 << 63)).to_bytes(8, "big") for x in (doc, t, w["a"]))
                for column, value in zip(out, (w["h"], w["part"], w["c"], w["n"], w["divided"], raw_text[w["a"] : w["a"] + w["size"]], order)):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["h", "part", "c", "n", "divided", "raw", "order"])

    pieces = map_batches(texts.select("doc", "t", "raw", "want"), cut, "h long, part int, c long, n long, divided boolean, raw binary, order binary")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(width, "h", "part").sortWithinPartitions("h", "part", "c")
    local = materialize(dealt.mapInArrow(_shard_results(length, shard_bytes), "h long, c long, " + ", ".join(f"{n} array<int>" for n in ("a", "b", "a1", "b1", "s")) + ", keys binary"), "shards")
    # Strings of divided anchors across their shards.
    strings = local.filter(F.size("s") > 0).join(contexts.select("h", "c", "at"), ["h", "c"]).select("h", "c", "at", "keys", F.posexplode("s").alias("k", "s"))
    crossing = strings.select(F.hex(F.substring("keys", F.col("k") * 16 + 1, 16)).alias("key"), "h", "c", "s", "at")
    crossing = crossing.repartition(width, "key").sortWithinPartitions("key", "at", "s").select("key", "h", "c", "s")
    shared = crossing.mapInArrow(_merge, "h long, c long, s int, later boolean").groupBy("h", "c").agg(F.collect_set(F.when(F.col("later"), F.col("s"))).alias("s0"), F.collect_set(F.when(~F.col("later"), F.col("s"))).alias("s1"))
    single = lambda name: F.transform(name, lambda s: F.struct(s.alias("a"), (s + 1).alias("b")))
    zipped = lambda a, b: F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b")))
    none = F.array().cast("array<struct<a:int,b:int>>")
    # Of a string that other shards hold too, the place at hand may be the first of all: it stays at its context's
    # first place, and goes elsewhere if the context has other places; that much the shard has said already.
    firsts = none if keep_first else single("s1")
    decided = local.select("h", "c", zipped("a", "b").alias("all"), zipped("a1", "b1").alias("rest")).unionByName(
        shared.select("h", "c", F.concat(single("s0"), firsts).alias("all"), none.alias("rest"))
    )
    decided = decided.filter(F.size("all") + F.size("rest") > 0).join(contexts.select("h", "c", "at"), ["h", "c"])
    decided = materialize(decided, "decided")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("size") - (length - 1)).alias("b")))
    columns = ("doc", "t", "places", "all", "rest", "at")
    by_context = live.filter("NOT alone").drop("at").join(decided, ["h", "c"]).select(*columns)
    repeated = live.filter("alone").withColumn("all", none).withColumn("rest", whole).select(*columns).unionByName(by_context)
    first = (F.col("at.doc") == F.col("doc")) & (F.col("at.t") == F.col("t"))
    runs = lambda p: F.when(first & (F.col("at.a") == p) & F.lit(keep_first), F.col("all")).otherwise(F.concat("all", "rest"))
    packed = lambda p, r: F.shiftleft((p + r["a"]).cast("long"), 32) + (p + r["b"])
    spans = F.flatten(F.transform("places", lambda p: F.transform(runs(p), lambda r: packed(p, r))))
    # Rows equal in id and text say the same; a set keeps one of them before and after the shuffle.
    return repeated.select("doc", "t", spans.alias("spans")).groupBy("doc", "t").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def covered(spans: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the strings at the starts cover; ``spans`` are packed as in ``repeated_starts``."""
    if not len(spans):
        return []
    spans = np.sort(spans)
    a, b = spans >> 32, np.maximum.accumulate((spans & 0xFFFFFFFF) - 1 + length)
    breaks = np.flatnonzero(a[1:] > b[:-1])
    return list(zip([int(a[0]), *a[breaks + 1].tolist()], [*b[breaks].tolist(), int(b[-1])]))


def _whole(raw: bytes, a: int, b: int) -> tuple[int, int]:
    while a > 0 and raw[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def word_codes(raw: bytes | None) -> bytes:
    """A text with ``CODE`` bytes of a hash in place of each word."""
    hashes = [xxhash.xxh3_64_intdigest(w) for w in (raw or b"").split()]
    return np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes()


def word_ranges(raw: bytes, spans: np.ndarray, words: int) -> list[tuple[int, int]]:
    """The byte ranges of the passages of ``words`` words whose codes start in the spans."""
    if not len(spans):
        return []
    places = [m.span() for m in _WORDS(raw)]
    out = []
    for a, b in covered(spans, 1):
        # A string that does not start at a word only tells of the words around it.
        first, last = -(-a // CODE), (b - 1) // CODE
        if first <= last:
            out.append((places[first][0], places[last + words - 1][1]))
    return out


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _arrays(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """The numbers of each row; none for null."""
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
    for size, end in zip(np.diff(ends, prepend=0), ends):
        yield values[end - size : end]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, *, words: int = 0, keep_first: bool = False, whole_characters: bool = False, shard_bytes: int = SHARD_BYTES, kept_col: str = "kept", removed_col: str = "removed") -> DataFrame:
    """``df`` with the remaining bytes and the removed byte ranges (array of ``a``, ``b``).

    Every place of a repeated string goes; with ``keep_first`` one of them stays. ``whole_characters`` also
    removes what a range leaves of a UTF-8 character that it cuts.

    With ``words``, passages of that many equal words (cut at white space) go as well, however short. Both kinds
    are judged on the input and count their places in one order, so one place of each byte stays with ``keep_first``.
    """
    found = materialize(repeated_starts(df, id_col, text_col, length, keep_first, shard_bytes), "repeats")
    columns = [c for c in df.columns if c not in (kept_col, removed_col)]
    kinds = dict(df.dtypes)
    # The table's columns travel in a struct, so none of them can clash with the names used here.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.xxhash64(id_col).alias("doc"), _doc_key(text_col).alias("t"))
    joined = rows.join(found, ["doc", "t"], "left")
    if words:
        found = repeated_starts(df, id_col, text_col, words * CODE, keep_first, shard_bytes, word_codes)
        joined = joined.join(materialize(found.withColumnRenamed("spans", "word_spans"), "repeated-words"), ["doc", "t"], "left")
    else:
        joined = joined.withColumn("word_spans", F.array().cast("array<long>"))
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"`{kept_col}` binary", f"`{removed_col}` array<struct<a: int, b: int>>"])

    def run(batch: pa.RecordBatch):
        kept, removed = [], []
        each = (_arrays(batch.column(len(columns) + k)) for k in (1, 2))
        for raw, spans, word_spans in zip(batch.column(len(columns)).to_pylist(), *each):
            ranges = covered(spans, length)
            if whole_characters:
                ranges = [_whole(raw, a, b) for a, b in ranges]
            if words:
                ranges = _joined(ranges + word_ranges(raw, word_spans, words))
            edges = [0, *[e for r in ranges for e in r], len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            removed.append([{"a": a, "b": b} for a, b in ranges])
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(kept, pa.binary()), pa.array(removed, kind)], names=[*columns, kept_col, removed_col])

    raw = F.coalesce(F.col("row")[text_col].cast("binary"), F.lit(b""))
    return map_batches(joined.select(*[F.col("row")[c].alias(c) for c in columns], raw.alias("_raw"), F.col("spans").alias("_spans"), F.col("word_spans").alias("_word_spans")), run, schema)
