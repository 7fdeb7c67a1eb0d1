"""Mixing sources to target weights by systematic sampling, with built-in expressions only.

Every source gets a target (its share of the wanted total by weight, at most ``max_repeat`` times its size;
what a source cannot take is shared out again by weight). A document of a source is expected ``target / size``
times. The expected copies are summed up along an order of the source's documents, one offset between 0 and 1
that depends on the seed and the source is added, and a document is emitted once for every whole number its
stretch crosses. The order runs through hash buckets, by size inside each: so the words taken stay within
about a document of the target for every bucket, and a source with a third of all rows is many small windows.

Results: null texts have size 0 and are emitted like others without counting; a null source is a source, the
last one; a source of size 0 has target 0; repeated rows are separate documents; an empty table gives none.
Other columns pass through. Reruns agree because nothing random is drawn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in one window of the order.
BUCKET_ROWS = 50_000


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _hash(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, source_col: str = "source", size_col: str = "size", *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """``source, source_size, source_rows, all_rows, target``: one row per source.

    Sources by code point, null last, take the weights in turn. Filling stops where each source is full: with
    sources in the order of ``cap / weight`` those that are full come first, so sums up to a row decide it.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_place")
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = (
        sized.groupBy(F.col(source_col).alias("_source"))
        .agg(F.sum(size_col).alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
        .withColumn("_place", F.row_number().over(by_name) - 1)
        .withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("_place") % len(weights)))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    )
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    full = each.withColumn("_total", total).withColumn("_full", F.col("_cap") * weight_left <= left * F.col("_weight"))
    over_full = lambda c: F.sum(F.when(F.col("_full"), F.col(c)).otherwise(F.lit(0.0))).over(everything)
    level = F.try_divide(F.col("_total") - over_full("_cap"), F.sum("_weight").over(everything) - over_full("_weight"))
    return full.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_weight") * level)).select(
        "_source", "source_size", "source_rows", F.sum("source_rows").over(everything).alias("all_rows"), "target"
    )


def add_copies(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", *, tie_cols: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """``df`` with ``source_size``, ``target`` and ``copies``, how often the mix takes each row.

    ``df`` and ``targets`` must come from the same rows. Rows equal in size, id and ``tie_cols`` are taken in
    any order; with ids that repeat name columns that tell the rows apart. Columns of ``df`` with the names of
    the added ones give way.
    """
    df = df.drop("source_size", "target", "copies")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    buckets = F.floor(F.col("all_rows") / BUCKET_ROWS) + 1
    placed = df.join(targets, F.col(source_col).eqNullSafe(F.col("_source"))).withColumn("_bucket", _hash(key) % buckets).drop("_source", "source_rows", "all_rows")
    bucket_rows = (
        df.select(source_col, id_col).join(targets.select("_source", "all_rows"), F.col(source_col).eqNullSafe(F.col("_source")))
        .groupBy("_source", (_hash(key) % buckets).alias("_at")).agg(F.count(F.lit(1)).alias("_rows"))
    )
    earlier = Window.partitionBy("_source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucket_rows.select("_source", "_at", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    order = Window.partitionBy(source_col, "_bucket").orderBy(size_col, F.md5(key.cast("binary")), id_col, *tie_cols)
    offset = (_hash(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(source_col), F.lit("")))) + 0.5) / float(1 << 32)
    end = F.col("_start") + F.col("_row")
    crossed = lambda place: F.floor(F.col("_rate") * place + F.col("_offset"))
    return (
        placed.withColumn("_row", F.row_number().over(order))
        .join(starts, F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_at")))
        .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("_offset", offset)
        .withColumn("copies", (crossed(end) - crossed(end - 1)).cast("long"))
        .drop("_source", "_at", "_bucket", "_start", "_row", "_rate", "_offset")
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 0, **shares) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_whole")
    sized = df.select(whole, F.col(id_col).alias("_id"), F.col(source_col).alias("_from"), word_count(text_col).alias("_size"), F.xxhash64(text_col).alias("_tie"))
    targets = source_targets(sized.select("_from", "_size"), "_from", "_size", **shares)
    taken = add_copies(sized, targets, "_id", "_from", "_size", tie_cols=["_tie"], seed=seed).filter("copies > 0")
    return taken.select("_whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_whole.*")
