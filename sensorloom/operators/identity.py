"""Participant identity, value remapping, anonymised codes and one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.timefn import micros, to_local


def local_timestamp(df: DataFrame, users: DataFrame, us: str = "us", device: str = "device") -> DataFrame:
    """Add ``local_us``: naive local time (as micros) in the zone of the row's participant.

    ``users(device, timezone)`` is a dimension; the join strategy is left to the
    planner, which broadcasts it only below its size threshold.
    """
    zones = users.select(F.col("device").alias(device), "timezone")
    return (
        df.join(zones, device, "left")
        .withColumn("local_us", micros(to_local(F.col(us), F.col("timezone"))))
        .drop("timezone")
    )


def merge_participant_ids(df: DataFrame, users: DataFrame, device: str = "device", with_city: bool = False) -> DataFrame:
    """Replace device ids by the participant id where one is known; optionally add the city."""
    city = ["city"] if with_city else []
    dim = users.select(F.col("device").alias(device), "new_id", *city)
    return df.join(dim, device, "left").withColumn(device, F.coalesce("new_id", device)).drop("new_id")


def remap_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replace listed values of a column; others stay."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(pairs[F.col(column)], F.col(column)))


def remap_by_table(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """As ``remap_values`` with a table ``(old, new)``."""
    return (
        df.join(mapping.withColumnRenamed("old", column), column, "left")
        .withColumn(column, F.coalesce("new", column))
        .drop("new")
    )


# Letters per code and a multiplier coprime to 26 that scatters consecutive numbers.
CODE_LETTERS = 6
CODE_SCATTER = 141_650_939


def letter_code(number: Column, letters: int = CODE_LETTERS) -> Column:
    """A distinct lower-case code per number: six letters below 26**6, twelve above."""
    space = 26**letters

    def spelled(value: Column) -> Column:
        return F.concat(*[F.char((F.lit(97) + F.pmod(F.floor(value / F.lit(26**i)), F.lit(26))).cast("int")) for i in range(letters)])

    code = spelled(F.pmod(F.pmod(number, F.lit(space)) * F.lit(CODE_SCATTER), F.lit(space)))
    return F.when(number < space, code).otherwise(F.concat(code, spelled(F.floor(number / F.lit(space)))))


def anonymize_ids(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """Map each distinct identifier to a unique code: ``(column, code_number, code)``.

    ``known`` is an earlier mapping; its codes are reused and only unseen ids get
    new numbers. Numbers follow the md5 order of the ids: ranked inside 4096 digest
    ranges and shifted by the counts of the earlier ranges, so nothing is sorted in one task.
    """
    ids = df.select(column).filter(F.col(column).isNotNull()).distinct()
    start = F.lit(0).cast("long")
    if known is not None:
        ids = ids.join(known.select(column), column, "left_anti")
        start = known.agg(F.coalesce(F.max("code_number"), F.lit(-1)) + 1).scalar()
    digest = ids.withColumn("_d", F.md5(F.col(column).cast("string"))).withColumn("_b", F.substring("_d", 1, 3))
    ranked = digest.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy("_d", column)))
    offsets = (
        digest.groupBy("_b")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        .drop("_n")
    )
    numbered = ranked.join(offsets, "_b")
    fresh = numbered.select(column, (start + F.col("_off") + F.col("_rn") - 1).alias("code_number"))
    fresh = fresh.withColumn("code", letter_code(F.col("code_number")))
    return fresh if known is None else known.select(column, "code_number", "code").unionByName(fresh)


def category_values(df: DataFrame, column: str) -> list:
    """Distinct values of a categorical column; each becomes a column."""
    return sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())


def one_hot(df: DataFrame, columns: Sequence[str], categories: dict[str, Sequence] | None = None) -> DataFrame:
    """Replace each categorical column by one 0/1 column per category."""
    out = df
    for column in columns:
        values = (categories or {}).get(column) or category_values(df, column)
        out = out.withColumns(
            {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
        )
    return out.drop(*columns)
