"""JSON payload columns: expanding and packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

from sensorloom.operators.ordered import choose_slice, row_index
from sensorloom.functions.timefn import SECOND


def sensor_prefix(sensor: str) -> str:
    """First three letters, plus what follows the first underscore."""
    head, _, tail = sensor.partition("_")
    return head[:3] + (f"_{tail}" if tail else "")


def json_expand(df: DataFrame, sensor: str, schema: StructType | str, payload: str = "payload") -> DataFrame:
    """Turn the payload into one column per declared field, prefixed by the sensor."""
    parsed = df.withColumn("_j", F.from_json(payload, schema))
    fields = parsed.schema["_j"].dataType.fieldNames()
    prefix = sensor_prefix(sensor)
    rest = [c for c in df.columns if c != payload]
    return parsed.select(*rest, *[F.col(f"_j.{f}").alias(f"{prefix}_{f}") for f in fields])


def payload_keys(df: DataFrame, payload: str = "payload") -> list[str]:
    """Distinct payload keys, for logs whose schema is not declared; each becomes a column."""
    keys = df.select(F.explode(F.map_keys(F.from_json(payload, "map<string,string>"))).alias("key")).distinct()
    return sorted(r["key"] for r in keys.collect())


def json_expand_discovered(df: DataFrame, sensor: str, payload: str = "payload") -> DataFrame:
    """As ``json_expand`` with the keys found in the data, all as text."""
    schema = StructType()
    for key in payload_keys(df, payload):
        schema = schema.add(key, StringType())
    return json_expand(df, sensor, schema, payload)


def json_pack(
    df: DataFrame, fields: Sequence[str], device: str = "device", us: str = "us", tie: Sequence[str] = (), slice_us: int | None = None
) -> DataFrame:
    """Pack columns into a JSON payload: ``id, ts_ms, device, payload`` with a running id in time order.

    The id is a running count over time slices of all devices together, narrow
    enough (measured unless given) that no task sees more than a share of the rows.
    """
    slice_us = slice_us or choose_slice(df, (), us, finest=SECOND)
    numbered = row_index(df, "_id", keys=(), us=us, tie=[device, *tie], slice_us=slice_us)
    ts_ms = (F.col(us) / 1000).cast("long")
    return numbered.select(
        F.col("_id").alias("id"),
        ts_ms.alias("ts_ms"),
        F.col(device).alias("device"),
        F.to_json(F.struct(*fields)).alias("payload"),
    )
