"""Reading, harmonising and writing sensor files."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, LongType, MapType, StringType, StructField, StructType

# Positional layout of a raw sensor log.
RAW_SCHEMA = StructType(
    [
        StructField("id", LongType()),
        StructField("ts_ms", DoubleType()),
        StructField("device", StringType()),
        StructField("payload", StringType()),
    ]
)

#: Rows of a row group where tasks write their files themselves.
GROUP_ROWS = 100_000
# Types that Arrow writes to Parquet as Spark does, and characters that Spark escapes in the names of folders.
_PLAIN = {"boolean", "byte", "short", "integer", "long", "float", "double", "string", "binary", "date", "timestamp", "timestamp_ntz"}
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def union_sensor_files(
    spark: SparkSession,
    root: str,
    sensor: str,
    suffix: str = "",
    device: str | None = None,
    dedupe: bool = False,
    schema: StructType = RAW_SCHEMA,
) -> DataFrame:
    """All files ``<sensor><suffix>.csv`` anywhere below ``root`` as one frame with a ``source`` column.

    The name test is on file metadata, so other sensors' files are never opened.
    No matching file gives an empty frame of the same schema.
    """
    path = F.col("_metadata.file_path")
    name = (sensor + suffix).replace(".", r"\.")
    rows = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("header", True)
        .option("escape", '"')
        .csv(root)
        .filter(path.rlike(rf"/{name}\.csv(/|$)"))
        .withColumn("source", F.regexp_extract(path, rf"([^/]+)/{name}\.csv(/|$)", 1))
    )
    if device is not None:
        rows = rows.filter(F.col("device") == device)
    return rows.dropDuplicates(schema.fieldNames()) if dedupe else rows


def read_ragged_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV whose lines have differing numbers of fields.

    The widest line fixes the number of columns (one aggregated pass, one number
    to the driver); columns beyond the header are named ``extra_1``, ``extra_2``, ….
    """
    lines = spark.read.text(path)
    header = lines.filter(F.length("value") > 0).first()["value"].split(sep)
    widest = lines.agg(F.max(F.size(F.split("value", sep)))).first()[0]
    names = header + [f"extra_{i + 1}" for i in range(widest - len(header))]
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def write_partitioned(df: DataFrame, path: str, by: str = "device", max_rows: int = 5_000_000) -> None:
    """Parquet with one folder per key.

    The rebalance hint brings a key's rows together but lets adaptive execution
    split a key that is too large for one task. Hadoop's local file system starts a process for each
    folder, file and checksum that it makes; there the tasks write their files with Arrow. Other stores, and columns of
    types that Arrow does not write as Spark does, get Spark's writer.
    """
    spread = df.hint("rebalance", by)
    folder = _local_folder(df.sparkSession, path)
    if folder is not None and by in df.columns and all(_plain(f.dataType) for f in df.schema.fields):
        return _write_folders(spread, folder, by, max_rows)
    spread.write.mode("overwrite").option("maxRecordsPerFile", max_rows).partitionBy(by).parquet(path)


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The absolute path on the local file system, if that is where Spark would write."""
    scheme, folder = re.fullmatch(r"(?:([A-Za-z][\w+.-]*):)?(.*)", path, re.DOTALL).groups()
    store = scheme or spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").split(":")[0]
    folder = re.sub(r"^///", "/", folder) if scheme else folder
    return os.path.normpath(folder) if store == "file" and re.match(r"/[^/]", folder) else None


def _plain(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, MapType):
        return _plain(kind.keyType) and _plain(kind.valueType)
    if isinstance(kind, StructType):
        return len(kind.fields) > 0 and all(_plain(f.dataType) for f in kind.fields)
    return kind.typeName() in _PLAIN or isinstance(kind, DecimalType)


def _folder_name(by: str, value: str) -> str:
    """The name that Spark gives the folder of a key; the value is its text, empty for NULL."""
    escape = lambda text: _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", text)
    return f"{escape(by)}={escape(value) or '__HIVE_DEFAULT_PARTITION__'}"


def _write_folders(df: DataFrame, path: str, by: str, max_rows: int) -> None:
    """Each task writes below a folder of its attempt; what the attempts that counted have written is moved when all are done."""
    staging, version = f"{path}-writing-{uuid.uuid4().hex}", df.sparkSession.version
    kept = [F.col(f"`{c}`") for c in df.columns if c != by]
    sorted_rows = df.select(F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("")).alias("_key"), *kept).sortWithinPartitions("_key")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays(batch.columns[1:], schema=pa.schema(list(batch.schema)[1:], {"org.apache.spark.version": version}))
            found = pc.run_end_encode(batch.column(0))
            start = 0
            for key, end in zip(found.values.to_pylist(), found.run_ends.to_pylist()):
                yield key, rows.slice(start, end - start)
                start = end

    def write(folder: str, tag: int, batches: Iterator[pa.RecordBatch]) -> None:
        os.makedirs(folder)
        held: list[pa.RecordBatch] = []
        writer, files, done = None, 0, 0

        def flush() -> None:
            if held:
                writer.write_table(pa.Table.from_batches(held))
                held.clear()

        for batch in batches:
            while batch.num_rows:
                writer = writer or pq.ParquetWriter(f"{folder}/part-{tag}-{files:05d}.parquet", batch.schema)
                held.append(batch.slice(0, max_rows - done))
                batch, done = batch.slice(max_rows - done), done + held[-1].num_rows
                if done == max_rows or sum(b.num_rows for b in held) >= GROUP_ROWS:
                    flush()
                if done == max_rows:
                    writer.close()
                    writer, files, done = None, files + 1, 0
        flush()
        if writer:
            writer.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        home = f"{staging}/attempt-{attempt}"
        for key, group in groupby(runs(batches), key=itemgetter(0)):
            write(f"{home}/{_folder_name(by, key)}", attempt, map(itemgetter(1), group))
        if os.path.isdir(home):
            yield pa.RecordBatch.from_pydict({"home": [home]})

    try:
        os.makedirs(f"{staging}/all")
        for row in sorted_rows.mapInArrow(run, "home string").collect():
            for folder in os.scandir(row["home"]):
                _move(folder.path, f"{staging}/all/{folder.name}")
        open(f"{staging}/all/_SUCCESS", "w").close()
        if os.path.lexists(path):
            os.rename(path, f"{staging}/before")
        os.rename(f"{staging}/all", path)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def _move(folder: str, target: str) -> None:
    """Move a folder; the files of one that stands there already, as several tasks hold its key, join it."""
    try:
        os.rename(folder, target)
    except OSError:
        for file in os.scandir(folder):
            os.rename(file.path, f"{target}/{file.name}")


def read_partitioned(spark: SparkSession, path: str, schema: StructType, tasks_per_core: int = 4, by: str = "device") -> DataFrame:
    """The table below ``path`` as ``write_partitioned`` left it.

    A folder is listed in a task of its own by default, up to 10,000 of them, which takes longer than the
    listing itself; here a few tasks a core share the folders. The session's setting is put back. The key is taken from the
    path of a file: Spark's own discovery of the folders takes time that grows with the square of their number.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(tasks_per_core * spark.sparkContext.defaultParallelism))
    try:
        inner = StructType([f for f in schema.fields if f.name != by])
        rows = spark.read.schema(inner).option("recursiveFileLookup", True).parquet(path)  # lists at once
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    # The path is a URI of a name that is escaped itself.
    value = F.regexp_extract(F.col("_metadata.file_path"), "=([^/]*)/[^/]*$", 1)
    for _ in range(2):
        value = F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    value = F.when(value != "__HIVE_DEFAULT_PARTITION__", value).cast(schema[by].dataType)
    return rows.select(*[value.alias(by) if c == by else F.col(f"`{c}`") for c in schema.names])


def write_summary_csv(df: DataFrame, path: str) -> None:
    """CSV for small result tables."""
    df.write.mode("overwrite").option("header", True).csv(path)


def harmonize_columns(
    df: DataFrame, rules: Sequence[tuple[str, str]], drop_containing: Sequence[str] = ("Unnamed",)
) -> DataFrame:
    """Rename the first column containing each rule's text to its canonical name; drop index columns.

    A canonical name that is already present is left alone.
    """
    kept = [c for c in df.columns if not any(d in c for d in drop_containing)]
    renames: dict[str, str] = {}
    for text, canonical in rules:
        if canonical in kept or canonical in renames.values():
            continue
        hit = next((c for c in kept if text in c and c not in renames), None)
        if hit is not None:
            renames[hit] = canonical
    return df.select(*kept).withColumnsRenamed(renames)
