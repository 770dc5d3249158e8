"""Messages, call records and code tables kept in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from callstream.schemas import CODES, DESCRIPTION, DISPOSITION
from callstream.streaming.state import files_read, one_spelling
from callstream.workspace import hadoop_path

# What Spark takes for a pattern of paths.
_PATTERN = set("*?[]{}")
_VALUE = StructType([StructField("value", BinaryType())])


def _as_glob(spark: SparkSession, path: str) -> str:
    """A single file as a pattern: a file stream takes folders and patterns only."""
    if _PATTERN & set(path):
        return path
    files, found = hadoop_path(spark, path)
    return f"{path[:-1]}[{path[-1]}]" if files.exists(found) and files.isFile(found) else path


def file_messages(
    spark: SparkSession,
    path: str,
    fmt: str = "text",
    streaming: bool = True,
    max_files: int | None = None,
    max_bytes: int | None = None,
    after: str | None = None,
) -> DataFrame:
    """Messages from JSON-lines text files, or from parquet files with a ``value``.

    ``max_files`` or ``max_bytes`` limits what one micro-batch admits. ``after`` names the
    checkpoint of a stopped query over the same folder alone: the files that it has read are left
    out. Name it again whenever the new query is resumed.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if streaming and max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if fmt != "text":
        reader = reader.schema(_VALUE)
    rows = reader.format(fmt).load(_as_glob(spark, path) if streaming else path)
    if after is not None:
        rows = rows.withColumn("_path", one_spelling(F.col("_metadata.file_path")))
        known = files_read(spark, after).withColumnRenamed("path", "_path")
        rows = rows.join(known, "_path", "left_anti")
    return rows.select(F.col("value").cast("binary").alias("value"))


def read_call_file(
    spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """Call records from a JSON array file (``multi_line``) or from JSON lines.

    Every field is read, with the type that its values have; a ``schema`` spares the
    pass that finds the types and leaves other fields out. Broken JSON is an error.
    One task streams through each array file, since arrays cannot be split; large
    inputs belong in JSON lines.
    """
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path, multiLine=multi_line)


def call_file_stream(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None
) -> DataFrame:
    """The same of JSON array files, each admitted once; broken JSON ends the query."""
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST").option("multiLine", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(_as_glob(spark, path))


def read_codes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The code table, renamed to join with call records. Broken JSON is an error: a table
    read in part would let the join drop calls."""
    codes = spark.read.schema(CODES).option("mode", "FAILFAST").json(path, multiLine=multi_line)
    return codes.withColumnsRenamed({"disposition_code": DISPOSITION, "description": DESCRIPTION})
