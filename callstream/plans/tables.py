"""The test tables as messages, call records and a code table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callstream.schemas import CALL_TIME, CALL_TYPE, CALLS, CRIME_ID, DESCRIPTION, DISPOSITION


# Declared, as a stream needs them and a batch read then opens no file to infer them.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, props string"
NATION = "n_nationkey int, n_regionkey int"
REGION = "r_regionkey int, r_name string"

# What one micro-batch takes in: a watermark moves, and state leaves, between batches.
MAX_BYTES = 64 << 30


def events(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    if not streaming:
        return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    # As a glob: a file stream does not take the path of a single file.
    reader = spark.readStream.schema(EVENTS).option("maxBytesPerTrigger", MAX_BYTES)
    return reader.parquet(f"{sf_dir}/events.parque[t]")


def events_in_files(
    spark: SparkSession, sf_dir: str, path: str, first: int = 0, last: int = 4, parts: int = 4
) -> None:
    """Write the parts ``first`` to ``last`` of the events, cut evenly by ``ts``, as files of
    rising age below ``path``."""
    table = events(spark, sf_dir)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = table.agg(F.min(micros), F.max(micros)).first()
    step = (high - low) // parts + 1
    for part in range(first, last):
        inside = micros.between(low + part * step, low + (part + 1) * step - 1)
        table.where(inside).write.mode("append").parquet(path)


def calls_of_files(spark: SparkSession, path: str, max_files: int = 1, **shape) -> DataFrame:
    """The written events as a stream of calls, few files per micro-batch."""
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files)
    return calls_from_events(reader.parquet(path), **shape)


def calls_from_events(
    table: DataFrame, call_type: str = "event_type", time_unit: str | None = None
) -> DataFrame:
    """Events in the shape of call records.

    ``time_unit`` truncates the call time, which makes repeated calls.
    """
    time = F.col("ts").cast("timestamp")
    day = F.date_trunc("day", time)
    known = {
        CRIME_ID: F.col("event_id"),
        CALL_TYPE: F.col(call_type),
        "report_date": day,
        "call_date": day,
        "offense_date": day,
        "call_time": F.date_format(time, "HH:mm"),
        CALL_TIME: time if time_unit is None else F.date_trunc(time_unit, time),
        DISPOSITION: F.col("k"),
    }
    # A generator, as in `parse_calls`: filters on the code do not parse it again.
    return table.select("*", F.json_tuple("props", "k").alias("k")).select(
        *[
            known.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in CALLS
        ]
    )


def calls(spark: SparkSession, sf_dir: str, streaming: bool = False, **shape) -> DataFrame:
    return calls_from_events(events(spark, sf_dir, streaming), **shape)


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as disposition codes, their regions as descriptions."""
    nation = spark.read.schema(NATION).parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.schema(REGION).parquet(f"{sf_dir}/region.parquet")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias(DISPOSITION),
        F.col("r_name").alias(DESCRIPTION),
    )


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without a time zone, as the test tables hold them."""
    return df.select(
        *[
            F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(name)
            for name, kind in df.dtypes
        ]
    )
