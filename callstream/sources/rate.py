"""Rate-limited synthetic calls, for load trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callstream.schemas import CALL_TIME, CALL_TYPE, CRIME_ID, DISPOSITION


def rate_calls(
    spark: SparkSession,
    call_types: list[str],
    dispositions: list[str],
    rows_per_second: int = 5,
    num_partitions: int = 1,
) -> DataFrame:
    """A stream of ``rows_per_second`` calls that cycles through the given values."""
    ticks = (
        spark.readStream.format("rate")
        .option("rowsPerSecond", rows_per_second)
        .option("numPartitions", num_partitions)
        .load()
    )

    def cycle(values: list[str]):
        index = F.pmod(F.col("value"), F.lit(len(values))).cast("int")
        return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)

    return ticks.select(
        F.col("value").cast("string").alias(CRIME_ID),
        cycle(call_types).alias(CALL_TYPE),
        F.col("timestamp").alias(CALL_TIME),
        cycle(dispositions).alias(DISPOSITION),
    )
