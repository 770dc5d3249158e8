"""Counts per call type and outcome over the whole input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callstream.operators.distinct import distinct_rows, distinct_within, first_seen
from callstream.operators.lookups import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    CodeTableSize,
    with_description,
)
from callstream.schemas import CALL_TIME, CALL_TYPE, DESCRIPTION, DISPOSITION

PAIR = [CALL_TYPE, DISPOSITION]


def distinct_pairs(calls: DataFrame) -> DataFrame:
    """Distinct (type, disposition) pairs. Output mode update: a pair comes out once."""
    return first_seen(calls, PAIR) if calls.isStreaming else distinct_rows(calls, PAIR)


def distinct_pairs_within(calls: DataFrame, horizon: str = "60 minutes") -> DataFrame:
    """Distinct pairs of a stream without end, with the time they are seen at: one that has not
    come out for ``horizon`` may come out again, and its state leaves (``distinct_within``)."""
    return distinct_within(calls, PAIR, CALL_TIME, horizon)


def pair_counts(calls: DataFrame, dedup: bool = True) -> DataFrame:
    """Count per (type, disposition): of distinct pairs, or of calls without ``dedup``.

    Grouping distinct pairs by themselves counts 1 each, so the deduplicated form is
    one aggregate that yields 1. Either way calls are combined before the shuffle
    and the state is one row per pair. Output mode complete or update.
    """
    one = F.lit(1).cast("long")
    count = F.max(one) if dedup else F.count(one)
    return calls.groupBy(*PAIR).agg(count.alias("count"))


def pair_counts_from(calls: DataFrame, earlier: DataFrame, dedup: bool = True) -> DataFrame:
    """``pair_counts`` that goes on from the counts of an ``earlier`` query: its pairs and ``count``.

    For a stream, ``earlier`` is a stream too (``earlier_counts``): its rows come in with the first
    micro-batch and are in the state from then on.
    """
    one = F.lit(1).cast("long")
    new = calls.select(*PAIR, one.alias("_calls"))
    old = earlier.select(*PAIR, F.col("count").alias("_calls"))
    count = F.max(one) if dedup else F.sum("_calls")
    return new.unionByName(old).groupBy(*PAIR).agg(count.alias("count"))


def earlier_counts(spark: SparkSession, path: str) -> DataFrame:
    """The state of a pair count, written by ``state.write_state``, as a stream of counts.

    The column of the count is named after the aggregate that kept it.
    """
    schema = spark.read.parquet(path).schema
    (count,) = [name for name in schema.names if name not in PAIR]
    return spark.readStream.schema(schema).parquet(path).withColumnRenamed(count, "count")


def description_counts(
    calls: DataFrame,
    codes: DataFrame,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    size: CodeTableSize | None = None,
) -> DataFrame:
    """Count per (type, description) of the distinct pairs whose code is known.

    Batch input only. A stream keeps its pairs and counts them per micro-batch
    (``jobs.start_description_counts``): with descriptions in its state, a code table
    that changes would leave counts of the old one there.
    """
    if calls.isStreaming:
        raise ValueError("count the descriptions of a stream by jobs.start_description_counts")
    known = distinct_pairs(calls.where(F.col(DISPOSITION).isNotNull()))
    joined = with_description(known, codes, max_rows, max_bytes, size)
    return joined.groupBy(CALL_TYPE, DESCRIPTION).count()
