"""Per-batch counts, with a batch taken as a tumbling event-time window.

Batches made of event time give the same result on every run. Counts of batches that
were cut by processing time come from ``callstream.streaming.live``; the operators
that take ``counts`` work on either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstream.functions.intervals import interval_micros
from callstream.schemas import CALL_TIME, CALL_TYPE

BATCH = "5 seconds"
LENGTH = "60 seconds"
SLIDE = "15 seconds"
_CHUNK = 10_000


def batch_counts(calls: DataFrame, batch: str = BATCH) -> DataFrame:
    """Calls per batch, 0 for the empty batches in between. Batch input only."""
    counted = (
        calls.groupBy(F.window(CALL_TIME, batch).alias("window"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("window.end").alias("batch_end"), "count")
    )
    return fill_empty_batches(counted, batch)


def fill_empty_batches(counted: DataFrame, batch: str = BATCH) -> DataFrame:
    """``counted`` (batch_end, count) with a 0 for each batch that it skips.

    The grid of batches grows with the time span, not with the calls; it is made in
    chunks, so that no single row holds it, and enters the sum as zeros.
    """
    # The count takes part in the bounds, so that both uses of `counted` need the
    # same columns and share one shuffle instead of reading the input twice.
    end = F.when(F.col("count") > 0, F.col("batch_end"))
    bounds = counted.agg(F.min(end).alias("low"), F.max(end).alias("high"))
    step = f"INTERVAL {batch}"
    chunks = bounds.where("low IS NOT NULL").select(
        "high", F.expr(f"explode(sequence(low, high, {step} * {_CHUNK}))").alias("low")
    )
    # Otherwise the one task that knows the bounds would make the whole grid.
    grid = chunks.repartition("low").select(
        F.expr(f"explode(sequence(low, least(high, low + {step} * {_CHUNK - 1}), {step}))").alias(
            "batch_end"
        ),
        F.lit(0).cast("long").alias("count"),
    )
    total = F.sum("count").alias("count")
    return counted.unionByName(grid).groupBy("batch_end").agg(total)


def batch_count_lines(counts: DataFrame) -> DataFrame:
    """``batch_counts`` with the printed form of each count."""
    line = F.format_string("Events in this batch: %s", F.col("count"))
    return counts.withColumn("line", line)


def batch_type_counts(
    calls: DataFrame, batch: str = BATCH, watermark: str | None = None
) -> DataFrame:
    """Calls per batch and type.

    A stream in append mode needs a ``watermark`` and gives a batch once, when the
    watermark has passed it; in update mode it gives every batch, the last ones too.
    """
    if watermark is not None:
        calls = calls.withWatermark(CALL_TIME, watermark)
    return (
        calls.groupBy(F.window(CALL_TIME, batch).alias("window"), CALL_TYPE)
        .count()
        .select(F.col("window.end").alias("batch_end"), CALL_TYPE, "count")
    )


def sorted_types(counts: DataFrame) -> DataFrame:
    """The counts of each batch, most frequent type first. Batch input only."""
    return counts.orderBy("batch_end", F.desc("count"), CALL_TYPE)


def batch_top_types(counts: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent types of each batch. Batch input only."""
    order = Window.partitionBy("batch_end").orderBy(F.desc("count"), CALL_TYPE)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def windowed_batch_counts(
    counts: DataFrame, length: str = LENGTH, slide: str = SLIDE
) -> DataFrame:
    """The per-batch counts in each sliding window of batches, listed, not summed.

    Windows end at the multiples of ``slide``. A batch belongs to a window
    (end - length, end], so one that ends with the window is part of it. No shuffle:
    each row is repeated once per window.
    """
    first = -interval_micros(length) % interval_micros(slide)
    inside = F.col("batch_end") - F.expr("INTERVAL 1 MICROSECOND")
    window = F.window(inside, length, slide, f"{first} microseconds")
    return counts.withColumn("window", window).select(
        F.col("window.end").alias("window_end"), "batch_end", CALL_TYPE, "count"
    )


def windowed_batch_head(windowed: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows of each window: oldest batch first, then most frequent
    type. Batch input only."""
    order = Window.partitionBy("window_end").orderBy("batch_end", F.desc("count"), CALL_TYPE)
    return windowed.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= n
    )
