"""Batches cut by processing time, as the trigger of a running query makes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StringType, StructType, TimestampType

from callstream.operators.microbatch import fill_empty_batches, windowed_batch_counts
from callstream.schemas import CALL_TYPE
from callstream.streaming.queries import start_query
from callstream.streaming.sinks import show_batch
from callstream.streaming.tables import append_rows, read_latest

_SCHEMA = (
    StructType().add("batch_end", TimestampType()).add(CALL_TYPE, StringType()).add("count", LongType())
)
_MICROS = 1_000_000


def live_type_counts(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The counts written by ``start_live_counts``, ready for the batch operators."""
    return read_latest(spark, path, _SCHEMA, version)


def live_batch_counts(spark: SparkSession, path: str, trigger: str = "5 seconds") -> DataFrame:
    """Calls per ``trigger`` interval, 0 where a trigger found no input. A batch has
    the time of its trigger, which ends the interval that it took in."""
    interval = F.window("batch_end", trigger).alias("window")
    counted = (
        live_type_counts(spark, path)
        .groupBy(interval)
        .agg(F.sum("count").alias("count"))
        .select(F.col("window.start").alias("batch_end"), "count")
    )
    return fill_empty_batches(counted, trigger)


def start_live_counts(
    calls: DataFrame,
    path: str,
    trigger: str | None = "5 seconds",
    checkpoint: str | None = None,
    top: int = 3,
    length: int = 60,
    slide: int = 15,
    report: bool = True,
) -> StreamingQuery:
    """Count the types of each micro-batch into a table, and print what came in.

    Printed per batch: how many calls, the ``top`` types, and the first rows of each
    window of ``length`` seconds that has closed. The batches are layers of one table
    (``tables.append_rows``): a repeated batch is there once, and readers see whole
    batches. A trigger without input makes no batch.
    """
    spark = calls.sparkSession
    # The time of a micro-batch is kept in its offset log: a repeat counts the same.
    timed = calls.select(CALL_TYPE, F.current_timestamp().alias("batch_end"))
    last: list[int] = []  # the end of the batch before

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("batch_end", CALL_TYPE).count()
        folder = append_rows(counts, path, batch_id)
        if not report:
            return
        written = spark.read.schema(_SCHEMA).parquet(f"{path}/{folder}") if folder else counts
        total, end = _totals(written)
        print(f"Events in this batch: {total}", flush=True)
        ranked = written.select(CALL_TYPE, "count").orderBy(F.desc("count"), CALL_TYPE)
        show_batch(ranked, top)
        if end is None:
            return
        table = live_type_counts(spark, path)
        if not last:
            earlier = table.where(F.col("batch_end") < F.timestamp_micros(F.lit(end)))
            last.append(_totals(earlier)[1] or end)
        before, last[0] = last[0], max(end, last[0])
        if end // (slide * _MICROS) > before // (slide * _MICROS):
            since = F.timestamp_micros(F.lit(before - length * _MICROS))
            _print_windows(table.where(F.col("batch_end") > since), before, end, length, slide)

    return start_query(timed, "append", write, trigger, checkpoint)


class EmptyTriggers(StreamingQueryListener):
    """Prints a count of 0 for a query that found no input.

    Spark reports an idle query every ``spark.sql.streaming.noDataProgressEventInterval``
    milliseconds: set that to the trigger for a line per empty trigger.
    """

    def __init__(self, query_id: str):
        self.query_id = query_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        if str(event.id) == self.query_id:
            print("Events in this batch: 0", flush=True)

    def onQueryTerminated(self, event) -> None:
        pass


def _totals(counts: DataFrame) -> tuple[int, int | None]:
    """Calls in the batches of ``counts``, and the last batch time in microseconds."""
    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)), F.unix_micros(F.max("batch_end"))
    ).first()


def _print_windows(counts: DataFrame, before: int, end: int, length: int, slide: int) -> None:
    """Print the windows that closed after ``before``, up to ``end``, each with its
    oldest batch first and the most frequent types of a batch first."""
    windowed = windowed_batch_counts(counts, f"{length} seconds", f"{slide} seconds")
    micros = F.unix_micros("window_end")
    closed = windowed.where((micros > before) & (micros <= end))
    ends = closed.groupBy(micros.alias("at")).agg(F.first(F.col("window_end").cast("string")))
    for at, text in sorted(tuple(row) for row in ends.collect()):
        listed = closed.where(micros == at).orderBy("batch_end", F.desc("count"), CALL_TYPE)
        show_batch(listed.select(CALL_TYPE, "count"), title=f"Window to {text}:")
