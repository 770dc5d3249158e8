"""Starting streaming queries, running them to a table, and watching them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import StreamingQueryProgress

from callstream.streaming.tables import merge_latest, read_latest, write_latest
from callstream.workspace import scratch_dir

AVAILABLE_NOW = "available now"

# For the caller's session where state outgrows executor memory: state on local disk,
# with only the changes of each micro-batch written to the checkpoint. Not to track row
# totals (stateStore.rocksdb.trackTotalNumberOfRows) is faster, but leaves `state_rows` 0.
LARGE_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

PROGRESS_SCHEMA = (
    "batch_id long, timestamp string, input_rows long, rows_per_second double, "
    "duration_ms long, state_rows long, rows_dropped_by_watermark long"
)


def start_query(
    df: DataFrame,
    mode: str = "complete",
    sink: str | Callable[[DataFrame, int], None] = "console",
    trigger: str | None = None,
    checkpoint: str | None = None,
    name: str | None = None,
    **options: str,
) -> StreamingQuery:
    """Start ``df`` into ``sink``: a format name, or a function of (batch, batch id).

    ``trigger`` is an interval such as ``"5 seconds"``, ``AVAILABLE_NOW`` for a run
    that ends with the input at hand, or None to follow one batch with the next.
    ``checkpoint`` must name the same folder again to resume a query; without one
    a new folder is taken.
    """
    checkpoint = checkpoint or scratch_dir(df.sparkSession, "checkpoint")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if sink == "console":
        options.setdefault("truncate", "false")
    writer = writer.options(**options)
    writer = writer.foreachBatch(sink) if callable(sink) else writer.format(sink)
    if name is not None:
        writer = writer.queryName(name)
    if trigger == AVAILABLE_NOW:
        writer = writer.trigger(availableNow=True)
    elif trigger is not None:
        writer = writer.trigger(processingTime=trigger)
    return writer.start()


def run_to_table(
    df: DataFrame,
    mode: str,
    keys: list[str] | None = None,
    path: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Run ``df`` over the input at hand and return its result, written as parquet.

    Append results are the rows written; complete results those of the last
    micro-batch; update results the last row per ``keys``: each micro-batch writes the rows
    that it changes, and layers of them are merged. With the ``path`` and
    ``checkpoint`` of an earlier run, the result is that of both.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark, "result")

    if mode == "append":
        start_query(df, mode, "parquet", AVAILABLE_NOW, checkpoint, path=path).awaitTermination()
        return spark.read.schema(df.schema).parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            write_latest(batch, path, batch_id)
        else:
            merge_latest(batch, path, batch_id, keys)

    start_query(df, mode, write, AVAILABLE_NOW, checkpoint).awaitTermination()
    return read_latest(spark, path, df.schema)


def run_all(queries: list[StreamingQuery], poll_seconds: float = 1.0) -> None:
    """Wait for all ``queries``; if one fails, stop the others and raise its error."""
    running = list(queries)
    try:
        while running:
            running = [q for q in running if not q.awaitTermination(poll_seconds)]
    finally:
        for query in queries:
            query.stop()


def _progress_row(progress: StreamingQueryProgress) -> tuple:
    return (
        progress.batchId,
        progress.timestamp,
        progress.numInputRows,
        progress.processedRowsPerSecond,
        progress.durationMs.get("triggerExecution"),
        sum(state.numRowsTotal for state in progress.stateOperators),
        sum(state.numRowsDroppedByWatermark for state in progress.stateOperators),
    )


def progress_table(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The recent micro-batches of ``query``, one row each: Spark keeps the last 100 (its
    ``spark.sql.streaming.numRecentProgressUpdates``). ``ProgressLog`` reports all."""
    rows = [_progress_row(progress) for progress in query.recentProgress]
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)


def observed_table(spark: SparkSession, query: StreamingQuery, name: str, schema: str) -> DataFrame:
    """What ``DataFrame.observe(name, ...)`` counted in each recent micro-batch of ``query``:
    ``batch_id`` and the metrics of ``schema``. The micro-batches are not read again."""
    rows = []
    for progress in query.recentProgress:
        found = progress.observedMetrics.get(name)
        if found is not None:
            rows.append((progress.batchId, *found))
    return spark.createDataFrame(rows, f"batch_id long, {schema}")


class ProgressLog(StreamingQueryListener):
    """Hands one row per micro-batch of any query to ``report``, as it ends; attach with
    ``spark.streams.addListener``. The columns are those of ``progress_table``."""

    def __init__(self, report: Callable[[tuple], None] = print):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.report(_progress_row(event.progress))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
