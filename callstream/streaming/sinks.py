"""Publishing records and printing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callstream.functions.messages import encode_calls
from callstream.streaming.queries import start_query
from callstream.workspace import hadoop_path


def publish_messages(
    calls: DataFrame,
    fmt: str = "kafka",
    checkpoint: str | None = None,
    trigger: str | None = None,
    **options: str,
) -> StreamingQuery | None:
    """Write each call as a JSON message to a topic or to files.

    ``options`` are those of the sink: ``topic`` and ``kafka.bootstrap.servers``, or
    ``path``. Returns the started query for streaming calls: with the same ``checkpoint`` a
    further run sends what is left. Into files each call is then written once; a topic gets a
    micro-batch that was cut short a second time, as Spark's sink has no transactions.
    """
    messages = encode_calls(calls)
    return send(messages, fmt, checkpoint, trigger, **options)


def send(
    messages: DataFrame,
    fmt: str,
    checkpoint: str | None = None,
    trigger: str | None = None,
    **options: str,
) -> StreamingQuery | None:
    """``publish_messages`` of rows that are messages already.

    A folder is filled by streams or by batches, not by both: once a stream has written to it,
    readers take the files that its log names and no others. Either is refused after the other.
    """
    if fmt == "text":
        messages = messages.select(F.col("value").cast("string").alias("value"))
    if "path" in options:
        _check_folder(messages, options["path"])
    if messages.isStreaming:
        return start_query(messages, "append", fmt, trigger, checkpoint, **options)
    messages.write.format(fmt).mode("append").options(**options).save()
    return None


def _check_folder(messages: DataFrame, path: str) -> None:
    spark = messages.sparkSession
    files, folder = hadoop_path(spark, path)
    _, log = hadoop_path(spark, f"{path}/_spark_metadata")
    if files.exists(log) and not messages.isStreaming:
        raise ValueError(f"{path} is filled by a stream: publish with its checkpoint")
    if messages.isStreaming and not files.exists(log) and files.exists(folder):
        if any(files.listStatus(folder)):
            raise ValueError(f"{path} is filled without a checkpoint: its files would not be seen")


def show_result(result: DataFrame, rows: int = 20, title: str = "") -> None:
    """Print the first ``rows`` rows, and how many there are besides."""
    kept = result.persist()
    try:
        more = kept.count() - rows
        show_batch(kept, rows, title)
        if more > 0:
            print(f"{more} more rows are not printed", flush=True)
    finally:
        kept.unpersist()


def print_messages(batch: DataFrame, batch_id: int) -> None:
    """Print every message: its offset and its value, or its raw text if that is broken.

    One partition after the other is fetched, not the whole batch.
    """
    for row in batch.select("offset", "text").toLocalIterator():
        print(row["offset"], row["text"], flush=True)


def show_batch(batch: DataFrame, n: int = 10, title: str = "") -> None:
    """Print the first ``n`` rows, then "..." if there are more."""
    rows = batch.limit(n + 1).collect()
    lines = [title] if title else []
    lines += [str(tuple(row)) for row in rows[:n]]
    if len(rows) > n:
        lines.append("...")
    print(*lines, sep="\n", flush=True)
