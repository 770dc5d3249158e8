"""The whole jobs: count a topic, report its batches, fill it, look into it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from callstream.functions.messages import parse_calls, parse_or_keep, tail_messages
from callstream.operators.counts import PAIR, description_counts, pair_counts
from callstream.operators.lookups import BROADCAST_BYTES, BROADCAST_ROWS
from callstream.schemas import CALL_TIME, CALL_TYPE, DESCRIPTION, narrowed
from callstream.sources import call_file_stream, file_messages, read_call_file
from callstream.streaming.live import EmptyTriggers, start_live_counts
from callstream.streaming.queries import AVAILABLE_NOW, start_query
from callstream.streaming.sinks import print_messages, publish_messages, send, show_result
from callstream.streaming.tables import append_rows, read_latest, write_latest
from callstream.workspace import scratch_dir

Deliver = Callable[[str, DataFrame, int], None]


def start_description_counts(
    calls: DataFrame,
    codes: DataFrame,
    deliver: Deliver,
    trigger: str | None = None,
    checkpoint: str | None = None,
    **bounds: int,
) -> StreamingQuery:
    """Count per (type, description) of a stream, handed as ("description_counts", counts,
    batch id) to ``deliver`` after each micro-batch.

    The state holds the pairs found so far, of which there are few; each micro-batch joins
    them with the code table as it is then. So a query may be resumed with another code
    table, larger or smaller, and its counts are those of the batch form. ``bounds`` are
    ``max_rows`` and ``max_bytes`` of a table that is broadcast.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counted = description_counts(batch, codes, **bounds)
        deliver("description_counts", counted, batch_id)

    return start_query(pair_counts(calls), "complete", write, trigger, checkpoint)


def run_description_counts(
    calls: DataFrame,
    codes: DataFrame,
    path: str | None = None,
    checkpoint: str | None = None,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The same over the input at hand; with the ``path`` and ``checkpoint`` of an earlier
    run, over that of both."""
    spark = calls.sparkSession
    path = path or scratch_dir(spark, "descriptions")
    deliver = into_tables(path)
    bounds = {"max_rows": max_rows, "max_bytes": max_bytes}
    start_description_counts(
        calls, codes, deliver, AVAILABLE_NOW, checkpoint, **bounds
    ).awaitTermination()
    schema = f"{CALL_TYPE} string, {DESCRIPTION} string, count long"
    return read_latest(spark, f"{path}/description_counts", StructType.fromDDL(schema))


def into_tables(path: str) -> Deliver:
    """Keep each result as a table below ``path``; read it with ``read_latest``."""

    def deliver(name: str, result: DataFrame, batch_id: int) -> None:
        write_latest(result, f"{path}/{name}", batch_id)

    return deliver


def onto_console(rows: int = 20) -> Deliver:
    """Print the first ``rows`` groups of each result, and how many are left out."""

    def deliver(name: str, result: DataFrame, batch_id: int) -> None:
        show_result(result, rows, f"{name}, batch {batch_id}:")

    return deliver


def start_call_statistics(
    messages: DataFrame,
    codes: DataFrame,
    deliver: Deliver | None = None,
    trigger: str | None = None,
    checkpoint: str | None = None,
    dedup: bool = True,
) -> list[StreamingQuery]:
    """Two queries over one stream: counts per code and counts per description.

    Pass the queries to ``run_all``. To resume, name the same ``checkpoint``. Printed
    unless ``deliver`` says otherwise.
    """
    checkpoint = checkpoint or scratch_dir(messages.sparkSession, "statistics")
    deliver = deliver or onto_console()
    calls = parse_calls(messages, PAIR)

    def write(batch: DataFrame, batch_id: int) -> None:
        deliver("pair_counts", batch, batch_id)

    return [
        start_query(
            pair_counts(calls, dedup), "complete", write, trigger, f"{checkpoint}/pair_counts"
        ),
        start_description_counts(
            calls, codes, deliver, trigger, f"{checkpoint}/description_counts"
        ),
    ]


def start_statistics_tables(
    messages: DataFrame,
    codes: DataFrame,
    path: str,
    trigger: str | None = None,
    checkpoint: str | None = None,
    dedup: bool = True,
) -> StreamingQuery:
    """Both counts from one query into the tables ``pair_counts`` and
    ``description_counts`` below ``path``; read them with ``read_latest``.

    Reads and parses the stream once, where two queries do so twice: descriptions
    are counted from the pairs found so far, of which there are few.
    """
    spark = messages.sparkSession
    pairs = pair_counts(parse_calls(messages, PAIR), dedup)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_latest(batch, f"{path}/pair_counts", batch_id)
        found = read_latest(spark, f"{path}/pair_counts", pairs.schema).select(*PAIR)
        counted = description_counts(found, codes)
        write_latest(counted, f"{path}/description_counts", batch_id)

    return start_query(pairs, "complete", write, trigger, checkpoint)


#: What ``start_message_table`` observes of each micro-batch, and under which name.
OBSERVED = "messages"
OBSERVED_SCHEMA = "events long, broken long, without_time long"


def start_message_table(
    messages: DataFrame,
    path: str,
    trigger: str | None = None,
    checkpoint: str | None = None,
    fields: list[str] | None = None,
) -> StreamingQuery:
    """Keep every message: the parsed calls and, beside them, the text of what does not parse.

    Both go into one table, by one write of each micro-batch, so that a repeated one leaves
    neither out nor doubles it; read them with ``parsed_calls`` and ``broken_messages``. In the
    same pass each micro-batch is observed: its messages, the broken ones, and the calls without
    a time (of ``fields`` that have one); see ``queries.observed_table``.
    """
    rows = parse_or_keep(messages, fields)

    def number(condition) -> Column:
        return F.coalesce(F.count_if(condition), F.lit(0))

    no_time = F.col(CALL_TIME).isNull() if CALL_TIME in rows.columns else F.lit(False)
    watched = rows.observe(
        OBSERVED,
        F.count(F.lit(1)).alias("events"),
        number(F.col("broken")).alias("broken"),
        number(~F.col("broken") & no_time).alias("without_time"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        append_rows(batch, path, batch_id)

    return start_query(watched, "append", write, trigger, checkpoint)


def _message_table(spark: SparkSession, path: str, fields: list[str] | None) -> DataFrame:
    schema = StructType([*narrowed(fields), *StructType.fromDDL("broken boolean, offset long, text string")])
    return read_latest(spark, path, schema)


def parsed_calls(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """The calls of a table written by ``start_message_table`` with these ``fields``."""
    return _message_table(spark, path, fields).where("NOT broken").drop("broken", "offset", "text")


def broken_messages(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Offset and text of the messages that did not parse."""
    return _message_table(spark, path, fields).where("broken").select("offset", "text")


def start_call_report(
    messages: DataFrame,
    table: str | None = None,
    trigger: str | None = "5 seconds",
    checkpoint: str | None = None,
    **report: int,
) -> StreamingQuery:
    """Print and keep the type counts of every batch of the stream. ``report`` takes
    ``top``, and ``length`` and ``slide`` of the windows in seconds."""
    table = table or scratch_dir(messages.sparkSession, "live-counts")
    calls = parse_calls(messages, [CALL_TYPE])
    query = start_live_counts(calls, table, trigger, checkpoint, **report)
    messages.sparkSession.streams.addListener(EmptyTriggers(str(query.id)))
    return query


def publish_file(
    spark: SparkSession, file: str, fmt: str = "kafka", multi_line: bool = True, **options: str
) -> None:
    """Publish a record file: a JSON array, each record with all its fields, or JSON lines,
    which go out as they are."""
    if multi_line:
        publish_messages(read_call_file(spark, file), fmt, **options)
        return
    send(file_messages(spark, file, streaming=False), fmt, **options)


def start_publishing(
    spark: SparkSession,
    files: str,
    checkpoint: str,
    fmt: str = "kafka",
    multi_line: bool = True,
    schema: StructType | None = None,
    max_files: int | None = None,
    trigger: str | None = AVAILABLE_NOW,
    **options: str,
) -> StreamingQuery:
    """``publish_file`` that may be repeated: a record file, or a folder of them, as a stream.

    Run again with the same ``checkpoint`` it sends the files that are new or were not reached, and
    nothing twice (but see ``publish_messages`` for a topic). ``max_files`` go out at a time. A
    ``schema`` spares array files the pass that finds their fields.
    """
    if multi_line:
        schema = schema or read_call_file(spark, files).schema
        records = call_file_stream(spark, files, schema, max_files)
        return publish_messages(records, fmt, checkpoint, trigger, **options)
    return send(file_messages(spark, files, max_files=max_files), fmt, checkpoint, trigger, **options)


def start_tail(
    messages: DataFrame, trigger: str | None = None, checkpoint: str | None = None
) -> StreamingQuery:
    """Print offset and text of every message, from the first one on."""
    return start_query(tail_messages(messages), "append", print_messages, trigger, checkpoint)
