"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callstream.functions import messages as codec
from callstream.operators import counts, drift, lookups, microbatch, windows
from callstream.plans import jobs, tables
from callstream.plans.jobs import run_description_counts, start_statistics_tables
from callstream.schemas import CALL_TIME, CALL_TYPE, CALLS, CRIME_ID, DESCRIPTION, DISPOSITION
from callstream.sources import file_messages, read_call_file, read_codes
from callstream.streaming.live import live_type_counts, start_live_counts
from callstream.streaming.queries import (
    AVAILABLE_NOW,
    observed_table,
    progress_table,
    run_all,
    run_to_table,
    start_query,
)
from callstream.streaming.sinks import publish_messages
from callstream.streaming.state import read_state, state_operators, write_state
from callstream.streaming.tables import read_latest
from callstream.workspace import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]

# Batches, windows and slides at 60 times their live lengths: the test events are
# minutes apart, and shorter batches would nearly all be empty.
BATCH, LONG_BATCH, LENGTH, SLIDE = "5 minutes", "1 hour", "60 minutes", "15 minutes"
PAIR = counts.PAIR


def _messages(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    return codec.encode_calls(tables.calls(spark, sf_dir, streaming))


# Messages


def parse_calls(spark, sf_dir):
    return tables.plain_times(codec.parse_calls(_messages(spark, sf_dir)))


def parse_malformed(spark, sf_dir):
    """All messages of one type arrive broken."""
    text = _messages(spark, sf_dir).select(F.col("value").cast("string").alias("text"))
    broken = F.get_json_object("text", f"$.{CALL_TYPE}") == "error"
    value = F.when(broken, F.concat(F.lit("{bad "), F.col("text"))).otherwise(F.col("text"))
    messages = text.select(value.cast("binary").alias("value"))
    return tables.plain_times(codec.parse_calls(messages))


def _half_broken(messages):
    """The messages, those of one type with a text in front that makes them no JSON."""
    text = F.col("value").cast("string")
    broken = F.get_json_object(text, f"$.{CALL_TYPE}") == "error"
    value = F.when(broken, F.concat(F.lit("{bad "), text)).otherwise(text)
    return messages.select(value.cast("binary").alias("value"))


def _message_table(spark, sf_dir):
    path, fields = scratch_dir(spark, "messages"), [*PAIR, CALL_TIME]
    messages = codec.encode_calls(tables.calls_of_files(spark, _event_files(spark, sf_dir)))
    query = jobs.start_message_table(_half_broken(messages), path, AVAILABLE_NOW, fields=fields)
    query.awaitTermination()
    return query, path, fields


def kept_messages_stream(spark, sf_dir):
    """Parsed calls and the texts of broken ones, counted by type, over several micro-batches."""
    _, path, fields = _message_table(spark, sf_dir)
    parsed = jobs.parsed_calls(spark, path, fields)
    broken = jobs.broken_messages(spark, path, fields)
    kind = F.regexp_extract("text", f'"{CALL_TYPE}":"([^"]*)"', 1).alias(CALL_TYPE)
    found = [parsed.select(F.lit("parsed").alias("side"), CALL_TYPE, F.col(CALL_TIME).isNotNull().alias("timed"))]
    found.append(broken.select(F.lit("broken"), kind, F.lit(False)))
    return found[0].union(found[1]).groupBy("side", CALL_TYPE, "timed").count()


def observed_messages_stream(spark, sf_dir):
    """What the query itself counted in its micro-batches, added up."""
    query, _, _ = _message_table(spark, sf_dir)
    seen = observed_table(spark, query, jobs.OBSERVED, jobs.OBSERVED_SCHEMA)
    sums = [F.sum(name).alias(name) for name in ("events", "broken", "without_time")]
    return seen.agg(*sums, (F.count("*") > 1).alias("several"))


def published_messages(spark, sf_dir):
    """Published to files, read back and decoded field by field, NULLs still there."""
    path = scratch_dir(spark, "published")
    publish_messages(tables.calls(spark, sf_dir), "parquet", path=path)
    text = F.col("value").cast("string")
    sent = file_messages(spark, path, "parquet", streaming=False).select(text.alias("text"))
    keys = F.size(F.json_object_keys("text")).cast("long").alias("n_fields")
    decoded = sent.select(F.json_tuple("text", *CALLS.names).alias(*CALLS.names), keys)
    fields = [F.col(field.name).cast(field.dataType) for field in CALLS]
    return tables.plain_times(decoded.select(*fields, "n_fields"))


def published_records(spark, sf_dir):
    """A record file published as it is, every field as text, and then parsed."""
    lines, topic = scratch_dir(spark, "records"), scratch_dir(spark, "topic")
    publish_messages(tables.calls(spark, sf_dir), "text", path=lines)
    publish_messages(read_call_file(spark, lines, multi_line=False), "text", path=topic)
    return tables.plain_times(codec.parse_calls(file_messages(spark, topic, streaming=False)))


def published_resumed(spark, sf_dir):
    """Published three times with one checkpoint, with further files before the second run."""
    path, topic = scratch_dir(spark, "event-files"), scratch_dir(spark, "topic")
    checkpoint = scratch_dir(spark, "checkpoint")
    for first, last in ((0, 2), (2, 4), (4, 4)):
        tables.events_in_files(spark, sf_dir, path, first, last)
        calls = tables.calls_of_files(spark, path)
        publish_messages(calls, "text", checkpoint, AVAILABLE_NOW, path=topic).awaitTermination()
    return tables.plain_times(codec.parse_calls(file_messages(spark, topic, streaming=False)))


def _untyped_messages(events):
    """Calls, but for those of one type the events as they are, and for another one a number
    where the calls have text."""
    calls = tables.calls_from_events(events).select(F.col("*"), F.col(CALL_TYPE).alias("_kind"))
    number = F.col(CRIME_ID).cast("long")
    kinds = [
        calls.where("_kind NOT IN ('error', 'view')").drop("_kind"),
        calls.where("_kind = 'view'").withColumn(CRIME_ID, number).drop("_kind"),
        events.where("event_type = 'error'"),
    ]
    sent = [codec.encode_calls(kind) for kind in kinds]
    return sent[0].union(sent[1]).union(sent[2])


def schema_drift_untyped(spark, sf_dir):
    """Fields and types of the messages that are not declared."""
    messages = _untyped_messages(tables.events(spark, sf_dir))
    return drift.schema_drift(drift.message_fields(messages))


def schema_drift_batches(spark, sf_dir):
    """The same over several micro-batches."""
    path = _event_files(spark, sf_dir)
    reader = spark.readStream.schema(tables.EVENTS).option("maxFilesPerTrigger", 1)
    found = drift.message_fields(_untyped_messages(reader.parquet(path)))
    return drift.schema_drift(run_to_table(found, "complete"))


def tail_messages(spark, sf_dir):
    calls = tables.calls(spark, sf_dir)
    value = F.to_json(F.struct(*[F.col(name) for name in calls.columns])).cast("binary")
    offset = F.col(CRIME_ID).cast("long")
    messages = calls.select(offset.alias("offset"), value.alias("value"))
    return codec.tail_messages(messages).select(
        "offset",
        F.try_variant_get("value", "$.original_crime_type_name", "string").alias(CALL_TYPE),
        F.try_variant_get("value", "$.disposition", "string").alias(DISPOSITION),
        F.try_variant_get("value", "$.call_time", "string").alias("call_time"),
    )


def code_table(spark, sf_dir):
    path = scratch_dir(spark, "codes")
    table = tables.codes(spark, sf_dir).toDF("disposition_code", "description")
    table.write.json(path)
    return read_codes(spark, path, multi_line=False)


def code_table_array(spark, sf_dir):
    """From one JSON array, as the code table of the calls is kept. It is small."""
    path = scratch_dir(spark, "codes-array")
    table = tables.codes(spark, sf_dir).toDF("disposition_code", "description")
    rows = F.collect_list(F.struct(*table.columns))
    table.agg(F.to_json(rows).alias("value")).write.text(path)
    return read_codes(spark, path)


# Counts


def distinct_pairs(spark, sf_dir):
    return counts.distinct_pairs(tables.calls(spark, sf_dir))


def distinct_pairs_stream(spark, sf_dir):
    return run_to_table(counts.distinct_pairs(tables.calls(spark, sf_dir, True)), "update", PAIR)


def _event_files(spark, sf_dir):
    path = scratch_dir(spark, "event-files")
    tables.events_in_files(spark, sf_dir, path)
    return path


def distinct_pairs_batches(spark, sf_dir):
    """Over several micro-batches, each pair from the one that first has it."""
    calls = tables.calls_of_files(spark, _event_files(spark, sf_dir))
    return run_to_table(counts.distinct_pairs(calls), "update", PAIR)


HORIZON = "6 hours"


def distinct_pairs_within_stream(spark, sf_dir):
    """The pairs that come out of a stream with a horizon, and whether the times at which one
    came out are as far apart."""
    calls = tables.calls_of_files(spark, _event_files(spark, sf_dir))
    found = run_to_table(counts.distinct_pairs_within(calls, HORIZON), "append")
    before = F.lag(CALL_TIME).over(Window.partitionBy(*PAIR).orderBy(CALL_TIME))
    near = F.col(CALL_TIME) <= before + F.expr(f"INTERVAL {HORIZON}")
    spaced = found.select(*PAIR, F.coalesce(near, F.lit(False)).alias("near"))
    return spaced.groupBy(*PAIR).agg((~F.bool_or("near")).alias("apart"))


def pair_counts_distinct(spark, sf_dir):
    return counts.pair_counts(tables.calls(spark, sf_dir))


def pair_counts_distinct_stream(spark, sf_dir):
    return run_to_table(counts.pair_counts(tables.calls(spark, sf_dir, True)), "complete")


def pair_counts_occurrences(spark, sf_dir):
    return counts.pair_counts(tables.calls(spark, sf_dir), dedup=False)


def pair_counts_occurrences_stream(spark, sf_dir):
    found = counts.pair_counts(tables.calls(spark, sf_dir, True), dedup=False)
    return run_to_table(found, "update", PAIR)


def _moved(spark, sf_dir, dedup):
    """Counted over half of the messages, stopped, and gone on with 16 state partitions."""
    path, topic = scratch_dir(spark, "event-files"), scratch_dir(spark, "topic")
    publish, old, state = (scratch_dir(spark, name) for name in ("publish", "checkpoint", "state"))
    result, fewer, more = scratch_dir(spark, "moved"), spark.newSession(), spark.newSession()

    def send(first, last):
        tables.events_in_files(spark, sf_dir, path, first, last)
        calls = tables.calls_of_files(spark, path)
        publish_messages(calls, "parquet", publish, AVAILABLE_NOW, path=topic).awaitTermination()

    def calls(session, **after):
        messages = file_messages(session, topic, "parquet", max_files=1, **after)
        return codec.parse_calls(messages, PAIR)

    fewer.conf.set("spark.sql.shuffle.partitions", "4")
    more.conf.set("spark.sql.shuffle.partitions", "16")
    send(0, 2)
    found = counts.pair_counts(calls(fewer), dedup)
    start_query(found, "complete", "noop", AVAILABLE_NOW, old).awaitTermination()
    write_state(spark, old, state)
    send(2, 4)
    found = counts.pair_counts_from(
        calls(more, after=old), counts.earlier_counts(more, state), dedup
    )
    run_to_table(found, "complete", path=result)
    return read_latest(spark, result, found.schema)


def pair_counts_moved_distinct(spark, sf_dir):
    return _moved(spark, sf_dir, True)


def pair_counts_moved_occurrences(spark, sf_dir):
    return _moved(spark, sf_dir, False)


def state_table(spark, sf_dir):
    """The state of a pair count as a table, with the number of its partitions."""
    checkpoint = scratch_dir(spark, "checkpoint")
    calls = tables.calls_of_files(spark, _event_files(spark, sf_dir))
    found = counts.pair_counts(calls, dedup=False)
    start_query(found, "complete", "noop", AVAILABLE_NOW, checkpoint).awaitTermination()
    kept = state_operators(spark, checkpoint).first()
    inside = F.col("partition_id") < kept["numPartitions"]
    return read_state(spark, checkpoint).select(
        *PAIR, "count", F.lit(kept["operatorName"]).alias("operator"), inside.alias("inside")
    )


def description_counts(spark, sf_dir):
    return counts.description_counts(tables.calls(spark, sf_dir), tables.codes(spark, sf_dir))


def description_counts_messages(spark, sf_dir):
    """The whole job as a stream: JSON messages, parsed, joined and counted."""
    calls = codec.parse_calls(_messages(spark, sf_dir, True), PAIR)
    return run_description_counts(calls, tables.codes(spark, sf_dir))


def description_counts_topic(spark, sf_dir):
    """The same, with the messages published to files first and read from there."""
    topic = scratch_dir(spark, "topic")
    publish_messages(tables.calls(spark, sf_dir), "text", path=topic)
    calls = codec.parse_calls(file_messages(spark, topic, max_bytes=tables.MAX_BYTES), PAIR)
    return run_description_counts(calls, tables.codes(spark, sf_dir))


def description_counts_resumed(spark, sf_dir):
    """Stopped, and resumed with further files and a code table that has grown."""
    path, checkpoint = scratch_dir(spark, "resumed"), scratch_dir(spark, "checkpoint")
    files, codes = scratch_dir(spark, "event-files"), tables.codes(spark, sf_dir)
    for first, table in ((0, codes.where(F.col(DISPOSITION) < "2")), (2, codes)):
        tables.events_in_files(spark, sf_dir, files, first, first + 2)
        calls = tables.calls_of_files(spark, files)
        found = run_description_counts(calls, table, path, checkpoint)
    return found


def call_statistics(spark, sf_dir):
    """Both counts of one stream by two queries, which run together."""
    path = scratch_dir(spark, "call-statistics")
    messages = codec.encode_calls(tables.calls_of_files(spark, _event_files(spark, sf_dir)))
    deliver = jobs.into_tables(path)
    codes = tables.codes(spark, sf_dir)
    run_all(jobs.start_call_statistics(messages, codes, deliver, AVAILABLE_NOW))
    found = []
    for name, value in (("pair_counts", DISPOSITION), ("description_counts", DESCRIPTION)):
        schema = StructType.fromDDL(f"{CALL_TYPE} string, {value} string, count long")
        rows = read_latest(spark, f"{path}/{name}", schema)
        result, value = F.lit(name).alias("result"), F.col(value).alias("value")
        found.append(rows.select(result, CALL_TYPE, value, "count"))
    return found[0].union(found[1])


def query_progress(spark, sf_dir):
    """What the progress of a query says it has read, added up over its micro-batches."""
    calls = tables.calls_of_files(spark, _event_files(spark, sf_dir))
    query = start_query(counts.pair_counts(calls), "complete", "noop", AVAILABLE_NOW)
    query.awaitTermination()
    progress = progress_table(spark, query)
    rows, several = F.sum("input_rows").alias("input_rows"), (F.count("*") > 1).alias("several")
    return progress.where("input_rows > 0").agg(rows, several)


def description_counts_table(spark, sf_dir):
    """As kept by the job that counts pairs and descriptions in one query."""
    path = scratch_dir(spark, "statistics")
    codes = tables.codes(spark, sf_dir)
    messages = _messages(spark, sf_dir, True)
    start_statistics_tables(messages, codes, path, AVAILABLE_NOW).awaitTermination()
    schema = f"{CALL_TYPE} string, {DESCRIPTION} string, count long"
    return read_latest(spark, f"{path}/description_counts", StructType.fromDDL(schema))


def description_counts_by_user(spark, sf_dir):
    calls = tables.calls(spark, sf_dir, call_type="user_id")
    return counts.description_counts(calls, tables.codes(spark, sf_dir))


def description_counts_by_user_stream(spark, sf_dir):
    calls = tables.calls(spark, sf_dir, True, call_type="user_id")
    return run_description_counts(calls, tables.codes(spark, sf_dir))


def description_counts_by_user_large_table(spark, sf_dir):
    """With a code table held too large to broadcast."""
    calls = tables.calls(spark, sf_dir, call_type="user_id")
    return counts.description_counts(calls, tables.codes(spark, sf_dir), max_rows=0)


def description_counts_by_user_large_table_stream(spark, sf_dir):
    calls = tables.calls(spark, sf_dir, True, call_type="user_id")
    return run_description_counts(calls, tables.codes(spark, sf_dir), max_rows=0)


# Join without an aggregate


def calls_with_description(spark, sf_dir):
    joined = lookups.with_description(tables.calls(spark, sf_dir), tables.codes(spark, sf_dir))
    return tables.plain_times(joined)


def calls_with_description_stream(spark, sf_dir):
    calls = tables.calls(spark, sf_dir, True)
    joined = lookups.with_description(calls, tables.codes(spark, sf_dir))
    return tables.plain_times(run_to_table(joined, "append"))


def calls_with_description_large_table(spark, sf_dir):
    calls = tables.calls(spark, sf_dir)
    joined = lookups.with_description(calls, tables.codes(spark, sf_dir), max_rows=0)
    return tables.plain_times(joined)


# Event-time windows


def sliding_counts(spark, sf_dir):
    return tables.plain_times(windows.sliding_pair_counts(tables.calls(spark, sf_dir)))


def sliding_counts_occurrences(spark, sf_dir):
    calls = tables.calls(spark, sf_dir, time_unit="hour")
    return tables.plain_times(windows.sliding_pair_counts(calls, dedup=False))


def sliding_counts_hourly(spark, sf_dir):
    """Call times cut to the hour, which makes repeated calls to count once."""
    calls = tables.calls(spark, sf_dir, time_unit="hour")
    return tables.plain_times(windows.sliding_pair_counts(calls))


def _sliding_stream(spark, sf_dir, mode, keys=None, dedup=True, **shape):
    calls = tables.calls(spark, sf_dir, True, **shape)
    found = windows.sliding_pair_counts(calls, dedup=dedup, output_mode=mode)
    return tables.plain_times(run_to_table(found, mode, keys))


def sliding_counts_complete(spark, sf_dir):
    return _sliding_stream(spark, sf_dir, "complete", time_unit="hour")


def sliding_counts_append(spark, sf_dir):
    return _sliding_stream(spark, sf_dir, "append")


def sliding_counts_append_batches(spark, sf_dir):
    """Over several micro-batches, between which the watermark moves and state leaves."""
    calls = tables.calls_of_files(spark, _event_files(spark, sf_dir))
    found = windows.sliding_pair_counts(calls, output_mode="append")
    return tables.plain_times(run_to_table(found, "append"))


def sliding_counts_panes_batches(spark, sf_dir):
    """Through panes of one slide, over several micro-batches."""
    calls = tables.calls_of_files(spark, _event_files(spark, sf_dir))
    return tables.plain_times(run_to_table(windows.sliding_pair_counts_by_panes(calls), "append"))


def sliding_counts_panes_hourly(spark, sf_dir):
    """The same with repeated calls, which count once."""
    calls = tables.calls_of_files(spark, _event_files(spark, sf_dir), time_unit="hour")
    return tables.plain_times(run_to_table(windows.sliding_pair_counts_by_panes(calls), "append"))


def sliding_type_estimates(spark, sf_dir):
    """Users as call types, of which a window has many; fewer than a sketch keeps exactly."""
    calls = tables.calls(spark, sf_dir, call_type="user_id")
    return tables.plain_times(windows.sliding_type_estimates(calls, "24 hours", "6 hours"))


def sliding_type_estimates_stream(spark, sf_dir):
    calls = tables.calls_of_files(spark, _event_files(spark, sf_dir), call_type="user_id")
    found = windows.sliding_type_estimates(calls, "24 hours", "6 hours")
    return tables.plain_times(run_to_table(found, "append"))


def sliding_counts_append_hourly(spark, sf_dir):
    return _sliding_stream(spark, sf_dir, "append", time_unit="hour")


def sliding_counts_append_occurrences(spark, sf_dir):
    return _sliding_stream(spark, sf_dir, "append", dedup=False, time_unit="hour")


def sliding_counts_update_hourly(spark, sf_dir):
    keys = ["window_start", "window_end", *PAIR]
    return _sliding_stream(spark, sf_dir, "update", keys, time_unit="hour")


# Micro-batches


def batch_counts(spark, sf_dir):
    found = microbatch.batch_counts(tables.calls(spark, sf_dir), BATCH)
    return tables.plain_times(microbatch.batch_count_lines(found))


def _type_counts(spark, sf_dir, batch=BATCH):
    return microbatch.batch_type_counts(tables.calls(spark, sf_dir), batch)


def batch_type_counts(spark, sf_dir):
    return tables.plain_times(microbatch.sorted_types(_type_counts(spark, sf_dir)))


def batch_type_counts_stream(spark, sf_dir):
    """Every batch, the last ones too: in update mode."""
    calls = tables.calls_of_files(spark, _event_files(spark, sf_dir))
    found = microbatch.batch_type_counts(calls, BATCH)
    return tables.plain_times(run_to_table(found, "update", ["batch_end", CALL_TYPE]))


def batch_type_counts_closed_stream(spark, sf_dir):
    """The batches that the watermark has passed, each once: in append mode."""
    calls = tables.calls(spark, sf_dir, True)
    found = microbatch.batch_type_counts(calls, BATCH, watermark="60 minutes")
    return tables.plain_times(run_to_table(found, "append"))


def batch_top_types(spark, sf_dir):
    return tables.plain_times(microbatch.batch_top_types(_type_counts(spark, sf_dir)))


def batch_top_types_hourly(spark, sf_dir):
    counted = _type_counts(spark, sf_dir, LONG_BATCH)
    return tables.plain_times(microbatch.batch_top_types(counted))


def windowed_batch_counts(spark, sf_dir):
    counted = _type_counts(spark, sf_dir)
    return tables.plain_times(microbatch.windowed_batch_counts(counted, LENGTH, SLIDE))


def windowed_batch_counts_stream(spark, sf_dir):
    calls = tables.calls_of_files(spark, _event_files(spark, sf_dir))
    counted = microbatch.batch_type_counts(calls, BATCH)
    placed = microbatch.windowed_batch_counts(counted, LENGTH, SLIDE)
    keys = ["window_end", "batch_end", CALL_TYPE]
    return tables.plain_times(run_to_table(placed, "update", keys))


def windowed_batch_counts_closed_stream(spark, sf_dir):
    calls = tables.calls(spark, sf_dir, True)
    counted = microbatch.batch_type_counts(calls, BATCH, watermark="60 minutes")
    placed = microbatch.windowed_batch_counts(counted, LENGTH, SLIDE)
    return tables.plain_times(run_to_table(placed, "append"))


def windowed_batch_head(spark, sf_dir):
    counted = _type_counts(spark, sf_dir)
    placed = microbatch.windowed_batch_counts(counted, LENGTH, SLIDE)
    return tables.plain_times(microbatch.windowed_batch_head(placed))


def live_batches(spark, sf_dir):
    """Each processing-time batch against the input of its own files: how many batches,
    how many calls, and whether any batch counted other than its files hold."""
    path, files = scratch_dir(spark, "live"), _event_files(spark, sf_dir)
    source = spark.readStream.schema(tables.EVENTS).option("maxFilesPerTrigger", 1).parquet(files)
    query = start_live_counts(
        tables.calls_from_events(source), path, AVAILABLE_NOW, report=False
    )
    query.awaitTermination()
    counted = live_type_counts(spark, path).groupBy("batch_end").agg(F.sum("count").alias("n"))
    held = spark.read.schema(tables.EVENTS).parquet(files)
    held = held.groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n"))
    same = counted.select("n").exceptAll(held.select("n")).count() == 0
    return counted.agg(F.sum("n").alias("calls")).withColumn("as_in_files", F.lit(same))


def live_batch_totals(spark, sf_dir):
    """Counts of processing-time batches, added up: when they ran varies, this not."""
    path = scratch_dir(spark, "live")
    calls = tables.calls(spark, sf_dir, True)
    start_live_counts(calls, path, AVAILABLE_NOW, report=False).awaitTermination()
    return live_type_counts(spark, path).groupBy(CALL_TYPE).agg(F.sum("count").alias("count"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in [
        parse_calls,
        parse_malformed,
        kept_messages_stream,
        observed_messages_stream,
        published_messages,
        published_records,
        published_resumed,
        schema_drift_untyped,
        schema_drift_batches,
        tail_messages,
        code_table,
        code_table_array,
        distinct_pairs,
        distinct_pairs_stream,
        distinct_pairs_batches,
        distinct_pairs_within_stream,
        pair_counts_distinct,
        pair_counts_distinct_stream,
        pair_counts_occurrences,
        pair_counts_occurrences_stream,
        pair_counts_moved_distinct,
        pair_counts_moved_occurrences,
        state_table,
        description_counts,
        description_counts_messages,
        description_counts_topic,
        description_counts_resumed,
        call_statistics,
        query_progress,
        description_counts_table,
        description_counts_by_user,
        description_counts_by_user_stream,
        description_counts_by_user_large_table,
        description_counts_by_user_large_table_stream,
        calls_with_description,
        calls_with_description_stream,
        calls_with_description_large_table,
        sliding_counts,
        sliding_counts_occurrences,
        sliding_counts_hourly,
        sliding_counts_complete,
        sliding_counts_append,
        sliding_counts_append_batches,
        sliding_counts_panes_batches,
        sliding_counts_panes_hourly,
        sliding_type_estimates,
        sliding_type_estimates_stream,
        sliding_counts_append_hourly,
        sliding_counts_append_occurrences,
        sliding_counts_update_hourly,
        batch_counts,
        batch_type_counts,
        batch_type_counts_stream,
        batch_type_counts_closed_stream,
        batch_top_types,
        batch_top_types_hourly,
        windowed_batch_counts,
        windowed_batch_counts_stream,
        windowed_batch_counts_closed_stream,
        windowed_batch_head,
        live_batches,
        live_batch_totals,
    ]
}
