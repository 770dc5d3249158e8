"""Late data, restarts, state bounds, failures, sources and sinks."""

from __future__ import annotations

import random
import time
from datetime import timedelta
from types import SimpleNamespace

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from callstream import workspace
from callstream.functions.messages import parse_calls
from callstream.operators import counts, lookups, windows
from callstream.plans import jobs
from callstream.schemas import CALL_TYPE
from callstream.sources import (
    file_messages,
    kafka_messages,
    kafka_options,
    offsets_per_trigger,
    rate_calls,
)
from callstream.streaming import (
    ProgressLog,
    append_rows,
    progress_table,
    publish_messages,
    read_latest,
    run_all,
    run_to_table,
    show_batch,
    start_query,
    version,
    write_latest,
)
from callstream.streaming.live import (
    _print_windows,
    live_batch_counts,
    live_type_counts,
    start_live_counts,
)
from callstream.streaming.queries import AVAILABLE_NOW, LARGE_STATE_CONF
from callstream.workspace import clear_scratch, scratch_dir
from helpers import START, call, rows, write_messages

LENGTH, SLIDE, DELAY = 10, 5, 20  # minutes


def random_batches(seed, n_batches=6, size=40):
    """Calls around a moving time, many late and many repeated."""
    rng = random.Random(seed)
    batches, seen = [], []
    for number in range(n_batches):
        batch = []
        for _ in range(size):
            if seen and rng.random() < 0.3:
                batch.append(rng.choice(seen))
            else:
                minute = 25 * number + rng.choice([0, 0, -25, -40, -80]) + rng.randrange(25)
                batch.append((rng.choice("AB"), rng.choice("xy"), max(minute, 0) + 0.5))
        seen += batch
        batches.append(batch)
    return batches


def expected_windows(batches, closed_only):
    """Brute force: a call enters a window unless that window had been closed before
    the previous batch; a batch closes by the times of the batches before it."""
    latest, closing, late = float("-inf"), float("-inf"), float("-inf")
    members = {}
    for batch in batches:
        late, closing = closing, latest - DELAY
        for kind, code, minute in batch:
            first = int(minute // SLIDE) * SLIDE
            for start in range(first - LENGTH + SLIDE, first + 1, SLIDE):
                if start + LENGTH > late:
                    members.setdefault((start, kind, code), set()).add(minute)
        latest = max(latest, *(minute for _, _, minute in batch))
    last = latest - DELAY
    return {
        key: len(times)
        for key, times in members.items()
        if not closed_only or key[0] + LENGTH <= last
    }


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("mode", ["append", "update"])
def test_late_and_repeated_calls(spark, tmp_path, seed, mode):
    batches = random_batches(seed)
    folder = write_messages(tmp_path / "calls", [[call(*c) for c in b] for b in batches])
    calls = parse_calls(file_messages(spark, folder, max_files=1))
    found = windows.sliding_pair_counts(
        calls, f"{LENGTH} minutes", f"{SLIDE} minutes", f"{DELAY} minutes", output_mode=mode
    )
    keys = ["window_start", "window_end", *counts.PAIR]
    table = run_to_table(found, mode, keys)
    start = START.replace(tzinfo=None)
    got = {
        (int((r["window_start"] - start).total_seconds() // 60), r[CALL_TYPE], r["disposition"]): r[
            "count"
        ]
        for r in table.collect()
    }
    assert table.count() == len(got)
    assert got == expected_windows(batches, closed_only=mode == "append")


def test_complete_mode_keeps_late_calls(spark, tmp_path):
    batches = random_batches(3)
    folder = write_messages(tmp_path / "calls", [[call(*c) for c in b] for b in batches])
    streamed = parse_calls(file_messages(spark, folder, max_files=1))
    batch = parse_calls(file_messages(spark, folder, streaming=False))
    found = windows.sliding_pair_counts(streamed, output_mode="complete")
    assert rows(run_to_table(found, "complete")) == rows(windows.sliding_pair_counts(batch))


@pytest.mark.parametrize("mode", ["append", "update"])
def test_window_state_is_evicted(spark, tmp_path, mode):
    batches = [[call("A", "x", 60 * n + i) for i in range(30)] for n in range(6)]
    folder = write_messages(tmp_path / "calls", batches)
    calls = parse_calls(file_messages(spark, folder, max_files=1))
    found = windows.sliding_pair_counts(calls, watermark="10 minutes", output_mode=mode)
    query = start_query(found, mode, "noop", AVAILABLE_NOW)
    query.awaitTermination()
    states = [r["state_rows"] for r in progress_table(spark, query).collect()]
    assert max(states) < 6 * 60
    assert states[-1] < states[1]


@pytest.mark.parametrize("large_state", [False, True])
def test_restart_continues(spark, tmp_path, large_state):
    batches = [[call("AB"[i % 2], f"{i}", i) for i in range(n, n + 6)] for n in range(0, 20, 4)]
    folder = tmp_path / "calls"
    codes = spark.createDataFrame(
        [(f"{i}", f"d{i % 3}") for i in range(20)],
        "disposition string, disposition_description string",
    )
    if large_state:
        for key, value in LARGE_STATE_CONF.items():
            spark.conf.set(key, value)
    try:
        checkpoint, table = scratch_dir(spark, "restart"), scratch_dir(spark, "table")
        # The last run finds nothing new.
        for part in (slice(0, 3), slice(3, None), slice(len(batches), None)):
            write_messages(folder, batches[part], first=part.start)
            calls = parse_calls(file_messages(spark, str(folder), max_files=2), counts.PAIR)
            found = jobs.run_description_counts(calls, codes, table, checkpoint)
    finally:
        for key in LARGE_STATE_CONF:
            spark.conf.unset(key)
    whole = parse_calls(file_messages(spark, str(folder), streaming=False), counts.PAIR)
    assert rows(found) == rows(counts.description_counts(whole, codes))


@pytest.mark.parametrize("changed", ["gains", "loses", "past 64", "past the bound"])
def test_resumed_with_another_code_table(spark, tmp_path, changed):
    def table(size, extra=()):
        rows = [(f"{i}", f"d{i % 2}") for i in range(size)] + list(extra)
        return spark.createDataFrame(rows, "disposition string, disposition_description string")

    first, second, bounds = {
        "gains": (table(4), table(6, [("new", "d0")]), {}),
        "loses": (table(6), table(2), {}),
        "past 64": (table(10), table(300), {}),
        "past the bound": (table(4), table(50), {"max_rows": 10}),
    }[changed]
    folder = tmp_path / "calls"
    path, checkpoint = scratch_dir(spark, "table"), scratch_dir(spark, "checkpoint")
    for number, codes in enumerate((first, second)):
        batch = [call("A", f"{i}") for i in range(number, number + 5)] + [call("A", "new")]
        write_messages(folder, [batch], first=number)
        calls = parse_calls(file_messages(spark, str(folder)), counts.PAIR)
        found = jobs.run_description_counts(calls, codes, path, checkpoint, **bounds)
        whole = parse_calls(file_messages(spark, str(folder), streaming=False), counts.PAIR)
        assert rows(found) == rows(counts.description_counts(whole, codes))


def test_resume_after_a_change_of_shuffle_partitions(spark, tmp_path):
    folder, before = tmp_path / "calls", spark.conf.get("spark.sql.shuffle.partitions")
    path, checkpoint = scratch_dir(spark, "table"), scratch_dir(spark, "checkpoint")
    try:
        for number, partitions in enumerate((1, 4)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            write_messages(folder, [[call("A", f"{i}") for i in range(number, number + 3)]], number)
            calls = parse_calls(file_messages(spark, str(folder)), counts.PAIR)
            found = run_to_table(counts.distinct_pairs(calls), "update", counts.PAIR, path, checkpoint)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows(found) == [("A", f"{i}") for i in range(4)]


def test_a_half_written_result_is_not_read(spark, tmp_path):
    path, schema = str(tmp_path / "table"), spark.range(1).schema
    assert rows(read_latest(spark, path, schema)) == []
    write_latest(spark.range(100), path, 0)
    spark.range(200).write.parquet(f"{path}/data/{1:020d}-half")  # no version names it
    assert read_latest(spark, path, schema).count() == 100


def test_updates_replace_rows_by_key(spark, tmp_path):
    batches = [[call("A"), call("B")], [call("A")], [call("A"), call("C")]]
    folder = write_messages(tmp_path / "calls", batches)
    calls = parse_calls(file_messages(spark, folder, max_files=1), [CALL_TYPE])
    path = tmp_path / "table"
    found = run_to_table(calls.groupBy(CALL_TYPE).count(), "update", [CALL_TYPE], str(path))
    assert rows(found) == [("A", 3), ("B", 1), ("C", 1)]
    assert version(spark, str(path)).keys == [CALL_TYPE]


def test_tail_prints_every_message(spark, tmp_path, capsys):
    lines = [f'{{"n": {i}}}' for i in range(3000)] + ["{bad"]
    folder = write_messages(tmp_path / "calls", [lines])
    jobs.start_tail(file_messages(spark, folder), AVAILABLE_NOW).awaitTermination()
    assert capsys.readouterr().out.splitlines() == [f"None {line}" for line in lines]


def test_printed_counts_say_what_is_left_out(spark, tmp_path, capsys):
    folder = write_messages(tmp_path / "calls", [[call(f"t{i}", "CAN") for i in range(30)]])
    deliver = jobs.onto_console(10)
    run_all(
        jobs.start_call_statistics(
            file_messages(spark, folder), lookups.default_codes(spark), deliver, AVAILABLE_NOW
        )
    )
    out = capsys.readouterr().out
    assert out.count("20 more rows are not printed") == 2
    assert out.count("'CAN'") == 10


def test_an_idle_trigger_counts_0(spark, tmp_path, capsys):
    folder = write_messages(tmp_path / "calls", [[call("A")]])
    key = "spark.sql.streaming.noDataProgressEventInterval"
    before = spark.conf.get(key)
    spark.conf.set(key, "500")
    try:
        query = jobs.start_call_report(file_messages(spark, folder), trigger="500 milliseconds")
        deadline, out = time.time() + 30, ""
        while "batch: 0" not in out and time.time() < deadline:
            time.sleep(0.5)
            out += capsys.readouterr().out
        query.stop()
    finally:
        spark.conf.set(key, before)
    assert "Events in this batch: 0" in out


def test_no_input(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    calls = parse_calls(file_messages(spark, str(tmp_path / "empty")), counts.PAIR)
    assert rows(run_to_table(counts.pair_counts(calls), "complete")) == []
    assert rows(run_to_table(counts.pair_counts(calls), "update", counts.PAIR)) == []
    assert rows(run_to_table(counts.distinct_pairs(calls), "update", counts.PAIR)) == []


def test_two_queries_over_one_stream(spark, tmp_path):
    folder = write_messages(tmp_path / "calls", [[call("A", "CAN"), call("A", "22")]])
    found = {}

    def deliver(name, result, batch_id):
        found[name] = rows(result)

    codes = lookups.default_codes(spark)
    run_all(jobs.start_call_statistics(file_messages(spark, folder), codes, deliver, AVAILABLE_NOW))
    assert found == {
        "pair_counts": [("A", "22", 1), ("A", "CAN", 1)],
        "description_counts": [("A", "Cancel", 2)],
    }


def test_both_tables_from_one_query(spark, tmp_path):
    batches = [[call("AB"[i % 2], f"{i % 7}") for i in range(n, n + 3)] for n in range(5)]
    batches[2].append("{bad")
    folder = tmp_path / "calls"
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    codes = spark.createDataFrame(
        [(f"{i}", f"d{i % 2}") for i in range(5)],
        "disposition string, disposition_description string",
    )
    for part in (slice(0, 2), slice(2, None)):
        write_messages(folder, batches[part], first=part.start)
        messages = file_messages(spark, str(folder), max_files=1)
        jobs.start_statistics_tables(
            messages, codes, table, AVAILABLE_NOW, checkpoint
        ).awaitTermination()
    whole = parse_calls(file_messages(spark, str(folder), streaming=False), counts.PAIR)
    for name, expected in {
        "pair_counts": counts.pair_counts(whole),
        "description_counts": counts.description_counts(whole, codes),
    }.items():
        found = read_latest(spark, f"{table}/{name}", expected.schema)
        assert rows(found) == rows(expected)


@pytest.mark.parametrize("fails_at", range(4))
def test_tables_after_a_crash_in_a_batch(spark, tmp_path, monkeypatch, fails_at):
    batches = [[call("AB"[i % 2], f"{i % 5}") for i in range(n, n + 4)] for n in (0, 2)]
    folder = write_messages(tmp_path / "calls", batches)
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    codes = spark.createDataFrame(
        [(f"{i}", f"d{i % 2}") for i in range(5)],
        "disposition string, disposition_description string",
    )
    writes = iter(range(100))

    def write_or_fail(result, path, batch_id):
        if next(writes) == fails_at:
            raise RuntimeError("lost on purpose")
        write_latest(result, path, batch_id)

    monkeypatch.setattr(jobs, "write_latest", write_or_fail)

    def run():
        messages = file_messages(spark, folder, max_files=1)
        jobs.start_statistics_tables(
            messages, codes, table, AVAILABLE_NOW, checkpoint
        ).awaitTermination()

    with pytest.raises(StreamingQueryException, match="lost on purpose"):
        run()
    run()
    whole = parse_calls(file_messages(spark, folder, streaming=False), counts.PAIR)
    expected = counts.description_counts(whole, codes)
    found = read_latest(spark, f"{table}/description_counts", expected.schema)
    assert rows(found) == rows(expected)


def test_a_failing_query_stops_the_others(spark, tmp_path):
    folder = write_messages(tmp_path / "calls", [[call()]])
    messages = file_messages(spark, folder)
    healthy = start_query(messages, "append", "noop", "1 second")
    broken = messages.select(F.raise_error(F.lit("broken on purpose")).cast("string").alias("x"))
    failing = start_query(broken, "append", "noop", "1 second")
    with pytest.raises(StreamingQueryException, match="broken on purpose"):
        run_all([healthy, failing])
    assert not healthy.isActive


def test_progress_table(spark, tmp_path):
    folder = write_messages(tmp_path / "calls", [[call()] * 3, [call("B")] * 2])
    calls = parse_calls(file_messages(spark, folder, max_files=1), counts.PAIR)
    query = start_query(counts.pair_counts(calls), "complete", "noop", AVAILABLE_NOW)
    query.awaitTermination()
    progress = progress_table(spark, query).orderBy("batch_id").collect()
    assert [(p["batch_id"], p["input_rows"], p["state_rows"]) for p in progress] == [
        (0, 3, 1),
        (1, 2, 2),
    ]


def test_progress_log(spark, tmp_path):
    folder = write_messages(tmp_path / "calls", [[call()] * 3])
    calls = parse_calls(file_messages(spark, folder), counts.PAIR)
    seen = []
    log = ProgressLog(seen.append)
    spark.streams.addListener(log)
    try:
        query = start_query(counts.pair_counts(calls), "complete", "noop", AVAILABLE_NOW)
        query.awaitTermination()
        deadline = time.time() + 20
        while not seen and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    (expected,) = progress_table(spark, query).collect()
    (found,) = seen
    # The rate comes rounded in one of the two.
    assert found[:3] + found[4:] == expected[:3] + expected[4:]


def test_live_counts(spark, tmp_path, capsys):
    kinds = ["A"] * 5 + ["B"] * 4 + ["C"] * 2 + ["D"]
    folder = write_messages(tmp_path / "calls", [[call(k) for k in kinds], [call("A"), "{bad"]])
    calls = parse_calls(file_messages(spark, folder, max_files=1), [CALL_TYPE])
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for _ in range(2):  # the second run finds nothing new and changes nothing
        start_live_counts(calls, table, AVAILABLE_NOW, checkpoint).awaitTermination()
    lines = capsys.readouterr().out.splitlines()
    assert lines[:5] == ["Events in this batch: 12", "('A', 5)", "('B', 4)", "('C', 2)", "..."]
    # A window may close in between, by the clock.
    assert lines[5:8] == ["Events in this batch: 2", "(None, 1)", "('A', 1)"]
    total = live_type_counts(spark, table).groupBy(CALL_TYPE).agg(F.sum("count"))
    assert rows(total) == [(None, 1), ("A", 6), ("B", 4), ("C", 2), ("D", 1)]
    assert live_type_counts(spark, table).select("batch_end").distinct().count() == 2


def test_live_windows(spark, capsys):
    start = START.replace(tzinfo=None)
    counted = spark.createDataFrame(
        [
            (start + timedelta(seconds=s), kind, n)
            for s in (5, 10, 15, 20)
            for kind, n in (("A", s), ("B", 99))
        ],
        f"batch_end timestamp, {CALL_TYPE} string, count long",
    )
    micros = int(START.timestamp()) * 1_000_000
    _print_windows(counted, micros + 14_000_000, micros + 20_000_000, 10, 5)
    # (5, 15] and (10, 20]: the batches that ended in them, older one first.
    assert capsys.readouterr().out.splitlines() == [
        "Window to 2024-01-01 00:00:15:",
        "('B', 99)",
        "('A', 10)",
        "('B', 99)",
        "('A', 15)",
        "Window to 2024-01-01 00:00:20:",
        "('B', 99)",
        "('A', 15)",
        "('B', 99)",
        "('A', 20)",
    ]


def test_live_batch_counts(spark, tmp_path):
    start = START.replace(tzinfo=None)

    def at(seconds):
        return start + timedelta(seconds=seconds)

    for batch_id, seconds in enumerate((5.01, 10.2, 25.003)):
        counted = spark.createDataFrame(
            [(at(seconds), "A", 2), (at(seconds), "B", 1)],
            f"batch_end timestamp, {CALL_TYPE} string, count long",
        )
        append_rows(counted, str(tmp_path), batch_id)
    found = rows(live_batch_counts(spark, str(tmp_path)))
    assert found == [(at(5), 3), (at(10), 3), (at(15), 0), (at(20), 0), (at(25), 3)]


def test_files_are_admitted_by_bytes(spark, tmp_path):
    folder = write_messages(tmp_path / "calls", [[call()] * 3, [call()], [call()]])
    calls = parse_calls(file_messages(spark, folder, max_bytes=300), counts.PAIR)
    query = start_query(counts.pair_counts(calls), "complete", "noop", AVAILABLE_NOW)
    query.awaitTermination()
    assert [r["input_rows"] for r in progress_table(spark, query).collect()] == [3, 2]


def test_show_batch(spark, capsys):
    show_batch(spark.range(3), 3, "three")
    show_batch(spark.range(4), 3)
    out = capsys.readouterr().out
    assert out == "three\n(0,)\n(1,)\n(2,)\n(0,)\n(1,)\n(2,)\n...\n"


def test_publish_a_stream(spark, tmp_path):
    folder = write_messages(tmp_path / "calls", [[call("A")], [call("B")]])
    calls = parse_calls(file_messages(spark, folder, max_files=1))
    topic = str(tmp_path / "topic")
    publish_messages(calls, "text", trigger=AVAILABLE_NOW, path=topic).awaitTermination()
    assert rows(parse_calls(file_messages(spark, topic, streaming=False))) == rows(
        parse_calls(file_messages(spark, folder, streaming=False))
    )


def test_publish_a_file(spark, tmp_path):
    lines = write_messages(tmp_path / "lines", [['{"any": [1, 2.50]}', "{bad"]])
    topic = str(tmp_path / "topic")
    jobs.publish_file(spark, lines, "text", multi_line=False, path=topic)
    assert rows(spark.read.text(topic)) == rows(spark.read.text(lines))


def test_rate_calls(spark):
    calls = rate_calls(spark, ["A", "B"], ["CAN", "22", "ADV"], rows_per_second=50)
    query = start_query(calls, "append", "memory", "500 milliseconds", name="rate_calls")
    deadline = time.time() + 30
    while spark.table("rate_calls").count() < 12 and time.time() < deadline:
        time.sleep(0.5)
    query.stop()
    table = spark.table("rate_calls").select("crime_id", *counts.PAIR)
    found = {tuple(r) for r in table.collect()}
    assert {("0", "A", "CAN"), ("1", "B", "22"), ("5", "B", "ADV"), ("6", "A", "CAN")} <= found


def test_kafka_options():
    assert kafka_options("localhost:9092", "calls") == {
        "kafka.bootstrap.servers": "localhost:9092",
        "subscribe": "calls",
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "10000",
    }
    batch = kafka_options("h:1", "t", min_partitions=64, streaming=False)
    assert batch["minPartitions"] == "64"
    assert "maxOffsetsPerTrigger" not in batch
    assert offsets_per_trigger(10_000, 2, 5) == 100_000
    further = {"kafka.security.protocol": "SASL_SSL", "failOnDataLoss": "false"}
    named = kafka_options("h:1", "t.*", pattern=True, group_prefix="g", **further)
    assert named["subscribePattern"] == "t.*" and "subscribe" not in named
    assert named["groupIdPrefix"] == "g" and further.items() <= named.items()
    assert kafka_options("h:1", "t", streaming=False, ending="latest")["endingOffsets"] == "latest"


def test_kafka_needs_its_package(spark):
    with pytest.raises(Exception, match="kafka"):
        kafka_messages(spark, "localhost:9092", "t")


def test_scratch_dir_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(f"{shared}/callstream/x-")
    warehouse = {"spark.sql.warehouse.dir": "/shared/warehouse/"}
    conf = SimpleNamespace(get=lambda key, default=None: warehouse.get(key, default))
    unset = SimpleNamespace(conf=conf)
    assert scratch_dir(unset, "x").startswith("/shared/warehouse/callstream/x-")


def test_scratch_folders_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(workspace, "_FOLDERS", [])
    folder = scratch_dir(spark, "x")
    spark.range(3).write.parquet(folder)
    clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
