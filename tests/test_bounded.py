"""State that stays bounded, estimates, and messages that do not parse."""

from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from callstream.functions.messages import parse_calls, parse_or_keep
from callstream.operators import counts, windows
from callstream.plans import jobs
from callstream.schemas import CALL_TIME, CALL_TYPE
from callstream.sources import file_messages
from callstream.streaming import run_to_table, start_query
from callstream.streaming.queries import AVAILABLE_NOW, observed_table
from helpers import call, rows, write_messages

FIELDS = [*counts.PAIR, CALL_TIME]


def stream(spark, tmp_path, batches):
    folder = write_messages(tmp_path / "calls", batches)
    return parse_calls(file_messages(spark, folder, max_files=1), FIELDS)


def test_a_horizon_bounds_the_state(spark, tmp_path):
    batches = [[call(f"t{n}-{i}", "CAN", 60 * n + i % 50) for i in range(20)] * 2 for n in range(8)]
    found = counts.distinct_pairs_within(stream(spark, tmp_path, batches), "60 minutes")
    query = start_query(found, "append", "noop", AVAILABLE_NOW)
    query.awaitTermination()
    kept = [sum(s.numRowsTotal for s in p.stateOperators) for p in query.recentProgress]
    assert max(kept) <= 20 * 2 * 4 and kept[-1] < max(kept)  # of 160 pairs, twice each


def test_a_pair_comes_out_again_after_the_horizon(spark, tmp_path):
    minutes = [0, 30, 59, 90, 400, 401, 800]
    batches = [[call("A", "CAN", m), call("A", "CAN", m)] for m in minutes]
    found = counts.distinct_pairs_within(stream(spark, tmp_path, batches), "60 minutes")
    times = [r[CALL_TIME].hour * 60 + r[CALL_TIME].minute for r in run_to_table(found, "append").collect()]
    times.sort()
    assert times[0] == 0 and times[-1] == 800  # in between as the watermark moves
    assert all(later - earlier > 60 for earlier, later in zip(times, times[1:]))
    with pytest.raises(ValueError, match="stream"):
        counts.distinct_pairs_within(spark.createDataFrame([], found.schema))


def test_a_call_is_kept_once_whatever_its_windows(spark, tmp_path):
    batches = [[call("A", f"{i}", 10 * n + i % 9) for i in range(30)] * 3 for n in range(3)]
    calls = stream(spark, tmp_path, batches)
    rows_kept = {}
    for name, found in {
        "panes": windows.sliding_pair_counts_by_panes(calls, "60 minutes", "5 minutes"),
        "direct": windows.sliding_pair_counts(calls, "60 minutes", "5 minutes"),
    }.items():
        query = start_query(found, "append", "noop", AVAILABLE_NOW)
        query.awaitTermination()
        rows_kept[name] = [max(o) for o in zip(*[[s.numRowsTotal for s in p.stateOperators] for p in query.recentProgress])]
    assert max(rows_kept["panes"]) == 90  # distinct calls
    assert max(rows_kept["direct"]) == 90 * 12


def test_panes_leave_out_late_calls_by_pane(spark, tmp_path):
    """The watermark is at 0:40 when two late calls come: one of an open pane, one of a closed."""
    batches = [[call("A", "CAN", 60)], [call("A", "CAN", 61)], [call("A", "CAN", 42), call("A", "CAN", 33)], [call("A", "CAN", 300)]]
    found = windows.sliding_pair_counts_by_panes(stream(spark, tmp_path, batches), "10 minutes", "5 minutes", "20 minutes")
    starts = [(r["window_start"].hour * 60 + r["window_start"].minute, r["count"]) for r in run_to_table(found, "append").collect()]
    assert sorted(starts) == [(35, 1), (40, 1), (55, 2), (60, 2)]
    with pytest.raises(ValueError, match="multiple"):
        windows.sliding_pair_counts_by_panes(stream(spark, tmp_path, batches), "10 minutes", "4 minutes")


def test_estimates_of_many_types(spark):
    calls = spark.range(60_000).select(
        (F.col("id") % 30_000).cast("string").alias(CALL_TYPE),
        F.lit("CAN").alias("disposition"),
        F.timestamp_seconds(F.col("id") % 600).alias(CALL_TIME),
    )
    for log_size, error in ((12, 1 / 64), (10, 1 / 32)):
        found = windows.sliding_type_estimates(calls, "10 minutes", "5 minutes", log_size=log_size)
        exact = calls.groupBy(F.window(CALL_TIME, "10 minutes", "5 minutes").alias("w")).agg(F.countDistinct(CALL_TYPE).alias("n"))
        exact = {r["w"]["start"]: r["n"] for r in exact.collect()}
        got = {r["window_start"]: r["types"] for r in found.collect()}
        assert set(got) == set(exact)
        assert all(abs(got[w] / exact[w] - 1) < 4 * error for w in exact)


BROKEN = ["{bad", "", "[1", "5", "null", '{"original_crime_type_name": "A"']


def test_what_is_kept(spark):
    texts = [*BROKEN, "{}", '{"disposition": 7}', '{"call_date_time": "no time", "disposition": "X"}']
    messages = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)] + [(99, None)], "offset long, value binary")
    found = {r["offset"]: r["text"] for r in parse_or_keep(messages).where("broken").collect()}
    assert found == {**dict(enumerate(BROKEN)), 99: None}
    sound = parse_or_keep(messages, FIELDS).where("NOT broken")
    assert rows(sound) == [(None, None, None, False, None, None), (None, "7", None, False, None, None), (None, "X", None, False, None, None)]


def test_every_message_is_on_one_side_after_a_crash(spark, tmp_path, monkeypatch):
    batches = [[call("A"), "{bad 1"], [call("B"), call("C", "X"), "{bad 2"], ["{bad 3", call("D"), {"disposition": "Y"}]]
    folder = write_messages(tmp_path / "calls", batches)
    path, checkpoint, failing = str(tmp_path / "table"), str(tmp_path / "checkpoint"), [1]
    append = jobs.append_rows

    def lost(batch, table, batch_id):
        append(batch, table, batch_id)
        if batch_id in failing:
            failing.clear()
            raise RuntimeError("lost on purpose")

    monkeypatch.setattr(jobs, "append_rows", lost)

    def run():
        messages = file_messages(spark, folder, max_files=1)
        query = jobs.start_message_table(messages, path, AVAILABLE_NOW, checkpoint, FIELDS)
        query.awaitTermination()
        return query

    with pytest.raises(StreamingQueryException, match="lost on purpose"):
        run()
    query = run()
    parsed = jobs.parsed_calls(spark, path, FIELDS)
    assert [r[0] for r in rows(parsed.select(CALL_TYPE))] == [None, "A", "B", "C", "D"]
    assert rows(jobs.broken_messages(spark, path, FIELDS)) == [(None, f"{{bad {i}") for i in (1, 2, 3)]
    seen = observed_table(spark, query, jobs.OBSERVED, jobs.OBSERVED_SCHEMA)
    assert [r for r in rows(seen) if r[1]] == [(1, 3, 1, 0), (2, 3, 1, 1)]
