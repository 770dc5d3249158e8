"""What the physical plans must look like to hold at scale."""

from __future__ import annotations

import re

import pytest

from callstream.functions.messages import parse_calls
from callstream.operators import counts, lookups, microbatch, windows
from callstream.operators.distinct import distinct_rows
from callstream.plans import tables
from callstream.sources import file_messages
from callstream.streaming import start_query
from callstream.streaming.queries import AVAILABLE_NOW
from helpers import call, plan_text, write_messages


@pytest.fixture
def messages(tmp_path):
    return write_messages(tmp_path / "calls", [[call("A", "CAN"), call("A", "22", 90)]])


def streaming_plan(capsys, df, mode):
    query = start_query(df, mode, "noop", AVAILABLE_NOW)
    query.awaitTermination()
    return plan_text(capsys, query)


def test_each_message_is_parsed_once(spark, messages, capsys):
    codes = lookups.default_codes(spark)
    calls = parse_calls(file_messages(spark, messages, streaming=False), counts.PAIR)
    plan = plan_text(capsys, counts.description_counts(calls, codes))
    assert plan.count("from_json(") == 1
    plan = plan_text(capsys, lookups.with_description(calls, codes))
    assert plan.count("from_json(") == 1


def test_streaming_counts_combine_before_the_only_shuffle(spark, messages, capsys):
    calls = parse_calls(file_messages(spark, messages), counts.PAIR)
    for found in (counts.pair_counts(calls), counts.distinct_pairs(calls)):
        plan = streaming_plan(capsys, found, "update")
        assert "StreamingDeduplicate" not in plan
        assert plan.count("REQUIRED_BY_STATEFUL_OPERATOR") == 1
        assert re.search(r"REQUIRED_BY_STATEFUL_OPERATOR.*\n.*HashAggregate.*partial_", plan)


def test_streaming_windows_combine_copies_before_the_shuffle(spark, messages, capsys):
    calls = parse_calls(file_messages(spark, messages))
    plan = streaming_plan(capsys, windows.sliding_pair_counts(calls), "append")
    assert "StreamingDeduplicate" not in plan
    assert plan.count("REQUIRED_BY_STATEFUL_OPERATOR") == 2


def test_a_hot_key_is_split_over_salts(spark, tmp_path, capsys):
    folder = write_messages(tmp_path / "calls", [[call("A", "CAN")] * 5 for _ in range(6)])
    calls = parse_calls(file_messages(spark, folder), counts.PAIR)
    for salts in (1, 4):  # the same state operators, so a query may resume with either
        found = distinct_rows(calls, counts.PAIR, salts)
        query = start_query(found, "append", "noop", AVAILABLE_NOW)
        query.awaitTermination()
        last, first = query.recentProgress[0].stateOperators
        assert last.numRowsTotal == 1
        assert 1 <= first.numRowsTotal <= salts
        assert "_salt" in plan_text(capsys, query)


def test_distinct_pairs_keep_one_state_row_each(spark, tmp_path):
    folder = write_messages(
        tmp_path / "calls", [[call(f"t{i}", "CAN") for i in range(20)] * 2 for _ in range(8)]
    )
    calls = parse_calls(file_messages(spark, folder), counts.PAIR)
    query = start_query(counts.distinct_pairs(calls), "update", "noop", AVAILABLE_NOW)
    query.awaitTermination()
    assert [s.numRowsTotal for s in query.recentProgress[0].stateOperators] == [20]


def test_large_code_table_is_not_broadcast(spark, sf_dir, capsys):
    calls = tables.calls(spark, sf_dir)
    codes = lookups.default_codes(spark)
    small = plan_text(capsys, lookups.with_description(calls, codes))
    large = plan_text(capsys, lookups.with_description(calls, codes, max_bytes=10))
    assert "BroadcastHashJoin" in small and "Exchange hashpartitioning" not in small
    assert "BroadcastHashJoin" not in large
    assert re.search(r"SortMergeJoin \[disposition#\d+, _salt", large)


def test_batch_counts_read_the_calls_once(spark, sf_dir, capsys):
    found = microbatch.batch_counts(tables.calls(spark, sf_dir), "5 minutes")
    found.collect()
    final = plan_text(capsys, found).split("Initial Plan")[0]
    assert final.count("FileScan") == 1
    assert "ReusedExchange" in final
    # The grid is not made by the task that knows its bounds.
    assert re.search(r"Generate explode\(sequence(.|\n)*REPARTITION_BY_COL(.|\n)*Generate", final)


def test_top_types_are_cut_before_the_shuffle(spark, sf_dir, capsys):
    types = microbatch.batch_type_counts(tables.calls(spark, sf_dir), "1 hour")
    plan = plan_text(capsys, microbatch.batch_top_types(types))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_scans_read_only_what_is_needed(spark, sf_dir, capsys):
    calls = tables.calls(spark, sf_dir)
    plan = plan_text(capsys, counts.pair_counts(calls))
    assert "ReadSchema: struct<event_type:string,props:string>" in plan
    plan = plan_text(capsys, microbatch.batch_counts(calls, "5 minutes"))
    assert set(re.findall(r"ReadSchema: (\S+)", plan)) == {"struct<ts:timestamp_ntz>"}
