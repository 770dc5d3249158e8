"""State that is read and moved, publishing that is repeated, fields that are not declared."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import main
from callstream.functions.messages import parse_calls
from callstream.operators import counts
from callstream.operators.drift import message_fields, schema_drift
from callstream.plans import jobs
from callstream.schemas import CALLS
from callstream.sources import file_messages
from callstream.streaming import run_to_table, start_query
from callstream.streaming.queries import AVAILABLE_NOW
from callstream.streaming.sinks import publish_messages
from callstream.streaming.state import committed_offsets, files_read, read_state, state_operators, write_state
from helpers import call, rows, write_messages

PAIR = counts.PAIR


def batch(first, n=40):
    return [call(f"t{i % 7}", str(i % 5) if i % 11 else None) for i in range(first, first + n)]


def stream(spark, folder, **after):
    return parse_calls(file_messages(spark, folder, max_files=1, **after), PAIR)


def counted(spark, folder, checkpoint, dedup=False):
    found = counts.pair_counts(stream(spark, folder), dedup)
    start_query(found, "complete", "noop", AVAILABLE_NOW, checkpoint).awaitTermination()


def test_state_is_a_table(spark, tmp_path):
    folder = write_messages(tmp_path / "calls", [batch(0), batch(40)])
    checkpoint = str(tmp_path / "c")
    counted(spark, folder, checkpoint)
    calls = parse_calls(file_messages(spark, folder, streaming=False), PAIR)
    state = read_state(spark, checkpoint)
    assert state.columns == [*PAIR, "count", "partition_id"]
    assert rows(state.drop("partition_id")) == rows(counts.pair_counts(calls, False))
    assert state_operators(spark, checkpoint).first()["numPartitions"] == 4
    first = spark.read.text(f"{folder}/0000.json").select("value")
    assert rows(read_state(spark, checkpoint, batch_id=0).drop("partition_id")) == rows(
        counts.pair_counts(parse_calls(first, PAIR), False)
    )
    assert [json.loads(o) for o in committed_offsets(spark, checkpoint)] == [{"logOffset": 1}]


@pytest.mark.parametrize("dedup", [True, False])
@pytest.mark.parametrize("cut", [True, False])
def test_a_count_moves_to_more_partitions(spark, tmp_path, dedup, cut):
    folder = write_messages(tmp_path / "calls", [batch(0), batch(40), batch(80)])
    old, new, seed = (str(tmp_path / name) for name in ("old", "new", "seed"))
    counted(spark, folder, old, dedup)
    if cut:  # the last micro-batch was planned and run, but not committed
        shutil.copytree(old, f"{old}-cut", ignore=lambda at, names: [
            n for n in names if Path(at).name == "commits" and n in ("2", ".2.crc")])
        old = f"{old}-cut"
    assert files_read(spark, old).count() == (2 if cut else 3)
    write_state(spark, old, seed)
    more = spark.newSession()
    more.conf.set("spark.sql.shuffle.partitions", "16")
    result = str(tmp_path / "result")
    for first in (120, 160):  # started, and resumed with a further file
        write_messages(tmp_path / "calls", [batch(first)], first=first)
        found = counts.pair_counts_from(
            stream(more, folder, after=old), counts.earlier_counts(more, seed), dedup
        )
        moved = run_to_table(found, "complete", path=result, checkpoint=new)
        whole = parse_calls(file_messages(spark, folder, streaming=False), PAIR)
        assert rows(moved) == rows(counts.pair_counts(whole, dedup))
    assert state_operators(spark, new).first()["numPartitions"] == 16


def test_a_checkpoint_without_a_commit_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no micro-batch"):
        committed_offsets(spark, str(tmp_path / "none"))


def records_in(spark, folder):
    sent = spark.read.text(folder).select(F.get_json_object("value", "$.crime_id").cast("int"))
    return sorted(r[0] for r in sent.collect())


def test_publishing_cut_short_sends_the_rest_once(spark, tmp_path):
    files = tmp_path / "files"
    texts = [json.dumps([call("A", "CAN", crime_id=str(10 * n + i)) for i in range(10)]) for n in range(4)]
    write_messages(files, [[text] for text in texts[:2] + ["[{broken"] + texts[3:]])
    topic, checkpoint = str(tmp_path / "topic"), str(tmp_path / "c")

    def publish():
        shape = {"schema": CALLS, "max_files": 1, "path": topic}
        jobs.start_publishing(spark, str(files), checkpoint, "text", **shape).awaitTermination()

    with pytest.raises(StreamingQueryException):
        publish()
    assert records_in(spark, topic) == list(range(20))
    write_messages(files, [[texts[2]]], first=2)
    for _ in range(2):
        publish()
        assert records_in(spark, topic) == list(range(40))


def test_publish_command_with_a_checkpoint(spark, tmp_path):
    lines = tmp_path / "calls.json"
    lines.write_text("".join(json.dumps({"crime_id": str(i), "odd": i}) + "\n" for i in range(5)))
    topic = str(tmp_path / "topic")
    words = ["publish", "--file", str(lines), "--path", topic, "--lines"]
    for _ in range(2):
        main.run(spark, main.arguments([*words, "--checkpoint", str(tmp_path / "c"), "--max-files", "1"]))
        assert records_in(spark, topic) == list(range(5))
    assert "odd" in spark.read.text(topic).first()["value"]  # lines go out as they are
    with pytest.raises(SystemExit):
        main.arguments([*words, "--max-files", "1"])


def test_a_folder_is_filled_in_one_way(spark, tmp_path):
    calls = spark.createDataFrame([("1",)], "crime_id string")
    by_batch, by_stream = str(tmp_path / "a"), str(tmp_path / "b")
    for _ in range(2):
        publish_messages(calls, "text", path=by_batch)
    folder = write_messages(tmp_path / "calls", [batch(0, 3)])
    calls_stream = stream(spark, folder)
    publish_messages(calls_stream, "text", trigger=AVAILABLE_NOW, path=by_stream).awaitTermination()
    with pytest.raises(ValueError, match="filled by a stream"):
        publish_messages(calls, "text", path=by_stream)
    with pytest.raises(ValueError, match="filled without a checkpoint"):
        publish_messages(calls_stream, "text", trigger=AVAILABLE_NOW, path=by_batch)


def test_drift(spark):
    texts = [
        '{"crime_id": "1", "city": null, "extra": {"a": 1}}',
        '{"crime_id": 2, "city": null, "extra": {"b": "x"}, "": true}',
        '{"crime_id": null, "call_date": 5}',
        "[1, 2]", "7", "{bad", "", None, "{}",
    ]
    fields = message_fields(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert {r["field"]: tuple(r)[1:] for r in fields.collect()} == {
        "crime_id": ("VARIANT", 3, 1),
        "city": ("VOID", 2, 2),
        "extra": ("OBJECT<a: BIGINT, b: STRING>", 2, 0),
        "": ("BOOLEAN", 1, 0),
        "call_date": ("BIGINT", 1, 0),
    }
    found = {r["field"]: tuple(r)[1:] for r in schema_drift(fields).collect()}
    absent = {f: v for f, v in found.items() if v == ("absent", None, 0)}
    assert set(absent) == set(CALLS.names) - {"crime_id", "city", "call_date"}
    assert {f: v for f, v in found.items() if f not in absent} == {
        "crime_id": ("type", "VARIANT", 3),
        "call_date": ("type", "BIGINT", 1),
        "extra": ("undeclared", "OBJECT<a: BIGINT, b: STRING>", 2),
        "": ("undeclared", "BOOLEAN", 1),
    }
    empty = schema_drift(message_fields(spark.createDataFrame([], "value string")))
    assert {r["drift"] for r in empty.collect()} == {"absent"} and empty.count() == len(CALLS)
