"""Tables of versions: whole results for readers, whatever is written or lost meanwhile."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from callstream.functions.messages import parse_calls
from callstream.schemas import CALL_TYPE
from callstream.sources import file_messages
from callstream.streaming import append_rows, merge_latest, read_latest, start_query, tables, version, write_latest
from callstream.streaming.live import live_type_counts, start_live_counts
from callstream.streaming.queries import AVAILABLE_NOW
from helpers import call, rows, write_messages

SCHEMA = "key string, n long"


def some(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA).coalesce(1)


def schema(spark):
    return some(spark, ("a", 1)).schema


def test_a_reader_keeps_the_version_it_chose(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FAN", 3)
    path = str(tmp_path / "table")
    assert version(spark, path).number == -1
    assert rows(read_latest(spark, path, schema(spark))) == []
    merge_latest(some(spark, ("a", 1), ("b", 1)), path, 0, ["key"])
    chosen = version(spark, path).number
    early = read_latest(spark, path, schema(spark), chosen)
    for batch in range(1, 12):
        merge_latest(some(spark, ("b", batch), (f"c{batch}", batch)), path, batch, ["key"])
        found = dict(rows(read_latest(spark, path, schema(spark))))
        assert found["b"] == batch and len(found) == 2 + batch
    assert rows(early) == rows(read_latest(spark, path, schema(spark), chosen)) == [("a", 1), ("b", 1)]


def test_layers_give_the_newest_row_of_each_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FAN", 3)
    rng, path, expected = random.Random(6), str(tmp_path / "table"), {}
    for batch in range(12):
        changed = {rng.choice(["a", "b", "c", None, "d"]): rng.randrange(100) for _ in range(3)}
        expected |= changed
        merge_latest(some(spark, *changed.items()), path, batch, ["key"])
    found = dict(tuple(r) for r in read_latest(spark, path, schema(spark)).collect())
    assert found == expected
    levels = [level for _, level in version(spark, path).layers]
    assert len(levels) <= 3 * 3 and levels == sorted(levels, reverse=True)


def test_what_a_batch_writes_follows_its_changes(spark, tmp_path, monkeypatch):
    written, write = [], tables._written

    def counted(df, path, order):
        folder = write(df, path, order)
        written.append(spark.read.parquet(f"{path}/{folder}").count())
        return folder

    monkeypatch.setattr(tables, "_written", counted)
    monkeypatch.setattr(tables, "FAN", 4)
    path = str(tmp_path / "table")
    merge_latest(spark.range(10_000).select(F.col("id").cast("string").alias("key"), F.lit(0).cast("long").alias("n")), path, 0, ["key"])
    for batch in range(1, 17):
        merge_latest(some(spark, (f"{batch}", batch)), path, batch, ["key"])
    # The first batch moves up the levels once each; a change is written once per level.
    assert sum(written) <= 10_000 * 3 + 16 * 3
    assert sorted(written)[: 16 - 2] == [1] * 14
    assert read_latest(spark, path, schema(spark)).where("n > 0").count() == 16


def test_a_half_made_version_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    write_latest(some(spark, ("a", 1)), path, 0)

    def lost(*_):
        raise RuntimeError("lost on purpose")

    with monkeypatch.context() as patched:
        patched.setattr(tables, "_publish", lost)
        with pytest.raises(RuntimeError):
            write_latest(some(spark, ("a", 2)), path, 1)
    (tmp_path / "table/_versions/.draft").write_text("{")
    assert rows(read_latest(spark, path, schema(spark))) == [("a", 1)]
    write_latest(some(spark, ("a", 3)), path, 1)
    assert rows(read_latest(spark, path, schema(spark))) == [("a", 3)]


def test_one_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "table")
    append_rows(some(spark, ("a", 1)), path, 0)
    same = version(spark, path)
    with pytest.raises(Exception, match="exists"):
        tables._publish(spark, path, same)
    assert version(spark, path) == same


def test_old_versions_go_and_moved_tables_are_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "RETAIN_SECONDS", -1)
    path = str(tmp_path / "table")
    for batch in range(5):
        write_latest(some(spark, ("a", batch)), path, batch)
    assert len(list((tmp_path / "table/data").iterdir())) <= 2
    with pytest.raises(ValueError, match="no version 0"):
        read_latest(spark, path, schema(spark), 0)
    shutil.move(path, tmp_path / "moved")  # with other modification times, too
    shutil.copytree(tmp_path / "moved", tmp_path / "copied")
    for place in ("moved", "copied"):
        assert rows(read_latest(spark, str(tmp_path / place), schema(spark))) == [("a", 4)]


@pytest.mark.parametrize("change", ["append", "merge", "latest"])
def test_a_repeated_batch_is_there_once(spark, tmp_path, change):
    """The query is lost after the table has the batch, and before the checkpoint has."""
    folder = write_messages(tmp_path / "calls", [[call("A")] * n for n in (1, 2, 3)])
    path, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    failing = [True]

    def write(batch, batch_id):
        counted = batch.groupBy(F.col(CALL_TYPE).alias("key")).agg(F.count("*").alias("n"))
        if change == "append":
            append_rows(counted, path, batch_id)
        elif change == "merge":
            merge_latest(counted, path, batch_id, ["key"])
        else:
            write_latest(counted, path, batch_id)
        if batch_id == 1 and failing.pop():
            raise RuntimeError("lost on purpose")

    calls = parse_calls(file_messages(spark, folder, max_files=1), [CALL_TYPE])
    with pytest.raises(StreamingQueryException, match="lost on purpose"):
        start_query(calls, "append", write, AVAILABLE_NOW, checkpoint).awaitTermination()
    failing.append(False)
    start_query(calls, "append", write, AVAILABLE_NOW, checkpoint).awaitTermination()
    expected = [("A", 1), ("A", 2), ("A", 3)] if change == "append" else [("A", 3)]
    assert rows(read_latest(spark, path, schema(spark))) == expected
    assert len(version(spark, path).done) == 1


def test_a_live_table_may_begin_at_a_later_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FAN", 2)
    folder, checkpoint = tmp_path / "calls", str(tmp_path / "checkpoint")
    total = 0
    for run, table in enumerate(("first", "second", "second")):
        write_messages(folder, [[call("A")] * (n + 1) for n in range(5)], 5 * run)
        calls = parse_calls(file_messages(spark, str(folder), max_files=1), [CALL_TYPE])
        path = str(tmp_path / table)
        start_live_counts(calls, path, AVAILABLE_NOW, checkpoint, report=run == 2).awaitTermination()
        total = total + 15 if run == 2 else 15
        counted = live_type_counts(spark, path)
        assert counted.agg(F.sum("count")).first()[0] == total
        assert counted.count() == total // 3
