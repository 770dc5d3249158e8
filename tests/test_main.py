"""The command line on files, in the session of the tests."""

from __future__ import annotations

import json

import pytest
from pyspark.sql.types import StructType

import main
from callstream.operators.counts import PAIR
from callstream.streaming import read_latest, start_query
from helpers import call, rows, write_messages


def test_publish_count_and_report(spark, tmp_path, capsys):
    records = [call("A", "CAN"), call("A", "22"), call("A", "22"), call("B", "ARR")]
    (tmp_path / "calls.json").write_text(json.dumps(records))
    topic, tables = str(tmp_path / "topic"), str(tmp_path / "tables")

    def run(*words):
        main.run(spark, main.arguments([*words, "--path", topic, "--trigger", "available now"]))

    publish = ["publish", "--file", str(tmp_path / "calls.json"), "--path", topic]
    main.run(spark, main.arguments(publish))
    run("count", "--tables", tables, "--occurrences")
    schema = StructType.fromDDL(f"{PAIR[0]} string, {PAIR[1]} string, count long")
    assert rows(read_latest(spark, f"{tables}/pair_counts", schema)) == [
        ("A", "22", 2),
        ("A", "CAN", 1),
        ("B", "ARR", 1),
    ]
    schema = StructType.fromDDL(f"{PAIR[0]} string, disposition_description string, count long")
    assert rows(read_latest(spark, f"{tables}/description_counts", schema)) == [
        ("A", "Cancel", 2),
        ("B", "Arrest", 1),
    ]
    capsys.readouterr()
    run("tail")
    assert len(capsys.readouterr().out.splitlines()) == 4
    run("report", "--top", "1")
    assert capsys.readouterr().out.splitlines() == ["Events in this batch: 4", "('A', 3)", "..."]


@pytest.mark.parametrize(
    "words",
    [
        ["count"],
        ["tail", "--topic", "t"],
        ["publish", "--file", "f", "--path", "p", "--trigger", "available now"],
        ["count", "--path", "p", "--option", "novalue"],
    ],
)
def test_what_a_command_needs_or_does_not_take(words):
    with pytest.raises(SystemExit):
        main.arguments(words)


@pytest.mark.parametrize(
    "words",
    [
        ["--path", "f", "--max-offsets", "5"],
        ["--path", "f", "--option", "a=b"],
        ["--path", "f", "--rate", "1", "2", "3"],
        ["--servers", "h:1", "--topic", "t", "--max-files", "1"],
    ],
)
def test_options_that_would_be_ignored_are_refused(words, capsys):
    with pytest.raises(SystemExit):
        main.arguments(["report", *words])
    assert "not for" in capsys.readouterr().err


def test_folders_are_admitted_by_files(spark, tmp_path):
    folder = write_messages(tmp_path / "calls", [[call()]] * 3)
    args = main.arguments(["count", "--path", folder, "--max-files", "1"])
    query = start_query(main.messages(spark, args), "append", "noop", "available now")
    query.awaitTermination()
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [1, 1, 1]
