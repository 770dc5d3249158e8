from __future__ import annotations

import json
import os
from datetime import datetime, timedelta, timezone

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def call(kind="Traffic Stop", code="ADV", minute=0.0, **fields):
    time = (START + timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return {
        "original_crime_type_name": kind,
        "disposition": code,
        "call_date_time": time,
        **fields,
    }


def write_messages(folder, batches, first=0):
    """One text file per batch, with rising modification times."""
    folder.mkdir(exist_ok=True)
    for number, records in enumerate(batches, start=first):
        path = folder / f"{number:04d}.json"
        lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
        path.write_text("".join(line + "\n" for line in lines))
        os.utime(path, (1_700_000_000 + 10 * number,) * 2)
    return str(folder)


def ordered(values):
    return sorted(values, key=lambda row: [(v is not None, v) for v in row])


def rows(df):
    return ordered(tuple(r) for r in df.collect())


def plan_text(capsys, explainable):
    capsys.readouterr()
    explainable.explain()
    return capsys.readouterr().out
