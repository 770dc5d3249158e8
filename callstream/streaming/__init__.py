"""Starting, watching and delivering streaming queries."""

from callstream.streaming.queries import (
    ProgressLog,
    progress_table,
    run_all,
    run_to_table,
    start_query,
)
from callstream.streaming.sinks import publish_messages, show_batch
from callstream.streaming.tables import append_rows, merge_latest, read_latest, version, write_latest

__all__ = [
    "ProgressLog",
    "append_rows",
    "merge_latest",
    "progress_table",
    "publish_messages",
    "read_latest",
    "run_all",
    "run_to_table",
    "show_batch",
    "start_query",
    "version",
    "write_latest",
]
