"""Message, record and code-table readers."""

from callstream.sources.files import call_file_stream, file_messages, read_call_file, read_codes
from callstream.sources.kafka import kafka_messages, kafka_options, offsets_per_trigger
from callstream.sources.rate import rate_calls

__all__ = [
    "call_file_stream",
    "file_messages",
    "kafka_messages",
    "kafka_options",
    "offsets_per_trigger",
    "rate_calls",
    "read_call_file",
    "read_codes",
]
