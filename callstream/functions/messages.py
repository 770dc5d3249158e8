"""JSON messages to call records and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callstream.schemas import narrowed

# NULL fields stay in the message, timestamps keep their microseconds.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def parse_calls(messages: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Typed call records from the ``value`` of ``messages``.

    A broken message becomes a row of NULLs and a bad or missing field a NULL in
    that field. The parser decodes every field of its schema, so a caller that
    needs few columns names them in ``fields``.

    Flattened by a generator: the optimizer pushes a filter on a struct's field
    below the projection, where it would parse each message a second time.
    """
    call = F.from_json(F.col("value").cast("string"), narrowed(fields))
    return messages.select(F.inline(F.array(call)))


def parse_untyped() -> Column:
    """The ``value`` column as a VARIANT; NULL where it is not JSON."""
    return F.try_parse_json(F.col("value").cast("string"))


def encode_calls(calls: DataFrame) -> DataFrame:
    """One keyless UTF-8 JSON message (``value BINARY``) per row of ``calls``."""
    record = F.struct(*[F.col(name) for name in calls.columns])
    return calls.select(F.to_json(record, JSON_OPTIONS).cast("binary").alias("value"))


def tail_messages(messages: DataFrame) -> DataFrame:
    """``offset``, parsed ``value`` and ``text`` of every message, for looking into a topic.

    The value of a broken message is NULL; its text is there in any case. Messages of
    files have no offset.
    """
    offset = F.col("offset") if "offset" in messages.columns else F.lit(None).cast("long")
    text = F.col("value").cast("string").alias("text")
    return messages.select(offset.alias("offset"), parse_untyped().alias("value"), text)


def parse_or_keep(messages: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The fields of every message, ``broken``, and ``offset`` and ``text`` of the broken ones.

    Broken is what is no JSON object; its fields are NULL and its text is as it came. A bad field
    of an object is a NULL, as in ``parse_calls``. Messages of files have no offset.
    """
    offset = F.col("offset") if "offset" in messages.columns else F.lit(None).cast("long")
    text = F.col("value").cast("string")
    broken = F.json_object_keys(text).isNull()
    call = F.from_json(text, narrowed(fields))
    return messages.select(
        F.inline(F.array(call)),
        broken.alias("broken"),
        F.when(broken, offset).alias("offset"),
        F.when(broken, text).alias("text"),
    )
