"""Distinct rows without sending all copies of one key to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that the copies of one key of a stream are first split over.
SALTS = 16
_SALT = "_salt"


def task_salt(salts: int) -> Column:
    """A salt per scan task: the same after a task is retried, unlike a random one,
    and spread even over rows that are exact copies of each other. At most as many
    salts occur as the scan has tasks."""
    return F.pmod(F.spark_partition_id(), F.lit(salts))


def first_seen(df: DataFrame, keys: list[str]) -> DataFrame:
    """The values of ``keys`` of a stream, NULLs equal, each in the micro-batch that
    first has it.

    Output mode update, into a sink that replaces a repeated micro-batch. An
    aggregate of the time of the first micro-batch: copies combine before the
    shuffle, and the state is one row per key.
    """
    timed = df.select(*keys, F.current_timestamp().alias("_now"))
    firsts = timed.groupBy(*keys).agg(F.min("_now").alias("_first"))
    return firsts.where(F.col("_first") == F.current_timestamp()).select(*keys)


def distinct_rows(df: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """The distinct values of ``keys``, NULLs equal.

    A batch ``distinct`` combines copies before its shuffle. A streaming one does
    not, so copies are first removed per salt: one hot key then arrives in up to
    ``salts`` tasks, and the second step sees each key at most ``salts`` times in
    the whole life of the query (as long as its state is kept). State is up to
    ``salts`` + 1 rows per key; the number of salts may change when a query is resumed.
    """
    rows = df.select(*keys)
    if not df.isStreaming:
        return rows.distinct()
    salted = rows.withColumn(_SALT, task_salt(salts))
    return salted.dropDuplicates([*keys, _SALT]).drop(_SALT).dropDuplicates(keys)


def distinct_within(
    df: DataFrame, keys: list[str], time: str, horizon: str, salts: int = SALTS
) -> DataFrame:
    """Rows of a stream with new values of ``keys``: a value comes out once, and again at the
    earliest for a row whose ``time`` is more than ``horizon`` later.

    The state of a value leaves when the watermark, ``horizon`` behind the latest time, has passed
    the value's own time by ``horizon``: it holds what the last two horizons brought, not what the
    whole stream did. The time is no part of the key. Copies of a hot value are split over salts
    first (``distinct_rows``). Output mode append. A batch has no horizon: use ``distinct_rows``.
    """
    if not df.isStreaming:
        raise ValueError("a horizon bounds the state of a stream; take distinct_rows for a batch")
    rows = df.select(*keys, time).withWatermark(time, horizon).withColumn(_SALT, task_salt(salts))
    once = rows.dropDuplicatesWithinWatermark([*keys, _SALT]).drop(_SALT)
    return once.dropDuplicatesWithinWatermark(keys)
