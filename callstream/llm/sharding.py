"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, IntegerType, StructType

from callstream.llm.common import documents, in_arrow, unpacked, whole_row

ADDED = ("shard", "slot")
#: Above this numpy refuses a draw.
_NUMPY_TOTAL = 10**9


def near_equal(total: int, parts: int) -> np.ndarray:
    """Sizes that add up to the total and differ by one at most, larger ones first."""
    return total // parts + (np.arange(parts) < total % parts).astype(np.int64)


def _large_hypergeometric(rng, good: int, bad: int, sample: int) -> int:
    """One draw by inversion over a window of 14 standard deviations round the mean."""
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    mean = sample * good / total
    spread = math.sqrt(max(mean * (bad / total) * ((total - sample) / max(1, total - 1)), 1.0))
    first = max(low, math.floor(mean - 14 * spread) - 10)
    last = min(high, math.ceil(mean + 14 * spread) + 10)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) * (sample - k)) - np.log((k + 1) * (bad - sample + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def draw_columns(rng, sizes: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` items drawn without return come from each column.

    Columns beyond what numpy takes at once are first drawn in groups, then within each.
    """
    if sizes.sum() < _NUMPY_TOTAL:
        return rng.multivariate_hypergeometric(sizes, sample, method="marginals")
    if len(sizes) == 1:
        return np.array([sample], dtype=sizes.dtype)
    group = np.cumsum(sizes) // (_NUMPY_TOTAL // 2)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    drawn, rest = np.zeros_like(sizes), int(sizes.sum())
    for low, high in zip(cuts, cuts[1:]):
        own = int(sizes[low:high].sum())
        rest -= own
        taken = sample
        if own and rest and sample:
            taken = _large_hypergeometric(rng, own, rest, sample)
        drawn[low:high] = draw_columns(rng, sizes[low:high], taken if own else 0)
        sample -= taken if own else 0
    return drawn


def matrix_row(counts: np.ndarray, sizes: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """One row of the random matrix with row sums ``counts`` and column sums ``sizes``.

    The partitions are halved again and again; each half's share of every column is a
    hypergeometric draw seeded by the range that it splits. So each task finds its own row by
    log2(partitions) draws, all rows fit together, and a task that runs again finds the same.
    """
    before = np.concatenate([[0], np.cumsum(counts)])
    low, high = 0, len(counts)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = draw_columns(rng, sizes, int(before[middle] - before[low]))
        if partition < middle:
            sizes, high = left, middle
        else:
            sizes, low = sizes - left, middle
    return sizes


def shuffle_to_shards(
    docs: DataFrame, shards: int, seed: int = 29, bucket_rows: int = 50_000
) -> DataFrame:
    """All rows in a uniformly random order, cut into shards whose counts differ by one at most.

    A first job counts the rows of each partition. A second one draws, in each task, how many
    of its rows go to which bucket (``matrix_row``), permutes that list and deals its rows by
    it. The buckets (a shard has as many as keep them below ``bucket_rows``) are then exchanged
    and permuted again by random numbers. Returns the input columns, ``shard`` (from 0) and
    ``slot`` (place in the shard, gapless from 0).

    Nulls, empty texts, ties and repeated rows are rows like all others: nothing is looked at.
    An empty table gives an empty table. Input columns named ``shard`` or ``slot`` are replaced.
    The partitions must be the same in both jobs, as those of a table are; a task that finds
    another number of rows than was counted raises an error.
    """
    counted = docs.groupBy(F.spark_partition_id().alias("part")).count().collect()
    counts = np.zeros(max([r["part"] + 1 for r in counted], default=1), dtype=np.int64)
    for r in counted:
        counts[r["part"]] = r["count"]
    per_shard = near_equal(int(counts.sum()), shards)
    split = max(1, math.ceil(int(per_shard[0]) / bucket_rows))
    sizes = np.concatenate([near_equal(int(n), split) for n in per_shard])
    starts = np.concatenate([np.cumsum(near_equal(int(n), split)) for n in per_shard])
    starts = starts - sizes

    rows = docs.select(whole_row(docs))
    schema = StructType(rows.schema.fields[:])
    schema = schema.add("__bucket", IntegerType()).add("__key", LongType()).add("__at", LongType())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        expected, at = int(counts[part]) if part < len(counts) else 0, 0
        labels = keys = None
        for batch in batches:
            if labels is None:
                row = matrix_row(counts, sizes, part, seed) if expected else sizes * 0
                rng = np.random.default_rng([seed, part, len(counts), 1])
                labels = rng.permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), row))
                keys = rng.integers(0, 2**63 - 1, expected)
            end = at + batch.num_rows
            if end > expected:
                break
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(labels[at:end]),
                    pa.array(keys[at:end]),
                    pa.array(np.arange(at, end) + (part << 40)),
                ],
                names=[*batch.schema.names, "__bucket", "__key", "__at"],
            )
            at = end
        else:
            if at == expected:
                return
        raise RuntimeError(f"partition {part} has other rows than the {expected} counted before")

    dealt = in_arrow(rows, deal, schema)
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", "__at"))
    start = F.element_at(F.lit(starts.tolist()), F.col("__bucket") + 1)
    return dealt.withColumn("__place", place).select(
        *unpacked(docs.columns, ADDED),
        F.floor(F.col("__bucket") / split).cast("int").alias("shard"),
        (start.cast("long") + F.col("__place") - 1).alias("slot"),
    )


def op3_uniform_shuffle(spark, sf_dir):
    """24 shards under the law ``rows``; equal texts need not meet, so groups play no part."""
    text = F.coalesce("text", F.lit(""))
    return shuffle_to_shards(documents(spark, sf_dir), 24).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
