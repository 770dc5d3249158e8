"""Removal of lines that other documents hold, by two Bloom filters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from callstream.llm.common import BLANKS, as_bytes, documents, in_arrow, staged, unpacked, whole_row

#: Bits of filter per line, and positions that each line sets.
BITS_PER_LINE = 32
HASHES = 2
#: A segment of a filter has this many bits (128 KB).
_SEGMENT_BITS = 20
ADDED = ("n_lines", "n_dropped")


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of blanks, A-Z in lower case; null if shorter than the limit."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    found = {line_key(line, min_chars) for line in text.split(b"\n")}
    found.discard(None)
    return found


def filter_bits(lines: int, most: int) -> int:
    """log2 of the filter's size: 32 bits a line or more, within the bound."""
    return min(max(_SEGMENT_BITS, (max(lines, 1) * BITS_PER_LINE - 1).bit_length()), most)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """One column of positions per hash function; a 64-bit hash is halved and mixed."""
    second = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - bits)
    return np.stack([hashes >> shift, second >> shift], axis=1)[:, :HASHES]


def _seen(min_chars: int, bits: int) -> Callable:
    """Per task: what its documents set in either filter, by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0)
            for known, text in zip(ids.is_valid().to_pylist(), as_bytes(batch.column(1))):
                if known and text:
                    keys = _keys(text, min_chars)
                    hashes.append(
                        np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                    )
        if not hashes:
            return
        once, times = np.unique(positions(np.concatenate(hashes), bits), return_counts=True)
        segments = (once >> np.uint64(_SEGMENT_BITS)).astype(np.int64)
        inside = (once & np.uint64((1 << _SEGMENT_BITS) - 1)).astype(np.uint32)
        ends = np.flatnonzero(np.diff(segments, append=-1)) + 1
        start = 0
        for low in range(0, len(ends), 4096):
            rows = []
            for end in ends[low : low + 4096]:
                part = inside[start:end]
                twice = part[times[start:end] > 1]
                rows.append((int(segments[start]), part.tobytes(), twice.tobytes()))
                start = end
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "once", "twice"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both filters of each segment of this partition; only the second one goes on."""
    filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            if segment not in filters:
                filters[segment] = tuple(np.zeros(1 << _SEGMENT_BITS, bool) for _ in range(2))
            seen, again = filters[segment]
            here = np.frombuffer(once, np.uint32)
            again[here[seen[here]]] = True
            seen[here] = True
            again[np.frombuffer(twice, np.uint32)] = True
    for segment, (_, again) in filters.items():
        if again.any():
            packed = zlib.compress(np.packbits(again).tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int64()), pa.array([packed], pa.binary())],
                names=["segment", "bits"],
            )


def _suspected(min_chars: int, bits: int, shared) -> Callable:
    """The keys that the second filter holds, with the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << (_SEGMENT_BITS - 3)
        filled = np.zeros(1 << (bits - 3), np.uint8)
        for segment, packed in shared.value:
            filled[segment * size : (segment + 1) * size] = np.frombuffer(
                zlib.decompress(packed), np.uint8
            )
        for batch in batches:
            rows, found = [], []
            ids = batch.column(0)
            for row, (known, text) in enumerate(
                zip(ids.is_valid().to_pylist(), as_bytes(batch.column(1)))
            ):
                if known and text:
                    keys = list(_keys(text, min_chars))
                    found += keys
                    rows += [row] * len(keys)
            if not found:
                continue
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
            at = positions(hashes, bits)
            bit = (filled[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
            hits = np.flatnonzero(bit.all(axis=1))
            keys = [found[i] for i in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([rows[i] for i in hits], pa.int64())),
                    pa.array(keys, pa.binary()),
                    pa.array([xxhash.xxh3_128_digest(k) for k in keys], pa.binary()),
                ],
                names=["doc_id", "key", "digest"],
            )

    return run


def _kept(min_chars: int) -> Callable:
    """The text without the lines whose digests are given, and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, drops = [], [], []
            gone_lists = batch.column(2).to_pylist()
            for text, gone in zip(as_bytes(batch.column(1)), gone_lists):
                lines = (text or b"").split(b"\n")
                kept = lines
                if gone:
                    gone = set(gone)
                    kept = [
                        line
                        for line in lines
                        if (key := line_key(line, min_chars)) is None
                        or xxhash.xxh3_128_digest(key) not in gone
                    ]
                texts.append(b"\n".join(kept))
                totals.append(len(lines))
                drops.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(totals, pa.int64()),
                    pa.array(drops, pa.int64()),
                ],
                names=[batch.schema.names[0], "__kept", *ADDED],
            )

    return run


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 10, max_filter_bits: int = 29
) -> DataFrame:
    """Keep a line that several documents hold only in the one with the smallest ``doc_id``.

    A line's key is the line without blanks at its ends, A-Z in lower case; keys below
    ``min_chars`` code points never go. Every task sets the positions of its keys in the
    once-seen filter and those met again in the twice-seen filter; both are merged by segment.
    The twice-seen filter (at most ``2 ** max_filter_bits`` bits, 64 MB, and 32 bits a line
    below that) is broadcast; a fuller one only suspects more. Only keys that it holds are
    shuffled, counted by their whole text and traced back to their documents.

    Returns the input columns with the remaining lines as ``text``, ``n_lines`` (before) and
    ``n_dropped``. A null or empty text is one empty line and gives an empty text. Rows of one
    ``doc_id`` are one document; a row with a null ``doc_id`` stays as it is and is not counted
    as a holder. An empty table gives an empty table. Input columns with the added names are
    replaced.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    breaks = F.octet_length("text") - F.octet_length(F.translate("text", "\n", "")) + 1
    lines = texts.agg(F.sum(breaks.cast("long"))).first()[0] or 0
    bits = filter_bits(lines, max_filter_bits)
    seen = in_arrow(texts, _seen(min_chars, bits), "segment long, once binary, twice binary")
    twice = in_arrow(seen.repartition("segment"), _merged, "segment long, bits binary")
    shared = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in twice.collect()])

    id_type = docs.schema["doc_id"].dataType
    schema = StructType().add("doc_id", id_type).add("key", BinaryType()).add("digest", BinaryType())
    suspects = staged(
        in_arrow(texts, _suspected(min_chars, bits, shared), schema), "suspected-lines"
    )
    confirmed = staged(
        suspects.groupBy("key", "digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("digest", "first"),
        "repeated-lines",
    )
    gone = (
        suspects.select("doc_id", "digest")
        .join(confirmed, "digest")
        .where("doc_id > first")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.collect_set("digest").alias("__gone"))
    )
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("__doc"), F.col("text").alias("__text"))
    marked = rows.join(gone, F.col("__doc") == F.col("__id"), "left").select("__row", "__text", "__gone")
    schema = StructType([marked.schema["__row"]]).add("__kept", StringType())
    for name in ADDED:
        schema = schema.add(name, LongType())
    columns = unpacked(docs.columns, ADDED)
    at = [c.lower() for c in docs.columns if c.lower() not in ADDED].index("text")
    columns[at] = F.col("__kept").alias(docs.columns[[c.lower() for c in docs.columns].index("text")])
    return in_arrow(marked, _kept(min_chars), schema).select(*columns, *ADDED)


def op2_line_dedup(spark, sf_dir):
    return drop_repeated_lines(documents(spark, sf_dir)).select(
        "doc_id", *ADDED, F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.*, coalesce(k.doc_id > f.first, false) AS gone
  FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
