"""Best-fit packing of tokenised documents in bulk-synchronous rounds."""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstream.llm.common import cache, documents, in_arrow, staged, unpacked, whole_row

CAPACITY = 4096
END_ID = 1
#: Rows and gaps that one task sweeps (about 150 bytes each).
RANGE_ROWS = 500_000
#: Words whose ids a Python worker keeps (about 200 bytes each).
KEPT_WORDS = 700_000
#: Texts whose words are looked up at once.
PART_ROWS = 2048
PART_BYTES = 4 << 20
_tokenizers: dict[str, _WordIds] = cache(__name__)


def _bytes(words: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each of some strings, none of them null."""
    words = words.cast(pa.large_binary())
    _, ends, data = words.buffers()
    cuts = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    data = data.to_pybytes() if data is not None else b""
    return [data[low:high] for low, high in zip(cuts, cuts[1:])]


class _WordIds:
    """Ids of words by a tokenizer that never joins text over blanks, most looked up once.

    Texts that hold one of its added tokens, in whatever case, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content.lower().encode() for token in added]
        if any(len(token.split()) != 1 for token in self.added):
            raise ValueError("an added token with a blank is found in no word")
        self.odd: set[bytes] = set()  # words that hold an added token
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, null as empty, as little-endian 32-bit numbers."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        if not len(words):
            return [b""] * len(texts)
        distinct = _bytes(words.dictionary)
        ids = pa.array(self._ids(distinct), pa.large_binary()).take(words.indices)
        _, ends, data = ids.buffers()
        first = split.offsets.to_numpy()
        cuts = np.frombuffer(ends, np.int64)[first].tolist()
        data = memoryview(data) if data is not None else b""
        encoded = [bytes(data[low:high]) for low, high in zip(cuts, cuts[1:])]
        if self.odd and (odd := [w in self.odd for w in distinct]) and any(odd):
            at = np.flatnonzero(np.array(odd)[words.indices.to_numpy()])
            for row in np.unique(np.searchsorted(first, at, side="right") - 1).tolist():
                text = texts[row].as_buffer().to_pybytes().decode("utf-8", "replace")
                whole = self.tokenizer.encode(text, add_special_tokens=False).ids
                encoded[row] = np.array(whole, "<u4").tobytes()
        return encoded

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words; those of the first ``KEPT_WORDS`` are kept."""
        found = list(map(self.known.get, words))
        new = [at for at, ids in enumerate(found) if ids is None]
        for low in range(0, len(new), 20_000):
            part = [words[at] for at in new[low : low + 20_000]]
            together = b" ".join(part).lower()  # an added token has no blank: it is in a word or nowhere
            if any(token in together for token in self.added):
                self.odd.update(w for w in part if any(token in w.lower() for token in self.added))
            encoded = self.tokenizer.encode_batch_fast(
                [w.decode("utf-8", "replace") for w in part], add_special_tokens=False
            )
            for at, e in zip(new[low:], encoded):
                ids = e.ids
                found[at] = struct.pack(f"<{len(ids)}I", *ids)
        room = max(0, KEPT_WORDS - len(self.known))
        self.known.update((words[at], found[at]) for at in new[:room])
        return found


def _worker_ids(path: str) -> _WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = _WordIds(path)
    return _tokenizers[path]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``PART_ROWS``, or of fewer that begin within ``PART_BYTES``."""
    sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64)
    number = (np.cumsum(sizes) - sizes) // PART_BYTES
    low = 0
    for high in [*(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]:
        for start in range(low, high, PART_ROWS):
            yield batch.slice(start, min(PART_ROWS, high - start))
        low = high


def _pieces(path: str | None, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words = _worker_ids(path or public_tokenizers.path("word_bpe_49k.json"))
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for part in _parts(batch):
                at, numbers, starts, ids = [], [], [], []
                for row, data in enumerate(words.encode(part.column(1))):
                    data += end
                    for number, start in enumerate(range(0, len(data), step)):
                        at.append(row)
                        numbers.append(number)
                        starts.append(start // 4)
                        ids.append(data[start : start + step])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(at, pa.int64())),
                        pa.array(numbers, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids", "ids_crc32"],
                )

    return run


def tokenized_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """The token ids of each whole document and an end id, cut where longer than the capacity.

    ``tokenizer`` is the path of a tokenizer file that starts words anew at blanks, as the word
    BPE does (the default, found by ``public_tokenizers``); each word is looked up once per
    worker and kept. Columns: doc_id, piece (from 0), start, length, ids (little-endian unsigned
    32-bit numbers), ids_crc32. A null text is empty: one piece of the end id alone.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long"
    return in_arrow(docs.select("doc_id", "text"), _pieces(tokenizer, capacity), schema)


def _brackets(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Match sorted rows and gaps like brackets: a gap gets the nearest row before it still free.

    The level of each, and the places of the rows and of the gaps that were matched.
    """
    depth = np.cumsum(np.where(is_gap, -1, 1))
    level = np.where(is_gap, depth + 1, depth)
    order = np.argsort(level, kind="stable")
    levels, gap = level[order], is_gap[order]
    hit = np.flatnonzero((levels[1:] == levels[:-1]) & ~gap[:-1] & gap[1:])
    return level, order[hit], order[hit + 1]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a range, matched where they can be, and the gaps that are left over."""
    part = TaskContext.get().partitionId()
    rows = pa.Table.from_batches(found) if (found := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    is_gap = rows["is_gap"].to_numpy().astype(bool)
    ids = rows["id"].to_numpy()
    level, matched, taken = _brackets(is_gap)
    mate, free = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
    mate[matched], free[matched] = ids[taken], False
    keep = np.ones(len(ids), bool)
    keep[taken] = False
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(keep.sum(), part, np.int32)),
            pa.array(is_gap[keep].astype(np.int32)),
            pa.array(ids[keep]),
            pa.array(rows["size"].to_numpy()[keep]),
            pa.array(mate[keep], mask=free[keep]),
            pa.array(level[keep].astype(np.int64)),
        ],
        names=["part", "is_gap", "id", "size", "mate", "level"],
    )


def _over_borders(swept: DataFrame) -> DataFrame:
    """What the ranges left over, matched with each other: ``mate`` of the rows that get a gap.

    A range begins at the level that the ranges before it end at. At one level a range leaves a
    gap and a row at most, so the next gap of a row's level, if it comes next, is its match.
    """
    left = swept.where("mate IS NULL").drop("mate")
    change = left.groupBy("part").agg(F.sum(F.expr("1 - 2 * is_gap")).alias("n")).collect()
    before, starts = 0, []
    for part, n in sorted(map(tuple, change)):
        starts.append((part, before))
        before += n
    carried = swept.sparkSession.createDataFrame(starts, "part int, start long")
    left = left.join(F.broadcast(carried), "part").withColumn("level", F.expr("level + start"))
    along = Window.partitionBy("level").orderBy("part", F.desc("is_gap"))
    follower = F.when(F.lead("is_gap").over(along) == 1, F.lead("id").over(along))
    return left.select("is_gap", "id", "size", follower.alias("mate")).where("is_gap = 0")


def _counts(rows: DataFrame, gaps: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """How many rows there are of each length, and gaps of each room: no more than the capacity."""
    both = rows.select("size", F.lit(0).alias("is_gap"))
    both = both.unionByName(gaps.select("size", F.lit(1).alias("is_gap")))
    found: tuple[dict[int, int], dict[int, int]] = {}, {}
    for size, is_gap, n in both.groupBy("size", "is_gap").count().collect():
        found[is_gap][size] = n
    return found


def _round(rows: DataFrame, gaps: DataFrame, slot: int, most: int, ranges: int) -> DataFrame:
    """One sweep: all rows, with the gap that each got as ``mate``.

    A gap with room for several rows of the longest length offers a slot for each, ``most`` slots
    at most; the last of them has the rest of its room.
    """
    number = F.greatest(F.lit(1), F.least(F.expr(f"size div {slot}"), F.lit(most)))
    slots = gaps.withColumn("slots", number.cast("long"))
    slots = slots.select("id", "size", "slots", F.explode(F.expr("sequence(1L, slots)")).alias("at"))
    size = F.when(F.col("at") == 1, F.expr(f"size - (slots - 1) * {slot}")).otherwise(F.lit(slot))
    both = rows.select("id", "size", F.lit(0).alias("is_gap")).unionByName(
        slots.select("id", size.cast("long").alias("size"), F.lit(1).alias("is_gap"))
    )
    order = ("size", "is_gap", "id")
    ranged = both.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = "part int, is_gap int, id long, size long, mate long, level long"
    swept = staged(in_arrow(ranged, _sweep, schema), "packing-sweep")
    inside = swept.where("is_gap = 0 AND mate IS NOT NULL").select("id", "size", "mate")
    return inside.unionByName(_over_borders(swept).select("id", "size", "mate"))


def _best_fit(rows: DataFrame, gaps: DataFrame, capacity: int, range_rows: int) -> list[DataFrame]:
    """The gap of each row, in rounds, as tables of ``id``, ``size`` and ``mate``.

    Sequences are opened only where the rows left have more tokens than the gaps, or are longer
    than any gap, and no more than those tokens fill. New ones have negative numbers.
    """
    spark = rows.sparkSession
    placed: list[DataFrame] = []
    opened = 0
    while True:
        lengths, rooms = _counts(rows, gaps)
        if not lengths:
            return placed
        least, longest, widest = min(lengths), max(lengths), max(rooms, default=0)
        room = sum(size * n for size, n in rooms.items() if size >= least)
        tokens = sum(size * n for size, n in lengths.items())
        stuck = sum(size * n for size, n in lengths.items() if size > widest)
        new = max(0, math.ceil((tokens - room) / capacity), math.ceil(stuck / capacity))
        fresh = spark.range(opened, opened + new)
        opened += new
        fresh = fresh.select((-1 - F.col("id")).alias("id"), F.lit(capacity).cast("long").alias("size"))
        gaps = gaps.where(F.col("size") >= least).unionByName(fresh)
        n_rows = sum(lengths.values())
        n_gaps = new + sum(n for size, n in rooms.items() if size >= least)
        most = max(1, math.ceil(2 * n_rows / n_gaps))
        ranges = math.ceil((n_rows + min(n_gaps * most, n_gaps + room // longest)) / range_rows)
        swept = staged(_round(rows, gaps, longest, most, ranges), "packing-round")
        rows = swept.where("mate IS NULL").select("id", "size")
        placed.append(swept.where("mate IS NOT NULL"))
        taken = placed[-1].select(F.col("mate").alias("id"), (-F.col("size")).alias("size"))
        gaps = gaps.unionByName(taken).groupBy("id").agg(F.sum("size").alias("size"))
        gaps = staged(gaps.where(F.col("size") >= least), "packing-gaps")


def pack(pieces: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Give each row (with a ``length`` of 1 to ``capacity``) a ``sequence_id`` and an ``offset``.

    A row of more than half the capacity begins a sequence, whose room left is a gap. Then, in
    rounds, rows and gaps are sorted together by size into ranges of about ``range_rows``; each
    task sweeps its range upwards and gives a gap the longest row before it that is still free, so
    a row gets the next larger gap that no other row before the gap has a better claim to. What
    the ranges leave over is matched over their borders. The rows that got one leave, the gaps
    lose their lengths, and the next round begins, until no row is left. Rows of equal length
    rank by a number given to them when the input is written. Within a sequence rows stand by
    length, the longest first. The driver learns how many rows and gaps there are of each size,
    ``capacity`` numbers of both, and one number a range.

    A gap takes several rows in a round, so rounds grow with the logarithm of the capacity: seven
    for the lengths of documents. The other columns are kept; rows alike in all columns are rows
    of their own. A row whose length is null, not positive, or beyond the capacity is a
    sequence by itself. An empty table gives an empty table. Columns ``sequence_id`` and ``offset``
    of the input are replaced.
    """
    own = pieces.select(
        F.monotonically_increasing_id().alias("id"), F.col("length").cast("long").alias("size"), whole_row(pieces)
    )
    own = staged(own, "pieces")
    fits = F.coalesce(F.col("size").between(1, capacity // 2), F.lit(False))
    rows = own.where(fits).select("id", "size")
    begun = own.where(~fits).select("id", "size", F.col("id").alias("mate"))
    gaps = begun.where(F.col("size").between(1, capacity - 1))
    gaps = gaps.select("id", (F.lit(capacity) - F.col("size")).cast("long").alias("size"))
    placed = begun
    for part in _best_fit(rows, gaps, capacity, range_rows):
        placed = placed.unionByName(part)
    before = Window.partitionBy("mate").orderBy(F.desc("size"), "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(
        "id",
        F.col("mate").alias("sequence_id"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"),
    )
    kept = unpacked(pieces.columns, ("sequence_id", "offset"))
    return own.join(placed, "id").select(*kept, "sequence_id", "offset")


def op7_best_fit(spark, sf_dir):
    return pack(tokenized_pieces(documents(spark, sf_dir)).drop("ids"))
