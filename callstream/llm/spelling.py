"""Spelling variants of the words of all documents, by Gram matrices of letter counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstream.llm.common import as_bytes, documents, in_arrow, staged
from callstream.llm.jaccard import _groups

MIN_CHARS = 5
MIN_COUNT = 3
#: Every so many-th word of a document loses a code point (a damage that the query looks for).
DAMAGE = 97
#: Words of one block; a unit of work compares one block with one block of each adjacent cell.
BLOCK = 16_384
#: Letters are dealt into so many classes, within a unit; shuffles only use three.
FINE = 8
_FLUSH = 300_000
#: The UTF-8 form of [a-zÀ-ÿ]+, after A-Z have become a-z.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LETTERS = 26 + 64
_UNIT = ("length", "first", "second", "left", "right")


def words_of(doc_id, text: bytes | None, damage: int = DAMAGE) -> Counter:
    """The words of a text and how often it has them, damaged ones as they then read."""
    found: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall((text or b"").lower())).items():
        number = zlib.crc32(run, start)
        if damage and number % damage == 0:
            word = run.decode()
            at = number % len(word)
            run = (word[:at] + word[at + 1 :]).encode()
        found[run] += n
    return found


def _counted(damage: int, min_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            words = [(w, n) for w, n in held.items() if len(w) >= min_chars and len(w.decode()) >= min_chars]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([w for w, _ in words], pa.binary()).cast(pa.string()),
                    pa.array([n for _, n in words], pa.int64()),
                ],
                names=["word", "n"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                for word, n in words_of(doc_id, text, damage).items():
                    held[word] += n
                if len(held) >= _FLUSH:
                    yield flushed()
        if held:
            yield flushed()

    return run


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, a row each."""
    return np.array(words, dtype=str).view(np.uint32).reshape(len(words), -1)


def letter_counts(points: np.ndarray) -> np.ndarray:
    """How often each word has each letter: a-z, then U+00C0 to U+00FF."""
    place = np.where(points < 128, points - ord("a"), points - 0xC0 + 26).astype(np.int64)
    flat = (np.arange(len(points))[:, None] * _LETTERS + place).ravel()
    counts = np.bincount(flat, minlength=len(points) * _LETTERS)
    return counts.reshape(len(points), _LETTERS).astype(np.float32)


def _class_of(classes: int) -> np.ndarray:
    """0/1 matrix that sums letters into classes."""
    matrix = np.zeros((_LETTERS, classes), np.float32)
    matrix[np.arange(_LETTERS), np.arange(_LETTERS) % classes] = 1
    return matrix


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one replaced (equal lengths) or one more code point."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    size = short.shape[1]
    ahead = np.logical_and.accumulate(short == long[:, :size], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= size


class Words:
    """Words of equal length, ordered by the counts of their letter classes.

    The counts are written as one number to a ``base`` above any count; words too long for that
    are all in one cell.
    """

    def __init__(self, words: list[str], rows: np.ndarray, base: int):
        points = codes(words)
        counts = letter_counts(points)
        classes = (counts @ _class_of(FINE)).astype(np.int64)
        places = [base**k if base**FINE < 2**62 else 0 for k in range(FINE)]
        self.weights = np.array(places, np.int64)
        keys = classes @ self.weights
        order = np.argsort(keys, kind="stable")
        self.points, self.rows = points[order], rows[order]
        self.counts = counts[order].astype(np.float64) if points.shape[1] > 2000 else counts[order]
        self.squares = (self.counts**2).sum(axis=1)
        self.keys, self.starts = np.unique(keys[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(keys))

    def steps(self, longer: bool) -> np.ndarray:
        """Differences between the keys of words one edit apart."""
        less = np.zeros(1, np.int64) if longer else self.weights
        return np.unique(self.weights[:, None] - less[None, :])


def candidates(left: Words, right: Words, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs at squared distance 2 (equal lengths) or 1 (one letter more).

    Only cells whose class counts can be one edit apart are multiplied. With ``same``, the two
    sides are the same words and each pair comes once.
    """
    longer = right.points.shape[1] != left.points.shape[1]
    for step in left.steps(longer):
        if same and step < 0:
            continue
        at = np.searchsorted(right.keys, left.keys + step)
        at = np.minimum(at, len(right.keys) - 1)
        met = np.flatnonzero(right.keys[at] == left.keys + step)
        for i, j in zip(met.tolist(), at[met].tolist()):
            a, b = left.starts[i], left.ends[i]
            c, d = right.starts[j], right.ends[j]
            gram = left.counts[a:b] @ right.counts[c:d].T
            gram *= -2
            gram += left.squares[a:b, None]
            gram += right.squares[None, c:d]
            near = gram <= 1.5 if longer else (gram > 1.5) & (gram < 2.5)
            x, y = np.nonzero(near)
            if same and step == 0:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x + a, y + c


def near_rows(left: Words, right: Words, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words one edit apart, each pair once."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for x, y in candidates(left, right, same):
        sure = one_edit(left.points[x], right.points[y])
        found.append((left.rows[x[sure]], right.rows[y[sure]]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _units(blocks: dict[int, int]) -> Callable:
    """Copies of each word for every unit that compares its block: see ``near_words``.

    ``role`` is 0 in the unit's own block on the left, 1 on the right, 2 in an adjacent cell of
    the same length, 3 of the next length.
    """
    thirds = _class_of(3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            n = np.asarray(batch.column(1))
            size = np.array([len(w) for w in words], np.int64)
            for length in np.unique(size).tolist():
                rows = np.flatnonzero(size == length)
                some = [words[r] for r in rows]
                cells = (letter_counts(codes(some)) @ thirds).astype(np.int64)[:, :2]
                spread = np.array([xxhash.xxh3_64_intdigest(w) for w in some], np.uint64)
                for role, shorter, da, db in _SHARES:
                    number = blocks.get(length - shorter)
                    if number is None:  # no word is that short
                        continue
                    block = (spread % np.uint64(number)).astype(np.int64)
                    for other in range(number):
                        own, opposite = (block, other) if role == 0 else (other, block)
                        take = (own <= opposite) if role == 1 else np.ones(len(rows), bool)
                        if role == 1:
                            take &= own != opposite  # the left side holds it already
                        picked = np.flatnonzero(take)
                        columns = [
                            np.full(len(rows), length - shorter),
                            cells[:, 0] - da,
                            cells[:, 1] - db,
                            np.broadcast_to(own, len(rows)),
                            np.broadcast_to(opposite, len(rows)),
                            np.full(len(rows), role),
                        ]
                        arrays = [pa.array(c[picked], pa.int64()) for c in columns]
                        where = pa.array(rows[picked])
                        yield pa.RecordBatch.from_arrays(
                            [*arrays, batch.column(0).take(where), pa.array(n[rows[picked]], pa.int64())],
                            names=[*_UNIT, "role", "word", "n"],
                        )

    return run


#: (role, letters fewer, classes 1 and 2 fewer) of the units that a word belongs to: its own
#: cell's; those of cells one replaced letter below, each unordered pair of cells once; those
#: of the cells that an added letter leads from.
_SHARES = [
    (0, 0, 0, 0),
    (1, 0, 0, 0),
    (2, 0, 1, 0),
    (2, 0, 0, 1),
    (2, 0, 1, -1),
    (3, 1, 0, 0),
    (3, 1, 1, 0),
    (3, 1, 0, 1),
]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word of a unit: how many near words it has there, and the most frequent of them."""
    for unit in _groups(batches, len(_UNIT)):
        role = unit.column(5).to_numpy()
        words = unit.column(6).to_pylist()
        n = unit.column(7).to_numpy()
        base = int(unit.column(0)[0].as_py()) + 4
        sides = {}
        for number in range(4):
            rows = np.flatnonzero(role == number)
            if len(rows):
                sides[number] = Words([words[r] for r in rows], rows, base)
        if 0 not in sides:
            continue
        pairs = []
        if unit.column(3)[0] == unit.column(4)[0]:
            pairs.append(near_rows(sides[0], sides[0], same=True))
        pairs += [near_rows(sides[0], sides[r]) for r in (1, 2, 3) if r in sides]
        if not pairs:
            continue
        one = np.concatenate([p[0] for p in pairs] + [p[1] for p in pairs])
        two = np.concatenate([p[1] for p in pairs] + [p[0] for p in pairs])
        if not len(one):
            continue
        named = np.unique(two)
        rank = np.zeros(len(words), np.int64)
        rank[sorted(named.tolist(), key=lambda r: words[r])] = np.arange(len(named))
        order = np.lexsort((rank[two], -n[two], one))
        one, two = one[order], two[order]
        first = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
        counts = np.diff(np.append(first, len(one)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([words[r] for r in one[first]], pa.string()),
                pa.array(counts, pa.int64()),
                pa.array(n[two[first]], pa.int64()),
                pa.array([words[r] for r in two[first]], pa.string()),
            ],
            names=["word", "n_near", "best_n", "best"],
        )


def word_counts(
    docs: DataFrame, damage: int = DAMAGE, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT
) -> DataFrame:
    """(word, n) of the words of at least ``min_chars`` code points that occur ``min_count``
    times or more. Each task combines its words before the shuffle."""
    some = in_arrow(docs.select("doc_id", "text"), _counted(damage, min_chars), "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near one: how many, and the near
    word with the largest n, of equal ones the first in code-point order.

    A cell holds the words of one length that have as many letters of two classes; a word one
    edit away is in that cell or in an adjacent one of the same or the next length. A unit is a
    block of a cell against a block of it and of the six cells that follow it; a word is copied
    seven times per block. In a unit, products of letter-count matrices, cell by cell of finer
    classes, give the squared distances; pairs at 2 (1 for the next length) are compared letter
    by letter. What leaves a unit is a row per word, not the pairs.
    """
    length = F.length("word")
    thirds = _class_of(3)
    alphabet = [chr(ord("a") + i) for i in range(26)] + [chr(0xC0 + i) for i in range(64)]
    classes = ["".join(a for a, c in zip(alphabet, thirds[:, k]) if c) for k in range(2)]
    cells = [length - F.length(F.translate("word", letters, "")) for letters in classes]
    largest = (
        vocabulary.groupBy(length.alias("length"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
        .count()
        .groupBy("length")
        .agg(F.max("count").alias("cell"))
    )
    # One row per length: as many as there are lengths of words.
    sizes = {r["length"]: r["cell"] for r in largest.collect()}
    blocks = {}
    for size, cell in sizes.items():
        limit = max(1, min(BLOCK, 2**24 // size))
        blocks[size] = -(-max(cell, sizes.get(size + 1, 0)) // limit)
    for size in list(sizes):
        blocks.setdefault(size - 1, -(-sizes[size] // max(1, min(BLOCK, 2**24 // size))))
    units = ", ".join(f"{name} long" for name in (*_UNIT, "role"))
    copies = in_arrow(vocabulary, _units(blocks), f"{units}, word string, n long")
    dealt = copies.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    schema = "word string, n_near long, best_n long, best string"
    parts = in_arrow(dealt, _compared, schema)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("least")
    return (
        parts.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best)
        .select("word", "n_near", (-F.col("least.n")).alias("best_n"), "least.best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to, by doubling the reach.

    A form has at least twice the n of its word, so chains are short and have no cycle.
    """
    reach = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = reach.join(further, "root", "left")
        moved = staged(longer.select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        reach = moved.select("word", "root")
        if not moved.where("next IS NOT NULL").limit(1).count():
            return reach


def spelling_variants(
    docs: DataFrame, damage: int = 0, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT
) -> DataFrame:
    """The words of ``docs`` with the more frequent spelling that each is a variant of.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. Two are near if
    one inserted, deleted or replaced code point parts them. ``form`` is the near word with the
    largest n (of equal ones the first in code-point order) if it has twice the word's n or
    more, else null; ``root`` is the word that forms lead to, the word itself if it has none;
    ``n_near`` is the number of near words, ``form_n`` the form's n.

    With ``damage``, every word of a document whose crc32 it divides loses a code point first.
    Null and empty texts have no words. A null ``doc_id`` counts as an empty one in the crc32,
    repeated rows count as often as they occur, other columns are not read, and an empty table
    gives an empty one.
    """
    vocabulary = staged(word_counts(docs, damage, min_chars, min_count), "vocabulary")
    near = near_words(vocabulary)
    form = F.col("best_n") >= 2 * F.col("n")
    formed = staged(
        vocabulary.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(form, F.col("best")).alias("form"),
            F.when(form, F.col("best_n")).alias("form_n"),
        ),
        "word-forms",
    )
    last = roots(formed.where("form IS NOT NULL"))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling(spark, sf_dir):
    return spelling_variants(documents(spark, sf_dir), DAMAGE)


def crc32_sql(data: str) -> str:
    """crc32 of a text's UTF-8 bytes in SQL, four bits at a time."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    pairs = f"regexp_extract_all(regexp_replace(hex(encode({data})), '(.)(.)', '\\2\\1', 'g'), '.')"
    halves = f"list_transform({pairs}, lambda x: (strpos('0123456789ABCDEF', x) - 1)::BIGINT)"
    step = f"lambda c, b: xor(c >> 4, list_extract({table}::BIGINT[], (xor(c, b) & 15) + 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), {step}), 4294967295)"


OP13_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
    FROM documents) GROUP BY ALL
), hashed AS (
  SELECT run, n, {crc32_sql("doc_id || ':' || run")} AS h FROM runs
), words AS (
  SELECT CASE WHEN h % 97 = 0
    THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
    sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), less AS (
  SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b
    ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM near GROUP BY word
), named AS (
  SELECT word, n_near, best_n, min(other) AS best
  FROM best JOIN near USING (word) WHERE other_n = best_n GROUP BY ALL
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN best_n >= 2 * n THEN best END AS form,
    CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM words LEFT JOIN named USING (word)
), follow AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT k.word, f.form FROM follow k JOIN formed f ON f.word = k.at WHERE f.form IS NOT NULL
), ends AS (
  SELECT k.word, k.at AS root FROM follow k JOIN formed f ON f.word = k.at WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
