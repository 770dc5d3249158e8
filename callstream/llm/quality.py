"""Quality verdicts by an isolation forest over rule statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstream.llm.common import as_bytes, documents, in_arrow, staged

#: Fixed by the rules of the result.
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = tuple(b"#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule statistics that the forest splits on (the log of the first, the roots of the others);
#: none grows with the length of the text.
FEATURES = (
    "chars_per_word",
    "symbols_per_word",
    "repeated_lines",
    "repeated_words",
    "upper_case",
    "punctuation",
    "digits",
)
TREES = 100
TREE_ROWS = 256
DEPTH = 14
#: Labelled rows, at most about so many, from which the trees draw theirs.
FIT_ROWS = 20_000
BINS = 2_000
GOOD_WEIGHT = 5

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"0123456789")] = 1
_CLASS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 2
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 3
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 4
_CLASS[list(b" \t\n\x0b\x0c\r")] = 5
_CLASS[128:192] = 6  # later bytes of a code point


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, each word once."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)
    )
    pairs = ids[:-2] * len(numbers) + ids[1:-1]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, inverse, counts = np.unique(
        pairs * len(numbers) + ids[2:], return_inverse=True, return_counts=True
    )
    hit = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def text_statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts of a text and its features; all 0 for a null text."""
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7)
    symbols = sum(text.count(s) for s in SYMBOLS)
    chars = len(text) - int(kinds[5]) - int(kinds[6])
    repeats = len(lines) - len(set(lines))
    again = repeated_words(words)
    n = max(1, len(words))
    shares = [
        symbols / n,
        repeats / max(1, len(lines)),
        again / n,
        kinds[3] / max(1, kinds[3] + kinds[4]),
        kinds[2] / max(1, chars),
        kinds[1] / max(1, chars),
    ]
    features = [math.log1p(chars / n), *(math.sqrt(float(share)) for share in shares)]
    return [len(words), chars, symbols, repeats, again], features


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_statistics(text) for text in as_bytes(batch.column(1))]
        counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
        features = pa.array([f for _, f in found], pa.list_(pa.float64()))
        columns = [pa.array(np.ascontiguousarray(c)) for c in counts.T]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *columns, features],
            names=[batch.schema.names[0], *COUNTS, "features"],
        )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``features`` and ``base_failed``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{name} long" for name in COUNTS)
    found = in_arrow(
        docs.select("doc_id", "text"), _statistics, f"doc_id {kind}, {counts}, features array<double>"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    return found.withColumn("base_failed", failed)


@dataclass
class Forest:
    """Isolation trees as flat arrays; a leaf has feature -1 and its path length as split."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    usual: float
    threshold: float = math.inf

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row in (0, 1): the shorter its mean path, the higher."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            while True:
                feature = self.feature[node]
                inner = feature >= 0
                if not inner.any():
                    break
                low = rows[every, np.maximum(feature, 0)] < self.split[node]
                node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
            total += self.split[node]
        return np.exp2(-total / len(self.roots) / self.usual)


def _usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow_forest(
    rows: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    depth: int = DEPTH,
    seed: int = 3,
) -> Forest:
    """Trees of random splits, each over a random draw of the usual rows.

    A split's value is drawn over the part of the box ``low`` to ``high`` that the node covers,
    not over its rows only: regions without usual rows are then cut off early, also along
    features that do not vary among these rows.
    """
    rng = np.random.default_rng(seed)
    take = min(tree_rows, len(rows))
    feature, split, left, right, roots = [], [], [], [], []

    def grow(part: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> int:
        at = len(feature)
        for values in (feature, split, left, right):
            values.append(0)
        wide = np.flatnonzero(high > low)
        if level >= depth or len(part) <= 1 or not len(wide):
            feature[at], split[at] = -1, level + _usual_path(len(part))
            return at
        chosen = int(rng.choice(wide))
        value = float(rng.uniform(low[chosen], high[chosen]))
        below = part[:, chosen] < value
        under, over = high.copy(), low.copy()
        under[chosen] = over[chosen] = value
        feature[at], split[at] = chosen, value
        left[at] = grow(part[below], low, under, level + 1)
        right[at] = grow(part[~below], over, high, level + 1)
        return at

    for _ in range(trees):
        roots.append(grow(rows[rng.choice(len(rows), take, replace=False)], low, high, 0))
    arrays = (np.array(feature), np.array(split, float), np.array(left), np.array(right))
    return Forest(*arrays, np.array(roots), max(_usual_path(take), 1.0))


def _scored(shared) -> Callable:
    """The batches with ``anomaly`` in place of ``features``, which stand last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            rows = flat.reshape(-1, len(FEATURES))
            scores = forest.scores(rows) if forest else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "anomaly"]
            )

    return run


def _with_anomaly(rows: DataFrame, forest: Forest | None) -> DataFrame:
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "features"]
    ordered = rows.select(*[c for c in rows.columns if c != "features"], "features")
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    return in_arrow(ordered, _scored(shared), ", ".join([*kinds, "anomaly double"]))


def fit_quality_forest(
    labelled: DataFrame, fit_rows: int = FIT_ROWS, lost: float = 0.005, seed: int = 3
) -> Forest | None:
    """Forest over labelled statistics (``features``, ``quality``, ``doc_id``), with threshold.

    The trees draw from about ``fit_rows`` good rows, chosen by the hash of their id, and split
    the box that holds all labelled rows. The threshold is set on all labelled rows: of those
    that keep at least ``1 - lost`` of the good ones, the one with the largest share of bad rows
    taken less ``GOOD_WEIGHT`` times the share of good rows lost (in the middle of equal ones). Without
    good rows there is no forest, without bad ones no threshold.
    """
    good = labelled.where("quality = 1")
    edges = [f(F.col("features")[i]) for f in (F.min, F.max) for i in range(len(FEATURES))]
    n, box = good.count(), labelled.agg(*edges).first()
    if not n:
        return None
    low, high = np.array(box, float).reshape(2, -1)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = good.where(draw < min(1.0, fit_rows / n)).select("doc_id", "features")
    rows = [r["features"] for r in picked.distinct().orderBy("doc_id").toLocalIterator()]
    if not rows:
        rows = [r["features"] for r in good.select("features").take(1)]
    forest = grow_forest(np.array(rows, float), low, high, seed=seed)
    scored = _with_anomaly(labelled.select("quality", "features"), forest)
    bins = F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int")
    table = np.zeros((2, BINS))
    for r in scored.groupBy("quality", bins.alias("bin")).count().collect():
        if r["quality"] in (0, 1):
            table[r["quality"], r["bin"]] += r["count"]
    taken = table[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows at or above each bin
    allowed = taken[1] <= lost * table[1].sum()
    if table[0].sum() and allowed.any():
        gain = taken[0] / table[0].sum() - GOOD_WEIGHT * taken[1] / max(1, table[1].sum())
        best = np.flatnonzero(allowed & (gain >= gain[allowed].max() - 1e-12))
        forest.threshold = float(best[len(best) // 2]) / BINS
    return forest


def judge_quality(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, lost: float = 0.005
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``anomaly`` and ``kept``.

    ``kept`` is false for a document that fails the base rules or whose anomaly, from the mean
    path length over the trees, reaches the threshold set on ``labels`` (doc_id, quality).
    A null or empty text has counts 0 and fails the base rules; equal texts get equal rows.
    A null ``doc_id`` has no label; several labels of one document all count. Empty tables give
    an empty table, an empty label table keeps all that pass the base rules. Other input columns
    are left out.
    """
    found = staged(rule_statistics(docs), "rule-statistics")
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality"))
    labelled = staged(
        found.where("NOT base_failed")
        .select("doc_id", "features")
        .join(known, F.col("doc_id") == F.col("__id"))
        .select("doc_id", "quality", "features"),
        "labelled-statistics",
    )
    forest = fit_quality_forest(labelled, fit_rows, lost)
    threshold = forest.threshold if forest else math.inf
    kept = ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold))
    return _with_anomaly(found, forest).withColumn("kept", kept)


def op1_isolation_forest(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = judge_quality(documents(spark, sf_dir), labels)
    return found.select(*[c for c in found.columns if c != "anomaly"], "anomaly")
