"""Jaccard similarity join on word n-grams by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callstream.llm.common import as_bytes, cache, documents, in_arrow, staged

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9995
#: Sampled tokens per set, and the share of equal ones from which a pair is verified. A pair of
#: similarity 0.8 falls below that share about once in a million.
BINS = 64
CANDIDATE = 0.55
#: Sets that one task compares with each other (or with as many others).
BUCKET = 512
#: Splits of a bucket that is too large, before it is compared block by block.
LEVELS = 3
_KEPT_WORDS = 200_000
_word_hashes: dict[bytes, int] = cache(__name__)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram."""
    split = (text or b"").split()
    if not split:
        return np.zeros(0, np.uint64)
    if len(_word_hashes) > _KEPT_WORDS:
        _word_hashes.clear()
    hashes = []
    for word in split:
        found = _word_hashes.get(word)
        if found is None:
            found = _word_hashes[word] = xxhash.xxh3_64_intdigest(word)
        hashes.append(found)
    numbers = np.array(hashes, np.uint64)
    size = min(words, len(numbers))
    total = np.zeros(len(numbers) - size + 1, np.uint64)
    for at in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + numbers[at : at + len(total)]
    return np.unique(mix(total + np.uint64(size)))


def sample(tokens: np.ndarray) -> np.ndarray:
    """One token of each of BINS ranges of hash values, the least; 0 where there is none."""
    starts = np.arange(BINS, dtype=np.uint64) << np.uint64(58)
    at = np.searchsorted(tokens, starts)
    ends = np.append(at[1:], len(tokens))
    found = np.zeros(BINS, np.uint32)
    there = ends > at
    found[there] = np.maximum(tokens[at[there]] & np.uint64(0xFFFFFFFF), np.uint64(1))
    return found


def set_id(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def runs_needed(similarity: float, recall: float, levels: int = 2) -> int:
    """Runs until a pair of this similarity meets with the wanted probability.

    A set goes to 1 / similarity children on average, so a pair at the threshold shares one per
    level; the chance that some path of theirs survives all levels gives the number of runs.
    """
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def children(samples: np.ndarray, seeds: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths of the children of each row's node: the tokens that its seed chooses.

    All sets choose with the same hash, so sets that share a chosen token share the child.
    """
    there = samples > 0
    tokens = mix(samples.astype(np.uint64) + (np.arange(BINS, dtype=np.uint64) << np.uint64(32)))
    limit = 2.0**64 / (similarity * np.maximum(there.sum(axis=1), 1))
    limit = np.minimum(limit, 2.0**64 - 2048).astype(np.uint64)
    chosen = there & (mix(tokens ^ mix(seeds)[:, None]) <= limit[:, None])
    rows, columns = np.nonzero(chosen)
    paths = mix(tokens[rows, columns] + seeds[rows] * np.uint64(0x9E3779B97F4A7C15))
    return rows, paths


def _sampled(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, samples = [], [], []
            for text in as_bytes(batch.column(1)):
                tokens = shingles(text, words)
                ids.append(set_id(tokens))
                sizes.append(len(tokens))
                samples.append(sample(tokens).tobytes())
            made = [
                pa.array(ids, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(samples, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *made, *batch.columns[2:]],
                names=["doc_id", "set_id", "size", "sample", *batch.schema.names[2:]],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BINS)


def _first_paths(runs: int, similarity: float) -> Callable:
    """(set_id, sample) to (path, set_id), one level below the root of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = _matrix(batch.column(1))
            for number in range(runs):
                seeds = np.full(len(samples), number + 1, np.uint64)
                yield _paths(batch.column(0), *children(samples, seeds, similarity))

    return run


def _next_paths(similarity: float) -> Callable:
    """(set_id, sample, path) to (path, set_id), one level further down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(2).to_numpy().view(np.uint64)
            yield _paths(batch.column(0), *children(_matrix(batch.column(1)), seeds, similarity))

    return run


def _paths(ids: pa.Array, rows: np.ndarray, paths: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(paths.view(np.int64)), ids.take(pa.array(rows))], names=["path", "set_id"]
    )


def spanning_stars(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """An edge from the first member of each connected group to each other one."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(find(x), x) for x in range(n) if find(x) != x]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each key together; they are sorted by the first columns."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        columns = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        cuts = np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            if high == low:
                continue
            key = columns[low].tolist()
            if held and key != current:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            current = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pairs(rows: pa.RecordBatch, close: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs, each once: within one block, or across the two blocks of a pair of blocks."""
    if rows.column(1)[0] != rows.column(2)[0]:
        close = close & (side[:, None] != side[None, :])
    return np.nonzero(np.triu(close, 1))


_KEYS = ("group", "first_block", "second_block")


def _blocked(members: DataFrame, group: str, count: str, limit: int) -> DataFrame:
    """Deal the members of a large group into blocks and pair the blocks.

    Columns: group, first_block, second_block, side (which of the two blocks), then the others.
    A group of up to ``limit`` members is one block; a member of a larger one is repeated once
    per block, never once per member.
    """
    blocks = F.ceil(F.col(count) / limit).cast("long")
    rest = [c for c in members.columns if c not in (group, count)]
    own = F.pmod(F.xxhash64("set_id"), F.col("__blocks"))
    dealt = (
        members.withColumn("__blocks", blocks)
        .withColumn("__own", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
        .select(
            F.col(group).alias("group"),
            F.least("__own", "__other").alias("first_block"),
            F.greatest("__own", "__other").alias("second_block"),
            (F.col("__own") > F.col("__other")).cast("int").alias("side"),
            *rest,
        )
    )
    return dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS)


def _close_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars over the members of a bucket whose samples agree often enough."""
    for rows in _groups(batches, 3):
        ids = rows.column(4).to_pylist()
        samples = _matrix(rows.column(5))
        side = rows.column(3).to_numpy()
        n = len(ids)
        close = np.zeros((n, n), bool)
        there = samples > 0
        for at in range(n - 1):
            rest = samples[at + 1 :]
            equal = ((rest == samples[at]) & there[at]).sum(axis=1)
            either = (there[at + 1 :] | there[at]).sum(axis=1)
            close[at, at + 1 :] = equal >= CANDIDATE * either
        stars = spanning_stars(n, *_pairs(rows, close, side))
        if stars:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[a] for a, _ in stars], pa.binary()),
                    pa.array([ids[b] for _, b in stars], pa.binary()),
                ],
                names=["a", "b"],
            )


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common tokens of each pair of sets, by products of 0/1 matrices."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    _, tokens, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    there = shared[tokens]
    rows, tokens = rows[there], number[tokens[there]]
    total = np.zeros((n, n), np.float64)
    order = np.argsort(tokens, kind="stable")
    rows, tokens = rows[order], tokens[order]
    width = 8192
    for low in range(0, int(shared.sum()), width):
        start, end = np.searchsorted(tokens, [low, low + width])
        block = np.zeros((n, width), np.float32)
        block[rows[start:end], tokens[start:end] - low] = 1
        total += block @ block.T
    return total


def _verified(words: int, similarity: float) -> Callable:
    """Exact links of a candidate group: (a, b) stars, and per set (a) its number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            side = rows.column(3).to_pylist()
            ids, copies = rows.column(4).to_pylist(), rows.column(5).to_pylist()
            found: dict[bytes, tuple[int, int, np.ndarray]] = {}
            for s, i, c, text in zip(side, ids, copies, as_bytes(rows.column(6))):
                if i not in found:
                    tokens = shingles(text, words)
                    if set_id(tokens) == i:
                        found[i] = s, c, tokens
            if len(found) < 2:
                continue
            ids = sorted(found)
            sides = np.array([found[i][0] for i in ids])
            copies = np.array([found[i][1] for i in ids])
            sets = [found[i][2] for i in ids]
            common = overlaps(sets)
            sizes = np.array([len(s) for s in sets], float)
            either = sizes[:, None] + sizes[None, :] - common
            left, right = _pairs(rows, common >= similarity * either - 1e-9, sides)
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, left, copies[right])
            np.add.at(links, right, copies[left])
            stars = spanning_stars(len(ids), left, right)
            linked = np.flatnonzero(links).tolist()
            first = [ids[x] for x in linked] + [ids[a] for a, _ in stars]
            second = [None] * len(linked) + [ids[b] for _, b in stars]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first, pa.binary()),
                    pa.array(second, pa.binary()),
                    pa.array([int(links[x]) for x in linked] + [0] * len(stars), pa.int64()),
                ],
                names=["a", "b", "links"],
            )

    return run


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of the nodes of the edges (a, b); the root is the least node connected.

    Large-star and small-star steps in turn: each node hands its larger, then its smaller
    neighbours to the least one. Only minima are aggregated, so a node with many neighbours is
    combined before the shuffle; every step is a staged table.
    """
    edges = staged(edges.where("a != b").distinct(), label)

    def least(both: DataFrame) -> DataFrame:
        return staged(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
            f"{label}-least",
        )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    known = state(edges)
    while known[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = both.join(least(both), "u").where("v > u")
        large = large.select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a != b").distinct(), f"{label}-large")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = down.join(least(down), "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            small.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        edges = staged(small.where("a != b").distinct(), f"{label}-small")
        now = state(edges)
        if now == known:
            break
        known = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b"), F.col("b")).distinct())


def _candidate_edges(reps: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(a, b) stars over sets that meet in a bucket and whose samples agree."""
    runs = runs_needed(similarity, recall, LEVELS)
    some = reps.where("size > 0").select("set_id", "sample")
    schema = "path long, set_id binary"
    rows = staged(in_arrow(some, _first_paths(runs, similarity), schema), "paths")
    edges = None
    for level in range(1, LEVELS + 1):
        counts = rows.groupBy("path").count().where("count > 1")
        counts = staged(counts, "bucket-counts")
        members = rows.join(counts, "path")
        hot = counts.where(F.col("count") > BUCKET).limit(1).count() if level < LEVELS else 0
        ready = members.where(F.col("count") <= BUCKET) if hot else members
        with_sample = ready.join(some, "set_id").select("path", "count", "set_id", "sample")
        blocked = _blocked(with_sample, "path", "count", BUCKET)
        found = staged(in_arrow(blocked, _close_samples, "a binary, b binary"), "candidate-pairs")
        edges = found if edges is None else edges.union(found)
        if not hot:
            break
        deeper = members.where(F.col("count") > BUCKET).join(some, "set_id")
        deeper = deeper.select("set_id", "sample", "path")
        rows = staged(in_arrow(deeper, _next_paths(similarity), schema), "paths")
    return edges


def _row_key() -> list[Column]:
    """128 bits of a row's id and text, the same in every scan; null ids are as good as others."""
    first, second = F.xxhash64("text", "doc_id"), F.xxhash64(F.lit(1), "text", "doc_id")
    return [first.alias("__key"), second.alias("__key2")]


def _with_texts(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """The text of the one row that each chosen set names by its key.

    Rows that repeat an id and a text share a key; one of them is taken, in the partitions of the
    join, so that no set brings more than one text with it.
    """
    keyed = texts.select("text", *_row_key())
    return chosen.join(keyed, ["__key", "__key2"]).dropDuplicates(["__key", "__key2"])


def similar_documents(
    docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, words: int = WORDS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_of, n_links.

    Documents are linked if the Jaccard similarity of their sets of ``words``-word shingles is
    ``similarity`` or more. ``class_id`` is the least id of the documents connected by links,
    ``copy_of`` the least id with the same set, ``n_links`` the number of rows linked to this one,
    copies included.

    Equal sets become one. Each set is represented by up to 64 of its tokens, sampled by the same
    hash everywhere; in each of several runs it is put into the buckets of the tokens that the
    run chooses, and a bucket of more than BUCKET sets is split again on further tokens, chosen
    by its path. Sets of a small bucket (after LEVELS splits: of a pair of blocks of a large one)
    whose samples agree become candidates; the runs go on until a pair at the threshold meets
    with probability ``recall``. Connected candidates are then verified exactly, on their whole
    texts; groups of more than BUCKET sets by pairs of blocks. Links are counted where they are
    found and handed on as stars, so no list of all pairs exists.

    A text shorter than ``words`` words is one shingle. Null texts and texts without words have
    the empty set and are copies of each other. Null ids form no class of their own: ``class_id``
    is null only if no document of a class has an id. Repeated rows are copies. An empty table
    gives an empty table. Other input columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    schema = f"doc_id {kind}, set_id binary, size long, sample binary, __key long, __key2 long"
    keyed = texts.select("doc_id", "text", *_row_key())
    sets = staged(in_arrow(keyed, _sampled(words), schema), "shingle-sets")
    reps = staged(
        sets.groupBy("set_id").agg(
            F.min("doc_id").alias("copy_of"),
            F.count("*").alias("copies"),
            F.first("size").alias("size"),
            F.first("sample").alias("sample"),
            F.min(F.struct("__key", "__key2")).alias("row"),
        ),
        "distinct-sets",
    )
    groups = staged(components(_candidate_edges(reps, similarity, recall), "candidates"), "groups")
    sizes = staged(groups.groupBy("root").agg(F.count("*").alias("count")), "group-sizes")
    numbered = groups.join(sizes, "root").join(reps, F.col("node") == F.col("set_id"))
    chosen = numbered.select(
        F.xxhash64("root").alias("group"), "count", "set_id", "copies", "row.*"
    )
    fetched = _with_texts(chosen, texts).select("group", "count", "set_id", "copies", "text")
    blocked = _blocked(fetched, "group", "count", BUCKET)
    verified = staged(
        in_arrow(blocked, _verified(words, similarity), "a binary, b binary, links long"), "links"
    )
    links = verified.where("b IS NULL").groupBy(F.col("a").alias("set_id"))
    links = links.agg(F.sum("links").alias("links"))
    classes = components(verified.where("b IS NOT NULL").select("a", "b"), "classes")
    named = classes.withColumnRenamed("node", "set_id").join(reps.select("set_id", "copy_of"), "set_id")
    least = named.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    named = named.select("set_id", "root").join(least, "root").select("set_id", "class_id")
    facts = staged(
        reps.select("set_id", "copy_of", "copies")
        .join(named, "set_id", "left")
        .join(links, "set_id", "left")
        .select(
            "set_id",
            F.coalesce("class_id", "copy_of").alias("class_id"),
            "copy_of",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "set-facts",
    )
    return sets.select("doc_id", "set_id").join(facts, "set_id").drop("set_id")


def op8_chosen_path(spark, sf_dir):
    return similar_documents(documents(spark, sf_dir))
