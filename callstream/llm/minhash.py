"""Near-duplicate documents by one-permutation hashing, banded buckets and star edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstream.llm.common import as_bytes, documents, in_arrow, staged
from callstream.llm.jaccard import _groups, components, mix, overlaps, set_id, shingles, spanning_stars

WORDS = 4
PERCENT = 80
#: Bins of the one permutation, and how many of them make a band. A pair of similarity 0.8
#: shares no band once in 20 million (each of 32 bands is shared with probability 0.41).
BINS = 128
ROWS = 4
BANDS = BINS // ROWS
#: Share of equal bins from which a pair is verified: five standard deviations of 128 bins below
#: the threshold.
PLAUSIBLE = 0.62
#: Signatures that one task compares with each other (or with as many others), and full sets.
BUCKET = 1_024
GROUP = 512
#: Blocks from which a bucket is split by its other bands: beyond, a split copies less.
BLOCKS = BANDS
#: Members that one task compares with a hub.
STAR = 256
#: Rows up to which a list of wanted sets (four longs each at most) is broadcast: 16 MB.
BROADCAST_ROWS = 500_000

#: Where an empty bin looks for a value: the other bins in an order of its own, the same for
#: all sets, so that the first one that has a value is a fair draw (optimal densification).
_ORDER = np.argsort(
    mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS), axis=1
).astype(np.int16)


def signature(tokens: np.ndarray) -> np.ndarray:
    """16 bits of the least hash of each of BINS ranges; empty ranges take over another's."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    at = np.searchsorted(tokens, edges)
    there = np.append(at[1:], len(tokens)) > at
    values = np.zeros(BINS, np.uint16)
    values[there] = (tokens[at[there]] & np.uint64(0xFFFF)).astype(np.uint16)
    empty = np.flatnonzero(~there)
    if len(empty) and len(empty) < BINS:
        first = there[_ORDER[empty]].argmax(axis=1)
        values[empty] = values[_ORDER[empty, first]]
    return values


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of (sets, BINS) signatures."""
    number = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    return mix(np.ascontiguousarray(signatures).view(np.uint64) ^ number)


def _hashed(words: int) -> Callable:
    """(doc_id, text) to row, doc_id, set_id, size, signature, text. Rows are numbered by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, sizes, signatures = [], [], []
            for text in as_bytes(batch.column(1)):
                tokens = shingles(text.lower() if text else text, words)
                ids.append(set_id(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
                signatures.append(signature(tokens).tobytes() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + batch.num_rows)),
                    batch.column(0),
                    pa.array(ids, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(signatures, pa.binary()),
                    batch.column(1),
                ],
                names=["row", "doc_id", "set_id", "size", "signature", "text"],
            )
            row += batch.num_rows

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, signature) to a row (key, node, band) for each band."""
    for batch in batches:
        keys = band_keys(_matrix(batch.column(1)))
        bands = np.broadcast_to(np.arange(BANDS, dtype=np.int32), keys.shape)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.ravel().view(np.int64)),
                pa.array(np.repeat(np.asarray(batch.column(0)), BANDS)),
                pa.array(bands.ravel()),
            ],
            names=["key", "node", "band"],
        )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, band, node, part, size, signature) of large buckets to rows of the buckets that a
    further band makes of them. Two sets that share several bands meet by the first two."""
    for batch in batches:
        keys = band_keys(_matrix(batch.column(5)))
        own = np.asarray(batch.column(0)).view(np.uint64)
        first = np.asarray(batch.column(1))
        rows, bands = np.nonzero(np.arange(BANDS)[None, :] > first[:, None])
        found = mix(keys[rows, bands] ^ mix(own[rows] + np.uint64(1)))
        take = pa.array(rows)
        both = pa.array((first[rows] + 1) * BANDS + bands, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), both, *(batch.column(k).take(take) for k in (2, 3, 4, 5))],
            names=["key", "band", "node", "part", "size", "signature"],
        )


def _alike(one: np.ndarray, two: np.ndarray, size: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of signatures, and of set sizes, a link can have."""
    fits = 100 * np.minimum(size, sizes) >= percent * np.maximum(size, sizes)
    return fits & ((one == two).sum(axis=1) >= PLAUSIBLE * BINS)


def _agreeing(percent: int) -> Callable:
    """(hub, node, sizes and signatures of both) to (hub, node, equal bins) of plausible pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.asarray(batch.column(k)) for k in (2, 3)]
            both = [_matrix(batch.column(k)) for k in (4, 5)]
            keep = np.flatnonzero(_alike(*both, *sizes, percent))
            equal = (both[0][keep] == both[1][keep]).sum(axis=1)
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(equal, pa.int64())],
                names=["hub", "node", "equal"],
            )

    return run


def _linked(common, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (sizes + others - common)


def _stars(words: int, percent: int) -> Callable:
    """The members of each star that its hub, the first row, is linked with: (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, None
        for batch in batches:
            found = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for (hub, block, node), text in zip(keys, as_bytes(batch.column(3))):
                tokens = shingles(text.lower(), words)
                if (hub, block) != star:
                    if hub != node:
                        raise RuntimeError("a star has lost its hub")
                    star, centre = (hub, block), tokens
                    continue
                common = len(np.intersect1d(centre, tokens, assume_unique=True))
                if _linked(common, len(centre), len(tokens), percent):
                    found.append((hub, node))
            if found:
                columns = [pa.array(c, pa.int64()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return run


_KEYS = ("group", "first_block", "second_block")


def _dealt(members: DataFrame, limit: int) -> DataFrame:
    """Rows (group, count, node, ...) by pairs of blocks: group, first_block, second_block, side,
    node, ... A group of up to ``limit`` is one block; a row is copied once per block."""
    blocks = F.ceil(F.col("count") / limit).cast("long")
    rest = [c for c in members.columns if c not in ("group", "count")]
    return (
        members.withColumn("__blocks", blocks)
        .withColumn("__own", F.pmod(F.xxhash64("node"), F.col("__blocks")))
        .withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
        .select(
            "group",
            F.least("__own", "__other").alias("first_block"),
            F.greatest("__own", "__other").alias("second_block"),
            (F.col("__own") > F.col("__other")).cast("int").alias("side"),
            *rest,
        )
        .repartition(*_KEYS)
        .sortWithinPartitions(*_KEYS)
    )


def _apart(rows: pa.RecordBatch, part: np.ndarray) -> np.ndarray:
    """Which pairs are of different parts, and of different blocks where there are two."""
    apart = part[:, None] != part[None, :]
    if rows.column(1)[0] != rows.column(2)[0]:
        side = rows.column(3).to_numpy()
        apart &= side[:, None] != side[None, :]
    return apart


def _met_here(one: np.ndarray, others: np.ndarray, band: int) -> np.ndarray:
    """Whether this bucket's band (or pair of bands) is the first that the sets share: of the
    buckets that hold a pair, one looks at it."""
    same = one[None, :] == others
    first = same.argmax(axis=1)
    if band < BANDS:
        return first == band
    same[np.arange(len(others)), first] = False
    return (first == band // BANDS - 1) & (same.argmax(axis=1) == band % BANDS) & same.any(axis=1)


def _still_apart(percent: int) -> Callable:
    """Members of a bucket that agree with one of another part: (group, node, part).

    A group is what such pairs connect, named by its members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            nodes, part = rows.column(4).to_numpy(), rows.column(5).to_numpy()
            size, signatures = rows.column(6).to_numpy(), _matrix(rows.column(7))
            if (part == part[0]).all():
                continue
            band = rows.column(8)[0].as_py()
            bands = np.ascontiguousarray(signatures).view(np.uint64)
            close = np.triu(_apart(rows, part), 1)
            for at in range(len(nodes) - 1):
                to = np.flatnonzero(close[at])
                alike = _alike(signatures[to], signatures[at], size[at], size[to], percent)
                close[at, to[~alike]] = False
                to = to[alike]
                close[at, to] = _met_here(bands[at], bands[to], band)
            found: dict[int, list[int]] = {}
            for first, other in spanning_stars(len(nodes), *np.nonzero(close)):
                found.setdefault(first, [first]).append(other)
            for members in found.values():
                members = np.array(members)[np.argsort(nodes[members])]
                ids = nodes[members]
                name = xxhash.xxh3_64_intdigest(ids.tobytes()) >> 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), name, np.int64)), pa.array(ids), pa.array(part[members])],
                    names=["group", "node", "part"],
                )

    return run


def _confirmed(words: int, percent: int) -> Callable:
    """Links between the parts of a cluster, as stars (a, b), from the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            nodes = rows.column(4).to_numpy()
            sets = [shingles(text.lower(), words) for text in as_bytes(rows.column(6))]
            sizes = np.array([len(s) for s in sets], float)
            linked = _linked(overlaps(sets), sizes[:, None], sizes[None, :], percent)
            linked &= _apart(rows, rows.column(5).to_numpy())
            stars = spanning_stars(len(nodes), *np.nonzero(np.triu(linked, 1)))
            if stars:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[[s[k] for s in stars]]) for k in (0, 1)], names=["a", "b"]
                )

    return run


def _counted(rows: DataFrame, label: str) -> DataFrame:
    """The staged rows, to be broadcast while they are few; beyond that a join shuffles them."""
    rows = staged(rows, label)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _texts(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("row").alias("node"), "text")


def _signed(reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Size and signature of the given sets only."""
    wanted = _counted(nodes.select("node").distinct(), "wanted")
    return staged(reps.join(wanted, "node", "left_semi"), "wanted-signatures")


def _shared(bands: DataFrame) -> DataFrame:
    """The rows of the buckets with several sets, with the least one of each as ``hub``."""
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    return staged(bands.join(hubs.where("hub < last").drop("last"), "key"), "shared-buckets")


def _star_edges(reps: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(hub, node, equal): each set with the least ones of its buckets, if they may be linked."""
    edges = staged(shared.where("node > hub").select("hub", "node").distinct(), "star-edges")
    ends = edges.select("node").union(edges.select(F.col("hub").alias("node")))
    signed = _signed(reps, ends)
    centres = signed.select(
        F.col("node").alias("hub"), F.col("size").alias("of_size"), F.col("signature").alias("of_hub")
    )
    both = edges.join(signed, "node").join(centres, "hub")
    both = both.select("hub", "node", "of_size", "size", "of_hub", "signature")
    return staged(in_arrow(both, _agreeing(percent), "hub long, node long, equal long"), "plausible")


def _verified(sets: DataFrame, edges: DataFrame, words: int, percent: int) -> DataFrame:
    """The edges (hub, node) that are links, from the full sets; a hub's text is sent once per
    STAR members."""
    sizes = edges.groupBy("hub").agg(F.ceil(F.count("*") / STAR).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    members = staged(edges.join(sizes, "hub").select("hub", block, "node"), "star-members")
    centres = members.select("hub", "block").distinct().withColumn("node", F.col("hub"))
    every = _counted(members.unionByName(centres), "star-rows")
    rows = _texts(sets).join(every, "node").select("hub", "block", "node", "text")
    keys = ["hub", "block"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "node")  # the hub has the least id
    return staged(in_arrow(rows, _stars(words, percent), "a long, b long"), "star-links")


def _parts(links: DataFrame) -> DataFrame:
    found = staged(components(links, "parts"), "parts")
    return found.select(F.col("node").alias("member"), "root")


def _star_links(sets: DataFrame, edges: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of each set with the hub that agrees with it best, then with the others that are
    in a part of their own still."""
    best = F.max(F.struct("equal", (-F.col("hub")).alias("hub"))).alias("best")
    chosen = edges.groupBy("node").agg(best).select((-F.col("best.hub")).alias("hub"), "node")
    links = _verified(sets, chosen, words, percent)
    parts = _parts(links)
    placed = edges.select("hub", "node")
    for end in ("hub", "node"):
        placed = placed.join(parts, F.col(end) == F.col("member"), "left").withColumn(
            f"{end}_part", F.coalesce("root", end)
        )
        placed = placed.drop("member", "root")
    rest = placed.where("hub_part != node_part").select("hub", "node").join(chosen, ["hub", "node"], "left_anti")
    return links.unionByName(_verified(sets, staged(rest, "other-hubs"), words, percent))


def _open(rows: DataFrame) -> DataFrame:
    """The rows of the buckets with sets of several parts, with their number as ``count``."""
    counts = rows.groupBy("key").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("count")
    )
    return rows.join(counts.where("low < high").select("key", "count"), "key")


def _rest_links(
    sets: DataFrame, reps: DataFrame, shared: DataFrame, parts: DataFrame, words: int, percent: int
) -> DataFrame:
    """Links between sets that share a bucket, but no part yet."""
    placed = shared.join(parts, F.col("node") == F.col("member"), "left")
    placed = placed.select("key", "band", "node", F.coalesce("root", "node").alias("part"))
    members = staged(_open(placed), "open-buckets")
    signed = _signed(reps, members)
    columns = ["key", "count", "node", "part", "size", "signature", "band"]
    large = F.col("count") > BUCKET * BLOCKS
    open_rows = members.where(~large).join(signed, "node").select(*columns)
    split = members.where(large)
    if split.limit(1).count():
        split = in_arrow(
            split.join(signed, "node").select("key", "band", "node", "part", "size", "signature"),
            _split,
            "key long, band int, node long, part long, size long, signature binary",
        )
        open_rows = open_rows.unionByName(_open(staged(split, "split-buckets")).select(*columns))
    dealt = _dealt(open_rows.withColumnRenamed("key", "group"), BUCKET)
    found = in_arrow(dealt, _still_apart(percent), "group long, node long, part long")
    found = staged(found.distinct(), "groups")
    counted = _counted(found.join(found.groupBy("group").count(), "group"), "group-rows")
    rows = _texts(sets).join(counted, "node").select("group", "count", "node", "part", "text")
    return staged(in_arrow(_dealt(rows, GROUP), _confirmed(words, percent), "a long, b long"), "rest-links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of ``words``-word shingles (A-Z in lower case) have
    ``percent`` per cent of their union in common. ``component_id`` is the least id that links
    lead to, ``kept`` says whether it is the document's own.

    Equal sets become one. A set is hashed once; the least hash of each of BINS ranges, empty
    ranges filled by optimal densification, gives a signature of BANDS bands. The sets of a
    bucket (an equal band) are joined to its least one only, so n sets give n - 1 edges. Of the
    hubs whose size and signature allow a link, the best is compared with the set on the full
    sets, then the others that are not connected with it by then. What stars may miss are links
    between sets of one bucket that no hub connects: in buckets with several parts, signatures
    are compared across parts, and what agrees is compared on the full sets, each pair in one
    bucket. Large buckets are dealt into blocks, a set is copied once per block; beyond BLOCKS
    blocks they are split by their other bands first.

    A text with fewer than ``words`` words is one shingle. Texts that are null or have no word
    have no shingle and are linked with nothing, not even with each other. A null id counts for
    no component; ``component_id`` is null where no document has an id, and such a row is kept.
    Rows of one id are documents of their own; equal rows are linked, and all that have the
    least id are kept. Other input columns are left out. An empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, set_id binary, size long, signature binary, text string"
    sets = staged(in_arrow(docs.select("doc_id", "text"), _hashed(words), schema), "shingle-sets")
    same = sets.where("size > 0").groupBy("set_id")
    same = same.agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    distinct = staged(same, "distinct-sets")
    repeated = distinct.where("copies > 1").select("set_id", "node")
    others = sets.select("set_id", "row").join(repeated, "set_id").where("row != node").select("row")
    reps = sets.where("size > 0").join(_counted(others, "copies"), "row", "left_anti")
    reps = staged(reps.select(F.col("row").alias("node"), "size", "signature"), "signatures")
    signed = reps.select("node", "signature")
    bands = staged(in_arrow(signed, _banded, "key long, node long, band int"), "bands")
    shared = _shared(bands)
    stars = _star_links(sets, _star_edges(reps, shared, percent), words, percent)
    rest = _rest_links(sets, reps, shared, _parts(stars), words, percent)
    named = components(stars.unionByName(rest), "near-duplicates")
    named = named.join(distinct.select("node", "set_id", "least"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    linked = named.join(least, "root").select("set_id", "component")
    copies = distinct.where("copies > 1").select("set_id", "least")
    facts = copies.join(linked, "set_id", "full").select("set_id", F.coalesce("component", "least").alias("component"))
    facts = staged(facts, "set-facts").withColumn("__known", F.lit(True))
    rows = sets.select("doc_id", "set_id", F.col("size").alias("n_shingles")).join(facts, "set_id", "left")
    component = F.when(F.col("__known"), F.col("component")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def op11_one_permutation(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


OP11_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM worded
), sized AS (
  SELECT doc_id, len(s) AS n FROM sets
), alike AS (
  SELECT list(doc_id) AS ids, min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), tokens AS (
  SELECT rep, len(s) AS n, unnest(s) AS token FROM alike
), pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
  UNION SELECT rep, unnest(ids) FROM alike UNION SELECT unnest(ids), rep FROM alike
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sized JOIN least USING (doc_id)
"""
