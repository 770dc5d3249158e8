"""WARC archives: revisit records on writing, boundary-chain verification on reading."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callstream.llm.common import in_arrow, ship, staged
from callstream.workspace import scratch_dir

MAGIC = b"WARC/1.0\r\n"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Revisits whose references are broadcast (about 80 bytes each); more are joined by a shuffle.
BROADCAST_REVISITS = 250_000
#: Bytes of archive whose chain one task follows before pointers are jumped.
CHAIN_BLOCK = 32 * 1024 * 1024


def find_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload a page with a larger id has as well."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    slim = pages.where(F.octet_length("html") >= min_bytes).select(
        "page_id", F.sha1(payload).alias("digest")
    )
    held = staged(
        slim.groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
        .where("least < refers_to")
        .select("digest", "refers_to"),
        "shared-payloads",
    )
    found = slim.join(held, "digest").where("page_id < refers_to")
    return staged(found.select("page_id", "digest", "refers_to").distinct(), "revisits")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per page (page_id, url, html) into uncompressed archives below ``path``.

    Of pages with equal payloads of ``min_bytes`` or more, the one with the largest id becomes a
    response and the others revisit it: their records hold the HTTP header and the digest, not
    the payload. Smaller payloads are all responses. A null html is an empty payload, a null url
    is left out, a null id gives a record without a page. Repeated rows of one id are all
    responses or all revisits. Each input partition becomes an archive, committed by Spark's
    writer. Other columns are not written.
    """
    revisits = find_revisits(pages, min_bytes).select(
        F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to"
    )
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    on = (F.col("page_id") == F.col("__id")) & (F.col("digest") == F.col("__digest"))
    rows = rows.join(revisits, on, "left")

    def urn(column):
        page = F.coalesce(F.col(column).cast("string"), F.lit(""))
        return F.concat(F.lit("<urn:page:"), page, F.lit(">"))

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    revisit = F.col("refers_to").isNotNull()
    profile = line("WARC-Profile", F.lit(_PROFILE))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length("html").cast("string")),
        F.lit("\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("refers_to")), profile)).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
    )
    written = rows.select(head.alias("head"), block.alias("block"))
    length = line("Content-Length", F.octet_length("block").cast("string"))
    record = F.concat("head", length, F.lit("\r\n"), "block")
    written.select(record.alias("value")).write.option("lineSep", _END).text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    found = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def _number(value: bytes | None) -> int | None:
    return int(value) if value and value.isdigit() and len(value) < 19 else None


_CHUNK = (
    "file long, split_start long, rel long, size long, head long, length long, kind string, "
    "page string, refers_to string, digest string, http_length long, payload_digest string, "
    "payload_bytes long"
)
_CHUNK_TYPES = pa.schema(
    [
        (part.split()[0], pa.string() if part.split()[1] == "string" else pa.int64())
        for part in _CHUNK.split(", ")
    ]
)


def _read_chunk(chunk: bytes) -> tuple:
    """What follows a magic, read as a record: header end, record length, fields, payload.

    A chunk that is no record has no length; one whose block is cut by another magic has no
    payload yet.
    """
    end = chunk.find(b"\r\n\r\n")
    fields = _fields(chunk[:end]) if end >= 0 else {}
    content = _number(fields.get(b"content-length"))
    if content is None:
        return (None,) * 9
    head = end + 4
    block = chunk[head : head + content]
    page, refers, digest = (
        fields.get(name, b"").decode("utf-8", "replace")
        for name in (b"warc-record-id", b"warc-refers-to", b"warc-payload-digest")
    )
    http_end = block.find(b"\r\n\r\n")
    http_length = _number(_fields(block[:http_end]).get(b"content-length")) if http_end >= 0 else None
    payload = payload_bytes = None
    if len(block) == content:
        body = block[http_end + 4 :] if http_end >= 0 else block
        payload, payload_bytes = hashlib.sha1(body).hexdigest(), len(body)
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    length = len(MAGIC) + head + content + len(_END)
    return head, length, kind, page, refers, digest.removeprefix("sha1:"), http_length, payload, payload_bytes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch up to the next magic, placed relative to the first one of its split."""
    at, rel = None, 0
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for file, start, chunk in zip(files, starts, batch.column(2).to_pylist()):
            if at != (file, start):
                at, rel = (file, start), 0
            chunk = chunk or b""
            rows.append((file, start, rel, len(chunk), *_read_chunk(chunk)))
            rel += len(chunk) + len(MAGIC)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK_TYPES)]
        yield pa.RecordBatch.from_arrays(columns, schema=_CHUNK_TYPES)


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the text between magics, in file order within each split."""
    return (
        spark.read.option("lineSep", MAGIC.decode())
        .text(path)
        .select(
            F.xxhash64("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").cast("long").alias("split_start"),
            F.col("value").cast("binary").alias("chunk"),
        )
    )


def _exits(block_bytes: int) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Where the chain from each candidate of a block leaves the block."""
        limit = (int(frame["block"].iloc[0]) + 1) * block_bytes
        follow = dict(zip(frame["start"], frame["next"]))
        leaves: dict[int, int] = {}
        for start in sorted(follow, reverse=True):
            after = follow[start]
            leaves[start] = after if after >= limit else leaves.get(after, -1)
        return frame.assign(exit=[leaves[s] for s in frame["start"]])[["file", "start", "exit"]]

    return run


def _reached(key: tuple, frame: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block on the chain from its reached entries."""
    follow = dict(zip(frame["start"], frame["next"]))
    found = set()
    for at in entries["start"]:
        while at in follow and at not in found:
            found.add(at)
            at = follow[at]
    return pd.DataFrame({"file": [key[0]] * len(found), "start": sorted(found)}, dtype="int64")


def _chained(candidates: DataFrame, block_bytes: int) -> DataFrame:
    """(file, start) of the candidates on the chain from their file's start.

    Within blocks the chain is followed in a task. Between blocks, the pointers from one entry
    to the next are doubled until no further entry is reached: log2(blocks of a file) rounds.
    """
    spark = candidates.sparkSession
    ship(spark)
    blocked = candidates.withColumn("block", F.floor(F.col("start") / block_bytes))
    leaves = staged(
        blocked.groupBy("file", "block").applyInPandas(_exits(block_bytes), "file long, start long, exit long"),
        "chain-exits",
    )
    targets = leaves.select("file", F.col("exit").alias("start")).distinct()
    pointers = staged(
        leaves.join(targets, ["file", "start"], "left_semi")
        .union(leaves.where("start = 0"))
        .distinct(),
        "chain-pointers",
    )
    reached = staged(pointers.where("start = 0").select("file", "start"), "chain-reached")
    known = reached.count()
    while True:
        stepped = reached.join(pointers, ["file", "start"]).select("file", F.col("exit").alias("start"))
        stepped = stepped.join(pointers.select("file", "start"), ["file", "start"], "left_semi")
        reached = staged(reached.union(stepped).distinct(), "chain-reached")
        count = reached.count()
        if count == known:
            break
        known = count
        onward = pointers.select("file", F.col("start").alias("exit"), F.col("exit").alias("further"))
        pointers = staged(
            pointers.join(onward, ["file", "exit"], "left").select(
                "file", "start", F.coalesce("further", "exit").alias("exit")
            ),
            "chain-pointers",
        )
    entries = reached.withColumn("block", F.floor(F.col("start") / block_bytes))
    return (
        blocked.select("file", "block", "start", "next")
        .groupBy("file", "block")
        .cogroup(entries.groupBy("file", "block"))
        .applyInPandas(_reached, "file long, start long")
    )


@contextmanager
def _splits_fixed(spark: SparkSession) -> Iterator[None]:
    """Within, files are cut into the same splits by each scan, whatever executors come or go."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    fixed = {name: spark.conf.get(name) for name in names}
    name = "spark.sql.files.minPartitionNum"
    fixed[name] = spark.conf.get(name, None) or str(spark.sparkContext.defaultParallelism)
    before = {name: spark.conf.get(name, None) for name in fixed}
    for name, value in fixed.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _joined_payload(frame: pd.DataFrame) -> pd.DataFrame:
    """Payload of a record from its chunks, between which the magics stood."""
    frame = frame.sort_values("at")
    if any(len(chunk or b"") != size for chunk, size in zip(frame["chunk"], frame["size"])):
        raise RuntimeError(f"a second scan found other chunks of the record at {frame['start'].iloc[0]}")
    whole = MAGIC.join(chunk or b"" for chunk in frame["chunk"])
    first = frame.iloc[0]
    head = int(first["head"])
    block = whole[head : int(first["length"]) - len(MAGIC) - len(_END)]
    http_end = block.find(b"\r\n\r\n")
    body = block[http_end + 4 :] if http_end >= 0 else block
    return pd.DataFrame(
        {"file": [first["file"]], "start": [first["start"]], "payload": [body]}
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, rel = None, 0
    for batch in batches:
        places = []
        for file, start, chunk in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (file, start):
                at, rel = (file, start), 0
            places.append(rel)
            rel += len(chunk or b"") + len(MAGIC)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(places, pa.int64()), batch.column(2)],
            names=["file", "split_start", "rel", "chunk"],
        )


def _payloads(spark: SparkSession, path: str, owned: DataFrame) -> DataFrame:
    """(file, start, payload) of the records that own the given chunks, by a second scan.

    Raises if that scan lacks a chunk: splits are held the same, but files may have changed.
    """
    numbered = in_arrow(
        _scanned(spark, path), _numbered, "file long, split_start long, rel long, chunk binary"
    )
    return (
        owned.join(numbered, ["file", "split_start", "rel"], "left")
        .groupBy("file", "start")
        .applyInPandas(_joined_payload, "file long, start long, payload binary")
    )


def read_warc(
    spark: SparkSession, path: str, payloads: bool = False, block_bytes: int = CHAIN_BLOCK
) -> DataFrame:
    """The records of the uncompressed archives below ``path``.

    Tasks read splits of the archives, cut at the magic ``WARC/1.0``, and report each candidate
    with the offset of its successor; the magic may as well stand inside a payload. Only what
    the chain of successors reaches from the start of its file is a record. Payloads that the
    magic cuts are put together by a second scan of the archives, which also returns all
    payloads if they are asked for.

    Columns: file, offset, record_type, page_id, payload_bytes, payload_digest (lower-case hex
    SHA-1, of a revisit those of the full payload), refers_to, intact (the digest is the one in
    the header), and ``payload`` on demand (null for revisits). A folder without records gives
    an empty table. A record cut by the end of its file has null digest and is not intact.
    """
    with _splits_fixed(spark):
        return _read(spark, path, payloads, block_bytes)


def _read(spark: SparkSession, path: str, payloads: bool, block_bytes: int) -> DataFrame:
    chunks = staged(in_arrow(_scanned(spark, path), _chunks, _CHUNK), "warc-chunks")
    end = F.max(F.col("rel") + F.col("size") + len(MAGIC))
    used = chunks.groupBy("file", "split_start").agg(end.alias("used"))
    splits = Window.partitionBy("file").orderBy("split_start")
    earlier = F.sum("used").over(splits.rowsBetween(Window.unboundedPreceding, -1))
    bases = used.select("file", "split_start", F.coalesce(earlier, F.lit(0)).alias("base"))
    placed = staged(
        chunks.join(bases, ["file", "split_start"]).withColumn("at", F.col("base") + F.col("rel")),
        "warc-placed",
    )
    candidate = F.col("length").isNotNull() & (F.col("at") >= len(MAGIC))
    start = (F.col("at") - len(MAGIC)).alias("start")
    candidates = placed.where(candidate).select("file", start, (start + F.col("length")).alias("next"))
    reached = staged(_chained(candidates, block_bytes).withColumn("reached", F.lit(True)), "warc-records")

    marked = placed.withColumn("start", F.col("at") - len(MAGIC)).join(reached, ["file", "start"], "left")
    records = marked.where("reached")
    order = Window.partitionBy("file").orderBy("at")
    own = F.struct("start", "head", "length", (F.col("payload_digest").isNull()).alias("cut"))
    owner = F.last(F.when(F.col("reached"), own), True).over(order).alias("owner")
    owned = marked.select("file", "split_start", "rel", "size", "at", owner)
    owned = owned.select("file", "split_start", "rel", "size", "at", "owner.*")
    owned = owned.where(F.col("at") < F.col("start") + F.col("length"))
    if not payloads:
        owned = owned.where("cut")
    if payloads or records.where("payload_digest IS NULL").limit(1).count():
        joined = staged(_payloads(spark, path, owned), "warc-payloads").select(
            "file",
            "start",
            "payload",
            F.sha1("payload").alias("joined_digest"),
            F.octet_length("payload").cast("long").alias("joined_bytes"),
        )
        records = records.join(joined, ["file", "start"], "left")
    else:
        nothing = F.lit(None)
        records = records.withColumns(
            {
                "payload": nothing.cast("binary"),
                "joined_digest": nothing.cast("string"),
                "joined_bytes": nothing.cast("long"),
            }
        )

    revisit = F.col("kind") == "revisit"
    digest = F.when(revisit, F.col("digest")).otherwise(F.coalesce("payload_digest", "joined_digest"))
    length = F.coalesce("payload_bytes", "joined_bytes")
    length = F.when(revisit, F.col("http_length")).otherwise(length)
    found = records.select(
        "file",
        F.col("start").alias("offset"),
        F.col("kind").alias("record_type"),
        F.regexp_extract("page", r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long").alias("page_id"),
        length.alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.regexp_extract("refers_to", r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long").alias("refers_to"),
        (digest == F.col("digest")).alias("intact"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    return found if payloads else found.drop("payload")


def op9_warc(spark, sf_dir):
    path = scratch_dir(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


OP9_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), kept AS (
  SELECT html, max(page_id) AS keep FROM payloads WHERE n >= 1000 GROUP BY html
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN keep > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep > page_id THEN keep END AS refers_to, true AS intact
FROM payloads LEFT JOIN kept USING (html)
"""
