from __future__ import annotations

import hashlib
import random

import pytest

from callstream.llm import warc
from callstream.workspace import scratch_dir

SCHEMA = "page_id long, url string, html string, offset string"
FAKE = (
    "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\n"
    "Content-Length: 5\r\n\r\nhello\r\n\r\n"
)


def expected(pages):
    most = {}
    for page, _, html, _ in pages:
        if len((html or "").encode()) >= 1000 and page is not None:
            most[html] = max(page, most.get(html, page))
    rows = []
    for page, _, html, _ in pages:
        data = (html or "").encode()
        keep = most.get(html) if page is not None else None
        revisit = keep is not None and keep > page
        rows.append(
            (
                page,
                len(data),
                hashlib.sha1(data).hexdigest(),
                "revisit" if revisit else "response",
                keep if revisit else None,
            )
        )
    return sorted(rows, key=str)


def read(spark, pages, **options):
    path = scratch_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(pages, SCHEMA).repartition(3), path)
    return warc.read_warc(spark, path, **options)


def digests(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {key: spark.conf.get(key) for key in keys}
    yield lambda size: [spark.conf.set(key, str(size)) for key in keys]
    for key, value in before.items():
        spark.conf.set(key, value)


def hostile_pages():
    rng = random.Random(4)
    pages = [
        (1, "http://a/1", None, "x"),
        (2, None, "", "x"),
        (3, "http://a/\r\n3", FAKE, "x"),
        (4, "http://a/4", "WARC/1.0\r\n" * 50, "x"),
        (5, "http://a/5", "é\r\n\r\nWARC/1.0\r\nContent-Length: 99999999\r\n\r\n", "x"),
        (None, "http://a/6", "no id", "x"),
        (7, "http://a/7", "ends in the magic WARC/1.0\r\n", "x"),
        (7, "http://a/7", "ends in the magic WARC/1.0\r\n", "x"),
    ]
    large = "<p>" + FAKE * 40 + "WARC/1.0"
    pages += [(n, f"http://b/{n}", large, "x") for n in range(10, 40)]
    for n in range(100, 260):
        text = "".join(rng.choice(["ab\n", "ü", "\r\n", "WARC/1.0\r\n", FAKE, "x" * 90]) for _ in range(rng.randint(0, 60)))
        pages.append((n, f"http://c/{n}", text, "x"))
    return pages


@pytest.mark.parametrize("split", [5000, 1 << 20])
def test_round_trip_with_magic_in_payloads(spark, small_splits, split):
    pages = hostile_pages()
    path = scratch_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(pages, SCHEMA).repartition(3), path)
    small_splits(split)
    assert digests(warc.read_warc(spark, path, block_bytes=4096)) == expected(pages)


def test_payloads_come_back_whole(spark):
    pages = hostile_pages()
    found = read(spark, pages, payloads=True)
    texts = sorted(
        (str(r["page_id"]), bytes(r["payload"]).decode())
        for r in found.collect()
        if r["record_type"] == "response"
    )
    kept = {row[0] for row in expected(pages) if row[3] == "response"}
    assert texts == sorted((str(p), h or "") for p, _, h, _ in pages if p in kept)
    assert all(r["intact"] for r in found.collect())


def test_no_pages(spark):
    assert digests(read(spark, [])) == []


def test_cut_archive_is_not_intact(spark, tmp_path):
    record = FAKE.replace("Content-Length: 5", "Content-Length: 500")
    (tmp_path / "cut.warc").write_bytes((FAKE + record).encode())
    found = sorted(warc.read_warc(spark, str(tmp_path)).collect(), key=lambda r: r["offset"])
    assert [r["payload_bytes"] for r in found] == [5, found[1]["payload_bytes"]]
    assert not found[1]["intact"]


def _second_scan_after(spark, monkeypatch, name, value):
    """Change a setting between the two scans of a read."""
    before, payloads = spark.conf.get(name, None), warc._payloads

    def later(*args):
        spark.conf.set(name, value)
        try:
            return warc.staged(payloads(*args), "late-payloads")
        finally:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)

    monkeypatch.setattr(warc, "_payloads", later)


def test_executors_may_come_between_the_scans(spark, small_splits, monkeypatch):
    pages = hostile_pages()
    _second_scan_after(spark, monkeypatch, "spark.sql.leafNodeDefaultParallelism", "64")
    small_splits(5000)
    assert digests(read(spark, pages)) == expected(pages)


def test_other_chunks_in_the_second_scan_are_an_error(spark, small_splits, monkeypatch):
    _second_scan_after(spark, monkeypatch, "spark.sql.files.maxPartitionBytes", "1500")
    small_splits(5000)
    with pytest.raises(Exception, match="other chunks"):
        read(spark, hostile_pages()).collect()
