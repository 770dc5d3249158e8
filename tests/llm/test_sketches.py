from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from callstream.llm import sketches
from callstream.llm.common import documents


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(8)
    out = []
    for n in (1, 4, 6, 50, 120, 400, 3000):
        a = prose(rng, n)
        words = a.split()
        out += [(a, a), (a, " ".join(words[: n // 2])), (a, a + " " + prose(rng, n)), (a, prose(rng, n))]
    return out + [(None, ""), ("", "x"), (" \n\t", None), ("a  b\tc\nd e f", "a b c d e f")]


def test_similarity_and_containment(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = sketches.with_sketch(sketches.with_sketch(df, "a", "x"), "b", "y")
    x, y = F.col("x"), F.col("y")
    back, joined = sketches.similarity(y, x), sketches.similarity(sketches.merged(x, y), x)
    rows = df.select("i", sketches.similarity(x, y).alias("s"), sketches.containment(y, x).alias("c"), back.alias("r"), joined.alias("m"), "x", "y")
    for r in rows.collect():
        a, b = (shingles(t) for t in pairs[r["i"]])
        assert r["s"] == r["r"] and 0 <= r["s"] <= 1
        small = len(a) <= sketches.WHOLE and len(b) <= sketches.WHOLE
        assert r["s"] == pytest.approx(jaccard(a, b), abs=1e-9 if small else 0.15)
        if b and r["c"] is not None:
            assert r["c"] == pytest.approx(len(a & b) / len(b), abs=1e-9 if small else 0.2)
        assert r["m"] == pytest.approx(jaccard(a | b, a), abs=1e-9 if small else 0.15)
        if a == b:
            assert r["x"] == r["y"]


def test_a_sketch_is_a_fixed_share(spark):
    text = prose(random.Random(9), 40_000)
    df = sketches.with_sketch(spark.createDataFrame([(text,)], "t string"), "t", "s")
    (row,) = df.select("s", sketches.fingerprint(F.col("s")).alias("f")).collect()
    n = len(shingles(text))
    assert abs(len(row["s"]["hashes"]) - n / sketches.SCALE) < 5 * (n / sketches.SCALE) ** 0.5
    assert row["f"] == f"{sketches.SCALE}:" + "".join(f"{h:016x}" for h in row["s"]["hashes"])


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = sorted((r["doc_id"], r["text"] or "") for r in documents(spark, sf_dir).collect())
    found = {r["doc_id"]: r for r in sketches.op4_scaled_sketch(spark, sf_dir).collect()}
    assert len(found) == len(texts)
    prints = {}
    for at, (doc, text) in enumerate(texts):
        after = texts[(at + 1) % len(texts)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = found[doc]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == pytest.approx(jaccard(shingles(text), shingles(edited)), abs=0.25)
        assert r["near_next"] == pytest.approx(jaccard(shingles(text), shingles(after)), abs=0.25)


def test_order_of_ids(spark):
    ids = [5, -3, 100, 7, 8, 2]
    df = spark.createDataFrame([(i, "x" * (i + 4)) for i in ids] + [(None, "n")], "doc_id long, text string")
    found = sketches.with_previous(df.repartition(4)).collect()
    order = sorted(ids)
    assert {r["doc_id"]: (r["previous_id"], r["previous_chars"]) for r in found} == {
        doc: (before, before + 4) for doc, before in zip(order, order[-1:] + order[:-1])
    }
    assert sketches.with_previous(df.limit(0)).collect() == []


def test_every_row_gives_one_row(spark, tmp_path):
    rng = random.Random(10)
    one, other, third, lost = (prose(rng, n) for n in (40, 60, 80, 30))
    rows = [(1, one), (2, one), (2, other), (2, other), (2, other), (3, third), (None, lost), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = sketches.op4_scaled_sketch(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in found) == sorted((d or 0, len(t or "")) for d, t in rows)
    hashes = {r["text"]: r["key"] for r in df.select("text", F.xxhash64("text").alias("key")).collect()}
    texts = sorted(((d, t) for d, t in rows if d), key=lambda row: (row[0], hashes[row[1]]))
    expected = []
    for at, (doc, text) in enumerate(texts):
        after = texts[(at + 1) % len(texts)][1]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        near = jaccard(shingles(text), shingles(edited)), jaccard(shingles(text), shingles(after))
        expected.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near))
    names = ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")
    assert sorted(tuple(r[n] for n in names) for r in found if r["doc_id"]) == sorted(expected)
    prints = {(r["n_chars"], r["fingerprint"]) for r in found if r["doc_id"] == 2}
    assert len(prints) == 2
    for r in found:
        if r["doc_id"] is None:
            assert r["fingerprint"].startswith("1:") and r["n_chars"] in (0, len(lost))
            assert [r[n] for n in names[2:]] == [None] * 3 and r["edited_fingerprint"] is None
