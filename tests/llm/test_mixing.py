from __future__ import annotations

import hashlib
import math
from collections import Counter

import duckdb
import pytest

from callstream.llm.mixing import OP10_SQL, mix_sources, op10_poisson_mix, poisson_steps


def draw(doc_id, seed=17):
    key = f"{seed}:{'null' if doc_id is None else doc_id}"
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52


def copies(rate, u):
    n, p, total = 0, math.exp(-rate), 0.0
    while True:
        total += p
        if u < total or p < 1e-18 and n > rate:
            return n
        n += 1
        p *= rate / n


def brute(docs, weights=None, temperature=0.5):
    size = Counter()
    for _, text, _, source in docs:
        size[source] += len((text or "").encode())
    share = {s: weights.get(s, 0) if weights else b**temperature for s, b in size.items() if b}
    total, all_bytes = sum(share.values()), sum(size.values())
    rate = {s: share[s] / total * all_bytes / size[s] if size[s] else 1.0 for s in size}
    return Counter(
        {doc: n for doc, _, _, source in docs if (n := copies(rate[source], draw(doc)))}
    )


def corpus():
    docs = [(i, "x" * (1 + i % 50), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    return docs + [(600, None, "en", "silent"), (601, "", "en", "silent"), (602, "é" * 40, "en", None)]


@pytest.mark.parametrize("weights", [None, {"hot": 1, "s0": 3, "s3": 2}])
def test_copies_follow_the_draws(spark, make_docs, weights):
    docs = make_docs(corpus())
    table = weights and spark.createDataFrame(list(weights.items()), "source string, weight long")
    found = mix_sources(docs, table).collect()
    assert Counter(r["doc_id"] for r in found) == brute(corpus(), weights)
    assert [r["mix_key"] for r in found] == sorted(r["mix_key"] for r in found)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by_id.values())


def test_shares_come_near_the_targets(spark, make_docs):
    docs = [(i, "word " * 10, "en", "hot" if i % 10 else "rare") for i in range(4000)]
    table = spark.createDataFrame([("hot", 1.0), ("rare", 1.0)], "source string, weight double")
    found = Counter(r["source"] for r in mix_sources(make_docs(docs), table).collect())
    assert abs(found["hot"] - 2000) < 200 and abs(found["rare"] - 2000) < 300


def test_edges(spark, make_docs):
    assert mix_sources(make_docs([])).collect() == []
    repeated = make_docs([(1, "a b"), (1, "a b"), (None, "c")] * 3)
    renamed = repeated.withColumnRenamed("lang", "copy").withColumnRenamed("n_chars", "mix_key")
    found = mix_sources(renamed, repetition=3.0)
    assert found.columns == ["doc_id", "text", "source", "copy", "mix_key"]
    counts = Counter((r["doc_id"], r["copy"]) for r in found.collect())
    assert counts and all(n == (3 if doc is None else 6) for (doc, _), n in counts.items())


@pytest.mark.parametrize("rate", [0.0, 0.01, 1.0, 30.0, 5000.0])
def test_poisson_steps(rate):
    first, steps = poisson_steps(rate)
    assert steps == sorted(steps) and steps[-1] == 1.0
    assert len(steps) < 30 * math.sqrt(rate) + 100
    for u in (0.0, 0.1, 0.5, 0.999, 1 - 1e-9):
        found = first + sum(s <= u for s in steps)
        if rate < 100:
            assert found == copies(rate, u)
        else:
            assert abs(found - rate) < 12 * math.sqrt(rate) + 41


def test_sql_of_a_tiny_source(spark, make_docs, tmp_path):
    docs = [(doc, "x" * 4_000_000, "en", "web") for doc in range(4)] + [(9, "a", "en", "tiny")]
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = connection.execute(f"select doc_id, copy, mix_key from ({OP10_SQL})").fetchall()
    found = op10_poisson_mix(spark, str(tmp_path)).select("doc_id", "copy", "mix_key").collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    assert sum(doc == 9 for doc, *_ in expected) > 3000
