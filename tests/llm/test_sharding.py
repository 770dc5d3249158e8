from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from callstream.llm.sharding import (
    _large_hypergeometric,
    draw_columns,
    matrix_row,
    near_equal,
    shuffle_to_shards,
)


def test_rows_of_the_matrix_fit_together():
    counts, sizes = np.array([5, 0, 17, 3, 40, 1]), near_equal(66, 7)
    rows = np.array([matrix_row(counts, sizes, p, 3) for p in range(len(counts))])
    assert rows.sum(axis=1).tolist() == counts.tolist()
    assert rows.sum(axis=0).tolist() == sizes.tolist()


def test_large_draws_have_the_right_spread():
    rng = np.random.default_rng(1)
    found = np.array([_large_hypergeometric(rng, 300, 700, 100) for _ in range(4000)])
    assert abs(found.mean() - 30) < 0.3
    assert abs(found.var() - 100 * 0.3 * 0.7 * 900 / 999) < 1.5
    huge = draw_columns(rng, np.full(40, 10**9), 10**10)
    assert huge.sum() == 10**10 and abs(huge - 250_000_000).max() < 200_000


@pytest.mark.parametrize("bucket_rows", [7, 10_000])
def test_whole_and_even_shards(spark, make_docs, bucket_rows):
    docs = make_docs([(i % 300, f"text {i}") for i in range(500)] + [(None, None), (None, "")], 5)
    found = shuffle_to_shards(docs, 6, bucket_rows=bucket_rows).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(
        (r["doc_id"], r["text"]) for r in docs.collect()
    )
    shards = Counter(r["shard"] for r in found)
    assert sorted(shards) == list(range(6)) and max(shards.values()) - min(shards.values()) <= 1
    for shard, n in shards.items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))


def test_the_same_seed_repeats_and_another_does_not(spark, make_docs):
    docs = make_docs([(i, "x") for i in range(200)]).sortWithinPartitions("doc_id")

    def places(seed):
        rows = shuffle_to_shards(docs, 4, seed=seed).collect()
        return {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}

    assert places(1) == places(1) != places(2)


def test_a_uniform_shuffle(spark, make_docs):
    docs = make_docs([(i, "x") for i in range(40)], 4).cache()
    hits = np.zeros((40, 4))
    for seed in range(30):
        for r in shuffle_to_shards(docs, 4, seed=seed).select("doc_id", "shard").collect():
            hits[r["doc_id"], r["shard"]] += 1
    docs.unpersist()
    # 120 cells of freedom, about 7.5 hits expected in each.
    assert ((hits - 7.5) ** 2 / 7.5).sum() < 190


def test_edges(spark, make_docs):
    assert shuffle_to_shards(make_docs([]), 3).collect() == []
    clash = make_docs([(1, "a"), (1, "a")]).withColumnRenamed("lang", "Shard")
    found = shuffle_to_shards(clash, 3)
    assert found.columns == ["doc_id", "text", "source", "n_chars", "shard", "slot"]
    assert found.count() == 2
