from __future__ import annotations

import random

import numpy as np
import pytest

from callstream.llm import minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of each row, from all pairs."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for a, (doc, _) in enumerate(rows):
        ids = [rows[r][0] for r in range(len(rows)) if find(r) == find(a) and rows[r][0] is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[a]), least, doc == least))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(10**6))
    return " ".join(words)


def corpus():
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghij", k=3)) for _ in range(n))

    docs, passage = [], prose(60)
    for _ in range(20):
        text = prose(rng.randint(20, 200))
        docs += [text, text.upper(), "  " + text.replace(" ", "\n")]
        docs += [changed(rng, text, rng.randint(1, 4)) for _ in range(rng.randint(0, 5))]
    base = prose(150)
    docs += [changed(rng, base, rng.choice([1, 2, 4, 5])) for _ in range(120)]  # a hub links some only
    for _ in range(15):  # chains: each a step further from the first
        docs.append(changed(rng, docs[-1], 1))
    docs += [passage + " " + prose(rng.randint(5, 120)) for _ in range(80)]
    docs += ["one", "ONE", "one two", "a b c d", "a b c d e", "b c d e", None, None, "", " \n\t", "é É"]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    return rows + [rows[0], (None, docs[0]), (None, "alone without any id"), (None, "alone without any id")]


@pytest.mark.parametrize("bucket, blocks, star, ids", [(512, 32, 2048, 10**6), (8, 4, 8, 0)])
def test_against_all_pairs(spark, make_docs, monkeypatch, bucket, blocks, star, ids):
    sizes = {"BUCKET": bucket, "GROUP": bucket, "BLOCKS": blocks, "STAR": star, "BROADCAST_ROWS": ids}
    for name, value in sizes.items():
        monkeypatch.setattr(minhash, name, value)  # read where the plan is made
    rows = corpus()
    assert found(minhash.near_duplicates(make_docs(rows))) == brute(rows)


def test_links_that_no_star_has(spark, make_docs):
    """Copies that only one member of a large group is close enough to."""
    rng, rows = random.Random(8), []
    for family in range(6):
        words = [f"{family}w{i}" for i in range(300)]
        members = []
        for member in range(30):
            copy = list(words)
            copy[member] = f"{family}m{member}"
            members.append(copy)
        far = list(members[-1])
        for at in range(60, 128, 9):
            far[at] = f"far{family}{at}"
        members.append(far)
        rows += [(len(rows) + i, " ".join(m)) for i, m in enumerate(members)]
    expected = brute(rows)
    assert found(minhash.near_duplicates(make_docs(rows))) == expected


def test_edges(spark, make_docs):
    assert minhash.near_duplicates(make_docs([])).collect() == []
    rows = [(1, "word " * 100_000), (2, "Word " * 4), (3, None), (3, None), (None, ""), (4, "x y"), (4, "x y"), (5, "x y z")]
    clash = make_docs(rows).withColumnRenamed("lang", "row").withColumnRenamed("source", "signature")
    assert found(minhash.near_duplicates(clash)) == brute(rows)


def test_densified_bins_agree_as_often_as_the_sets():
    rng = np.random.default_rng(1)
    for size in (4, 9, 40, 400):
        rates = []
        for _ in range(300):
            tokens = np.unique(rng.integers(0, 2**63, size + 2, dtype=np.uint64) * np.uint64(2))
            first, second = np.sort(tokens[:-1]), np.sort(tokens[1:])
            rates.append((minhash.signature(first) == minhash.signature(second)).mean())
        assert abs(np.mean(rates) - size / (size + 2)) < 0.02


def test_recall_of_pairs_at_the_threshold(spark, make_docs):
    rows, pairs = [], 4000
    for pair in range(pairs):
        words = [f"{pair}w{at}" for at in range(103)]  # 80 of 100 shingles in common
        rows += [(2 * pair, " ".join(words[:93])), (2 * pair + 1, " ".join(words[10:]))]
    kept = minhash.near_duplicates(make_docs(rows)).where("kept").count()
    assert kept - pairs <= 1
