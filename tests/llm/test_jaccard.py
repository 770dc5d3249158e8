from __future__ import annotations

import random
from collections import Counter

import pytest

from callstream.llm import jaccard
from callstream.llm.common import documents


def shingles(text):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs, similarity=0.8):
    """(doc_id, class_id, copy_of, n_links) of each row, from all pairs."""
    sets = [shingles(text) for _, text, *_ in docs]
    root, links = list(range(len(docs))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)

    def least(rows):
        ids = [docs[r][0] for r in rows if docs[r][0] is not None]
        return min(ids) if ids else None

    out = []
    for a, (doc, *_) in enumerate(docs):
        same = least(r for r in range(len(docs)) if find(r) == find(a))
        copy = least(r for r in range(len(docs)) if sets[r] == sets[a])
        out.append((doc, same, copy, links[a]))
    return sorted(out, key=repr)


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(10**6))
    return " ".join(words)


def corpus():
    rng = random.Random(11)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghij", k=3)) for _ in range(n))

    passage, docs = prose(40), []
    for family in range(25):
        text = prose(rng.randint(30, 250))
        docs += [text, text, "  " + text.replace(" ", "\n")]
        docs += [changed(rng, text, rng.randint(1, 3)) for _ in range(rng.randint(0, 4))]
    docs += [prose(rng.randint(1, 200)) + " " + passage for _ in range(60)]
    docs += ["one", "one", "two words", "a b c d", "a b c d", "a b c d e", None, "", " \n", "one"]
    base = prose(120)
    docs += [changed(rng, base, 1) for _ in range(70)]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    return rows + [rows[0], (None, docs[0]), (None, "alone without an id here")]


def found(rows):
    return sorted([(r["doc_id"], r["class_id"], r["copy_of"], r["n_links"]) for r in rows.collect()], key=repr)


@pytest.mark.parametrize("bucket, levels", [(512, 3), (16, 2)])
def test_against_all_pairs(spark, make_docs, monkeypatch, bucket, levels):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)  # read where the plan is made
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    rows = corpus()
    assert found(jaccard.similar_documents(make_docs(rows))) == brute(rows)


def test_whole_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(jaccard.similar_documents(docs)) == brute(rows)


def test_edges(spark, make_docs):
    assert jaccard.similar_documents(make_docs([])).collect() == []
    clash = make_docs([(1, "a b c"), (1, "a b c"), (2, "word " * 100_000)]).withColumnRenamed("lang", "set_id")
    assert found(jaccard.similar_documents(clash)) == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 2, 2, 0)]


def test_rows_without_an_id_bring_one_text_each(spark, make_docs, monkeypatch):
    rng = random.Random(5)
    base = " ".join(f"w{i}" for i in range(120))
    texts = [changed(rng, base, 1) for _ in range(40)]
    rows = [(None, text) for text in texts] + [(7, text) for text in texts[:10]] + [(None, texts[0])] * 5
    fetched = []

    def counted(chosen, texts, fetch=jaccard._with_texts):
        fetched.append(fetch(chosen, texts).count())
        return fetch(chosen, texts)

    monkeypatch.setattr(jaccard, "_with_texts", counted)
    assert found(jaccard.similar_documents(make_docs(rows))) == brute(rows)
    assert fetched == [40]  # sets, not rows times rows


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    names = [(f"{a:04d}".encode(), f"{b:04d}".encode()) for a, b in edges]
    df = spark.createDataFrame(names, "a binary, b binary")
    roots = {int(bytes(r["node"])): int(bytes(r["root"])) for r in jaccard.components(df).collect()}
    assert roots == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


def test_runs_follow_the_recall():
    assert jaccard.runs_needed(0.8, 0.9) < jaccard.runs_needed(0.8, 0.999) < jaccard.runs_needed(0.8, 0.999, 3)


def test_pairs_that_meet_at_the_last_level(spark, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 1)  # each shared bucket is split over all levels
    pairs, rows = 5000, []
    for pair in range(pairs):
        words = [f"{pair}w{at}" for at in range(104)]  # 80 of 100 shingles in common
        rows += [(2 * pair, " ".join(words[:94])), (2 * pair + 1, " ".join(words[10:]))]
    linked = jaccard.similar_documents(make_docs(rows)).where("n_links = 1").count() // 2
    assert pairs - linked <= 2 * pairs * (1 - jaccard.RECALL)
