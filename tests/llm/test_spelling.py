from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from callstream.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs, damage):
    counts = Counter()
    for doc, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out, forms, facts = [], {}, {}
    for word, n in words.items():
        others = [o for o in words if abs(len(o) - len(word)) < 2 and near(word, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] < 2 * n:
            best = None
        forms[word], facts[word] = best, (n, len(others), words.get(best))
    for word, (n, n_near, form_n) in facts.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        out.append((word, forms[word], root, n, n_near, form_n))
    return sorted(out, key=repr)


def found(df):
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    assert df.columns == columns
    return sorted([tuple(r) for r in df.collect()], key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdeßéÿ×", k=rng.randint(4, 7))) for _ in range(60)]
    words = []
    for stem in stems:
        for _ in range(rng.randint(1, 40)):
            word = list(stem)
            if rng.random() < 0.5:
                at = rng.randrange(len(word))
                word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "b"])
            words += ["".join(word)] * rng.randint(1, 3)
    words += ["chaine"] * 9 + ["chain"] * 30 + ["chair"] * 90
    rng.shuffle(words)
    return [(i, " ".join(words[i::40]).title()) for i in range(40)]


@pytest.mark.parametrize("block, damage", [(16_384, 97), (7, 5), (3, 0)])
def test_against_all_pairs(spark, make_docs, monkeypatch, block, damage):
    monkeypatch.setattr(spelling, "BLOCK", block)  # read where the plan is made
    rows = corpus()
    expected = brute(rows, damage)
    assert len(expected) > 100 and any(r[1] and r[1] != r[2] for r in expected)
    assert found(spelling.spelling_variants(make_docs(rows), damage)) == expected


def test_edges(spark, make_docs):
    assert found(spelling.spelling_variants(make_docs([]), 97)) == []
    long = "x" * 300
    rows = [
        (None, "alone alone ALONE alonE"),
        (None, "alone alone"),
        (1, None),
        (1, ""),
        (2, "\n1234 ' - "),
        (3, "abcd abcd abcd"),
        (4, f"{long} {long}y {long} {long}y {long} {long}y {long} {long} {long} ab{'x' * 298}"),
        (5, "aalone aalone aalone Éclair éclair éclair éclair éclair"),
        (5, "aalone aalone aalone Éclair éclair éclair éclair éclair"),
        (6, "word " * 50_000 + "wordy " * 9 + "words " * 9 + "worda " * 4),
    ]
    for damage in (0, 7):
        clash = make_docs(rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
        assert found(spelling.spelling_variants(clash, damage)) == brute(rows, damage)


def test_ties_go_to_the_first_in_code_point_order(spark, make_docs):
    rows = [(1, "basic " * 3 + "basis " * 6 + "bassic " * 6 + "bäsic " * 6)]
    (row,) = [r for r in found(spelling.spelling_variants(make_docs(rows), 0)) if r[0] == "basic"]
    assert row == ("basic", "basis", "basis", 3, 3, 6)


def test_distances_are_those_of_the_letter_counts():
    rng = random.Random(2)
    for size in (5, 9, 250):
        left = ["".join(rng.choices("abcÿ", k=size)) for _ in range(40)]
        right = ["".join(rng.choices("abcÿ", k=size + 1)) for _ in range(40)]
        sides = [spelling.Words(w, np.arange(40), size + 4) for w in (left, right)]
        for other, limit in ((sides[0], 2), (sides[1], 1)):
            pairs = [p for x, y in spelling.candidates(sides[0], other, False) for p in zip(x, y)]
            square = ((sides[0].counts[:, None] - other.counts[None]) ** 2).sum(axis=2)
            assert sorted(pairs) == sorted(zip(*np.nonzero(square == limit)))


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w20"}
