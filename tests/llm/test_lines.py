from __future__ import annotations

import random

import pytest

from callstream.llm import lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_chars=10):
    def key(line):
        return line.strip(BLANKS).translate(LOWER)

    holders = {}
    for doc, text, *_ in docs:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text, *_ in docs:
        own = (text or "").split("\n")
        kept = [
            line
            for line in own
            if doc is None or len(holders.get(key(line), ())) < 2 or min(holders[key(line)]) == doc
        ]
        out.append((doc, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    common = ["A line that many hold", "ünïcödé zeile hier", "tiny", " nbsp stays here ", ""]
    docs = []
    for doc in range(120):
        own = [f"only {doc} has line {n} of these" for n in range(rng.randint(0, 4))]
        picked = [rng.choice(common) for _ in range(rng.randint(0, 6))]
        text = own + [rng.choice([" ", "\t", ""]) + rng.choice([p, p.upper()]) + " \r" for p in picked]
        rng.shuffle(text)
        docs.append((doc, "\n".join(text)))
    docs += [(7, docs[7][1]), (5, "another text of five\n" + common[0]), (200, None), (201, "")]
    docs += [(None, common[0] + "\n" + common[1]), (300, "\n".join([common[0]] * 500 + ["x" * 50_000]))]
    return docs


@pytest.mark.parametrize("max_bits", [20, 29])
def test_against_brute_force(spark, make_docs, max_bits):
    docs = corpus()
    found = lines.drop_repeated_lines(make_docs(docs), max_filter_bits=max_bits)
    rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()]
    assert sorted(rows, key=repr) == brute(docs)


def test_edges(spark, make_docs):
    assert lines.drop_repeated_lines(make_docs([])).collect() == []
    clash = make_docs([(1, "the same line"), (2, "The same line ")]).withColumnRenamed("lang", "n_lines")
    found = lines.drop_repeated_lines(clash)
    assert found.columns == ["doc_id", "text", "source", "n_chars", "n_lines", "n_dropped"]
    assert [(r["text"], r["n_dropped"]) for r in found.orderBy("doc_id").collect()] == [
        ("the same line", 0),
        ("", 1),
    ]


def test_filter_size_follows_the_lines():
    assert lines.filter_bits(0, 29) == 20
    assert lines.filter_bits(1 << 20, 29) == 25
    assert lines.filter_bits(10**12, 29) == 29
