from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from callstream.llm import quality
from callstream.llm.common import documents

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORD, text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {
        i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1
    }
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            repeats += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return [len(words), sum(map(len, words)), symbols, repeats, len(covered)]


def test_statistics_against_brute_force():
    rng = random.Random(1)
    parts = ["a", "b", "été", "\n", "\t", "x|y", "##", " ", "\r\n", " ", "日本", "a b a b", "\x0b"]
    texts = [None, "", " \n\n", "one", "a a a a", "a b c a b c"]
    texts += ["".join(rng.choice(parts) + rng.choice([" ", ""]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for text in texts:
        data = None if text is None else text.encode()
        assert quality.text_statistics(data)[0] == brute(text), text


def prose(rng, n=80):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


def test_junk_goes_and_prose_stays(spark, make_docs):
    rng = random.Random(5)
    docs, labels = [], []
    for doc in range(400):
        text = prose(rng)
        if doc % 10 == 0:
            text = " | ".join(text.upper().split()) if doc % 20 else "%%% ".join(text.split())
        docs.append((doc, text))
        if doc % 2 == 0:
            labels.append((doc, int(doc % 10 != 0)))
    table = spark.createDataFrame(labels + [(7, None), (9999, 0)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.judge_quality(make_docs(docs), table).collect()}
    wrong = [d for d, _ in docs if found[d]["kept"] != (d % 10 != 0)]
    assert len(wrong) <= 4
    assert not any(r["base_failed"] for r in found.values())


def test_edges(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rng = random.Random(6)
    long = prose(rng, 30_000)
    docs = [(1, None), (2, ""), (3, "too short"), (4, long), (4, long), (None, prose(rng)), (6, "a b c " * 60)]
    clash = make_docs(docs).withColumnRenamed("lang", "kept")
    rows = quality.judge_quality(clash, none).collect()
    assert len(rows) == 7
    kept = {(r["doc_id"], r["kept"]) for r in rows}
    assert kept == {(1, False), (2, False), (3, False), (4, True), (None, True), (6, False)}
    assert quality.judge_quality(make_docs([]), none).collect() == []
    bad = spark.createDataFrame([(4, 0)], "doc_id long, quality int")
    assert quality.judge_quality(make_docs(docs), bad).where("kept").count() == 3


def test_paths_of_far_rows_are_shorter():
    rng = np.random.default_rng(0)
    usual = rng.normal(0, 0.1, (500, 2))
    forest = quality.grow_forest(usual, np.array([-2.0, -2.0]), np.array([2.0, 2.0]))
    inside, outside = forest.scores(np.array([[0.0, 0.0], [1.5, 1.5]]))
    assert outside > inside + 0.1


def test_labelled_rows_of_the_table(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.judge_quality(documents(spark, sf_dir), labels).where("NOT base_failed")
    counts = found.join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in counts}
    assert n.get((1, False), 0) <= 0.02 * n[1, True]
    assert n.get((0, True), 0) <= 0.2 * n[0, False]
