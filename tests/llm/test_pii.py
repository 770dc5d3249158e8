from __future__ import annotations

import random
import re

import numpy as np

from callstream.llm import pii
from callstream.llm.common import documents


def brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(found)]


def test_base_spans_against_the_patterns():
    rng = random.Random(3)
    parts = ["a", "é", ".", "@", "-", "_", "+", " ", "1", "23", "255", "4111 1111 1111 1111", "a.b@c.d", "@x.y", "10.0.0.1", "+1 (555) 123-4567", "\n", "(", ")", "0000000000000000"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000):
        assert pii.base_spans(text + " x@y.zz")[-1][1] == "email"


def corpus():
    docs = []
    for i in range(200):
        mail, phone = f"u{i}@mail{i % 9}.example.com", f"+{i % 9 + 1} (555) 0{i % 100:02d}-{1000 + i}"
        docs.append((i, f"contact ü {mail} or call {phone} from 10.0.{i}.7"))
    docs.append((300, "please write to jane (at) example (dot) com today"))
    docs.append((301, "please call (555) 234-5678 any time"))
    docs.append((302, "we met at noon, version 1 . 2 . 3 . 4 of it"))
    return docs


def spans(spark, docs):
    found = {}
    for r in pii.find_personal_data(docs).collect():
        found.setdefault(r["doc_id"], []).append([(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]])
    return found


def test_base_stays_and_the_method_adds(spark, make_docs):
    found = spans(spark, make_docs(corpus()))
    for doc, text in corpus()[:200]:
        (own,) = found[doc]
        assert [(k, s, e) for k, s, e, base in own if base] == [(k, s, e) for s, k, e in brute(text)]
    ((added,),) = (found[301],)
    assert added[0][0] == "phone" and not added[0][3]
    assert found[302] == [[]]


def test_edges(spark, make_docs):
    docs = [(1, None), (2, ""), (3, "a@b.cc"), (3, "a@b.cc"), (None, "x 10.1.2.3"), (5, "w " * 200_000 + "é a@b.cc")]
    found = spans(spark, make_docs(docs).withColumnRenamed("lang", "spans"))
    assert found[1] == found[2] == [[]]
    assert found[3] == [[("email", 0, 6, True)]] * 2
    assert found[None] == [[("ip", 2, 10, True)]]
    assert found[5] == [[("email", 400_002, 400_008, True)]]
    digits = [(6, "0" * 5000 + ".1.1.1"), (7, "1.1.1." + "0" * 4400 + "7"), (8, "1.1.1." + "9" * 4400)]
    found = spans(spark, make_docs(digits))
    assert [len(found[i][0]) for i in (6, 7, 8)] == [1, 1, 0]
    assert pii.find_personal_data(make_docs([])).collect() == []


def test_reliabilities_tell_good_labelers_from_bad():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.4
    votes = np.zeros(4000, int)
    right = (0.95, 0.9, 0.55, 0.9, 0.5)
    for labeler, share in enumerate(right):
        correct = rng.random(4000) < share
        votes |= np.where(correct == truth, 2, 1) << (2 * labeler)
    patterns, inverse, counts = np.unique(votes, return_inverse=True, return_counts=True)
    posterior, says = pii.reliabilities(patterns, counts)
    assert ((posterior[inverse] > 0.5) == truth).mean() > 0.95
    assert says[0, 1, 2] > 0.9 and abs(says[4, 1, 2] - 0.5) < 0.1


def test_whole_table_against_the_patterns(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in pii.find_personal_data(docs).collect():
        base = [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["base"]]
        assert base == brute(texts[r["doc_id"]] or "")
