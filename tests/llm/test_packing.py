from __future__ import annotations

import bisect
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from callstream.llm.packing import _brackets, _WordIds, op7_best_fit, pack, tokenized_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def placed(rows, capacity):
    """Check that the rows lie without gap or overlap; the number of sequences."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_are_those_of_the_tokenizer(spark, make_docs):
    texts = ["The cat's 12th naïve DOG!!  it'll run", "", "é é ﬁ ①②\ttabs\r\nand…", "日本 語 <|endoftext|> x"]
    texts += ["<|startoftext|>", "a<|endoftext|>b \n<|EndOfText|>", "<|endoftext|><|endoftext|>  <|startoftext|> x" * 40]
    texts += ["word%d " % i * 700 for i in range(3)]
    docs = make_docs(list(enumerate(texts)) + [(90, None), (None, "no id"), (91, "same"), (91, "same")])
    tokenizer = Tokenizer.from_file(PATH)
    found = defaultdict(list)
    for r in tokenized_pieces(docs, capacity=64).collect():
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        found[r["doc_id"]].append((r["piece"], r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    for doc, text in list(enumerate(texts)) + [(90, ""), (None, "no id")]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        cut = [(k, s, ids[s : s + 64]) for k, s in enumerate(range(0, len(ids), 64))]
        assert sorted(found[doc]) == cut
    assert len(found[91]) == 2


def serial(lengths, capacity):
    """Best fit, the longest first, one after the other: the number of sequences."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return len(rooms)


def test_brackets_against_a_stack():
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 200):
        is_gap = np.array([rng.random() < 0.5 for _ in range(n)], bool)
        expected, free = [], []
        for at, gap in enumerate(is_gap):
            if not gap:
                free.append(at)
            elif free:
                expected.append((free.pop(), at))
        _, rows, gaps = _brackets(is_gap)
        assert sorted(zip(rows.tolist(), gaps.tolist())) == sorted(expected)


def packed(spark, lengths, capacity, range_rows):
    rows = spark.createDataFrame(list(enumerate(lengths)), "row long, length long").repartition(4)
    found = pack(rows, capacity, range_rows).collect()
    assert sorted((r["row"], r["length"]) for r in found) == list(enumerate(lengths))
    return found


@pytest.mark.parametrize("range_rows", [60, 100_000])
def test_few_sequences(spark, range_rows):
    rng = random.Random(7)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 1000), 333, 1000]) for _ in range(1500)]
    n = placed(packed(spark, lengths, 1000, range_rows), 1000)
    assert math.ceil(sum(lengths) / 1000) <= n <= serial(lengths, 1000) * 1.01


def test_ranges_do_not_change_the_number(spark):
    """What the borders part is matched as if there were none: equal rows and gaps per size."""
    lengths = [int(1000 * random.Random(i).random() ** 2) + 1 for i in range(700)]
    kinds = []
    for range_rows in (50, 100_000):
        sequences = defaultdict(list)
        for r in packed(spark, lengths, 1000, range_rows):
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        kinds.append(len(sequences))
    assert kinds[0] == kinds[1]


def test_one_length_of_a_third(spark):
    lengths = [400 if i % 3 else 250 for i in range(900)]
    assert placed(packed(spark, lengths, 1000, 100), 1000) <= serial(lengths, 1000)


@pytest.mark.parametrize("lengths", [[1] * 3000, [1000] * 9 + [501] * 5, [499, 2] * 300, [500]])
def test_hard_lengths(spark, lengths):
    assert placed(packed(spark, lengths, 1000, 500), 1000) == serial(lengths, 1000)


def test_edges(spark):
    schema = "doc_id long, length long, block string, size string, ID string, __row string, offset string"
    assert pack(spark.createDataFrame([], schema), 10).collect() == []
    some = [(1, 10, "a"), (1, 10, "a"), (None, 4, "b"), (2, 4, "b"), (2, 4, "b"), (3, None, "c"), (3, 0, "c"), (4, 12, None)]
    rows = spark.createDataFrame([(*r, "s", None, "r", "o") for r in some], schema)
    found = pack(rows, 10)
    assert found.columns == ["doc_id", "length", "block", "size", "ID", "__row", "sequence_id", "offset"]
    got = found.collect()
    key = repr
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(some, key=key)
    assert {(r["size"], r["ID"], r["__row"]) for r in got} == {("s", None, "r")}
    odd = [r for r in got if r["length"] not in (4, 10)]
    assert len({r["sequence_id"] for r in odd}) == 3 and {r["offset"] for r in odd} == {0}
    assert placed([r for r in got if r["length"] in (4, 10)], 10) == 4


def test_query_over_a_table(spark):
    """All ids of all documents, by the plain tokenizer; placed in few sequences."""
    folder = "/root/testdata/sf0.001"
    rows = op7_best_fit(spark, folder).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = {}
    for doc, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            expected[doc, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    assert len(rows) == len(expected)
    assert placed(rows, 4096) <= serial([r["length"] for r in rows], 4096) * 1.01 + 1


def test_added_tokens_are_looked_for_in_many_words_at_once():
    asked = []

    class Added(list):
        def __iter__(self):
            asked.append(1)
            return super().__iter__()

    words = _WordIds(PATH)
    words.added = Added(words.added)
    text = " ".join(f"word{i}" for i in range(5000))
    expected = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.encode(pa.array(["", text, None]))[1], "<u4").tolist() == expected
    assert len(asked) < 10
    text += " x<|EndOfText|>y"
    expected = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.encode(pa.array([text]))[0], "<u4").tolist() == expected
    assert words.odd == {b"x<|EndOfText|>y"}
