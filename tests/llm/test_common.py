from __future__ import annotations

import pyarrow as pa

from callstream.llm import common, jaccard, packing


def test_a_worker_keeps_what_one_module_looked_up(monkeypatch):
    returned = []
    monkeypatch.setattr(common, "_return_memory", lambda: returned.append(1))
    monkeypatch.setattr(common, "_caches", {"one": {"a": 1}, "other": {"b": 2}})
    common._begin_task("other")
    assert common._caches == {"one": {}, "other": {"b": 2}} and returned == [1]
    common._begin_task("other")
    assert returned == [1]


def test_words_of_packing_and_of_the_join_are_kept_that_way():
    assert packing._tokenizers is common.cache(packing.__name__)
    assert jaccard._word_hashes is common.cache(jaccard.__name__)


def test_texts_come_one_after_the_other():
    found = common.as_bytes(pa.array(["é", None, ""]))
    assert not isinstance(found, list)
    assert list(found) == ["é".encode(), None, b""]
