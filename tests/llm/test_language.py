from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from callstream.llm.common import documents
from callstream.llm.language import held_out_fold, identify_languages, learn_languages

PARTS = {"aa": ["bar", "dof", "gul", "mip"], "zz": ["sch", "ung", "keit", "ein"], "yy": ["cion", "llo", "ñas"]}


def corpus(n=240):
    rng = random.Random(2)
    docs = []
    for doc in range(n):
        lang = rng.choice(list(PARTS))
        words = ["".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(30, 90))]
        docs.append((doc, " ".join(words), lang, "web"))
    return docs


def test_learned_languages_are_found(spark, make_docs):
    docs = make_docs(corpus()).withColumn("held", held_out_fold(F.col("doc_id")))
    model = learn_languages(docs.where("NOT held").drop("held"))
    assert set(model.samples) == set(PARTS)
    found = identify_languages(docs.where("held"), model).collect()
    assert len(found) > 30
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_edges(spark, make_docs):
    model = learn_languages(make_docs(corpus()))
    texts = [(1, None), (2, ""), (3, "12 + 34 = 46!"), (4, "schung keit " * 30_000), (None, "barbar")]
    texts += [(6, "barmip gul"), (6, "barmip gul")]
    clash = make_docs(texts).withColumnRenamed("source", "Score")
    result = identify_languages(clash, model)
    assert result.columns == ["doc_id", "text", "lang", "n_chars", "lang_pred", "score", "rejected"]
    found = {r["doc_id"]: r for r in result.collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "und", "zz"]
    assert all(found[i]["rejected"] and found[i]["score"] == 0 for i in (1, 2, 3))
    assert result.where("doc_id = 6").select("score").distinct().count() == 1
    assert identify_languages(make_docs([]), model).collect() == []
    nothing = learn_languages(make_docs([(1, "text", None, "web"), (2, None)]))
    (only,) = identify_languages(make_docs([(1, "text")]), nothing).collect()
    assert (only["lang_pred"], only["rejected"]) == ("und", True)


def test_a_text_between_languages_has_a_narrow_lead(spark, make_docs):
    model = learn_languages(make_docs(corpus()))
    mixed = " ".join(a + " " + b for a, b in zip(["bardof", "gulmip"] * 40, ["schung", "keitein"] * 40))
    plain = "bardof gulmip dofgul mipbar " * 20
    assert model.predict(mixed)[1] < model.predict(plain)[1]


def test_a_clean_text_of_megabytes_is_not_rejected(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("held", held_out_fold(F.col("doc_id")))
    model = learn_languages(docs.where("NOT held").drop("held"))
    rows = docs.where("held AND lang IS NOT NULL").orderBy("doc_id").select("lang", "text").collect()
    for lang in model.samples:
        words = " ".join(r["text"] for r in rows if r["lang"] == lang).split()
        random.Random(3).shuffle(words)
        short = model.predict(" ".join(words[:1500]))
        long = model.predict(" ".join(random.Random(4).choices(words, k=300_000)))
        assert (short[0], short[2]) == (lang, False)
        assert (long[0], long[2]) == (lang, False)
        assert long[1] > 0.5 * short[1]


@pytest.mark.parametrize("labelled", [50, 200])
def test_a_rare_language_is_learned_beside_large_ones(spark, labelled):
    docs = documents(spark, "/root/testdata/sf0.1").withColumn("held", held_out_fold(F.col("doc_id")))
    rare = docs.where("lang = 'es' AND text != ''").dropDuplicates(["text"])
    drawn = rare.orderBy(F.xxhash64(F.lit(77), "doc_id")).limit(labelled + 225).collect()
    known, unseen = drawn[:labelled], [r["text"] for r in drawn[labelled:]]
    known = docs.where(F.col("doc_id").isin([r["doc_id"] for r in known]))
    model = learn_languages(docs.where("NOT held AND lang != 'es'").unionByName(known).drop("held"))
    right = [found == "es" and not narrow for found, _, narrow in map(model.predict, unseen)]
    assert sum(right) >= 0.97 * len(right)


def test_held_out_accuracy(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("held", held_out_fold(F.col("doc_id")))
    model = learn_languages(docs.where("NOT held"))
    found = identify_languages(docs.where("held"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)
    assert sum(r["rejected"] for r in found) <= 0.02 * len(found)
