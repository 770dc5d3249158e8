from __future__ import annotations

import random

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from callstream.llm.common import documents, staged  # noqa: E402
from callstream.llm.language import held_out_fold, identify_languages, learn_languages  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_jaccard import brute as similar  # noqa: E402
from test_lines import brute as without_lines  # noqa: E402
from test_mixing import brute as mixed  # noqa: E402
from test_packing import placed  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted([tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()], key=repr)


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept, by other means."""
    docs = documents(spark, SF_DIR)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard", "source_mixing", "best_fit_packing"]

    kept = staged(stages["language_id"](spark, docs, SF_DIR), "test")
    assert kept.columns == docs.columns
    model = learn_languages(docs.where(~held_out_fold(F.col("doc_id"))))
    expected = identify_languages(docs, model).where("NOT rejected")
    assert as_rows(kept) == as_rows(expected.withColumn("lang", F.col("lang_pred")))
    assert kept.count() >= 0.97 * docs.count()

    before = as_rows(kept)
    kept = staged(stages["line_dedup"](spark, kept, SF_DIR), "test")
    texts = {doc: text for doc, text, _, _ in without_lines([r[:2] for r in before])}
    after = as_rows(kept)
    assert {r[0]: r[1] for r in after} == texts
    assert all(r[4] == len(r[1]) for r in after)
    assert [(r[0], r[2], r[3]) for r in after] == [(r[0], r[2], r[3]) for r in before]

    classes = {doc: class_id for doc, class_id, _, _ in similar([r[:2] for r in after])}
    kept = staged(stages["ngram_jaccard"](spark, kept, SF_DIR), "test")
    before, after = after, as_rows(kept)
    assert after == [r for r in before if classes[r[0]] == r[0]]

    kept = staged(stages["source_mixing"](spark, kept, SF_DIR), "test")
    counts = mixed([r[:4] for r in after])
    assert as_rows(kept) == sorted([r for r in after for _ in range(counts[r[0]])], key=repr)

    packed = stages["best_fit_packing"](spark, kept, SF_DIR).collect()
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert set(lengths) == {d for d, n in counts.items() if n}
    total = sum(r["length"] for r in packed)
    assert placed(packed, 4096) <= total / 4096 * 1.02 + 2


def test_run_is_the_chain_of_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 50


def test_odd_tables(spark, make_docs):
    rng = random.Random(1)
    rows = [(i % 9, " ".join(rng.choices("abcdefg", k=40))) for i in range(12)]
    rows += [(None, "a b c"), (None, None), (20, None), (21, ""), (22, "word " * 50_000), (20, None)]
    for docs in (make_docs(rows), make_docs([]), make_docs([(1, None, None, None)])):
        docs = docs.withColumn("n_lines", F.lit(1)).withColumn("copy", F.lit("x")).withColumn("__extra", F.lit(2))
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF_DIR), name)
        placed(docs.collect(), 4096)
