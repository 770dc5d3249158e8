"""The corpus pipeline: from documents to packed training sequences.

Each stage takes all rows that the one before kept; its rows are written as Parquet in the shared
folder and read again as the next stage's documents. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callstream.llm import jaccard, language, lines, mixing, packing
from callstream.llm.common import documents, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: ``lang`` becomes the language found, rejected documents go.

    The languages are learned from the documents outside the held-out fold; without any labelled
    one there is nothing to reject by, and all documents stay as they are.
    """
    marked = docs.withColumn("__held", language.held_out_fold(F.col("doc_id")))
    model = language.learn_languages(marked.where("NOT __held").drop("__held"))
    if not model.samples:
        return docs.select(*COLUMNS)
    found = language.identify_languages(docs, model).where("NOT rejected")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: a line stays in the document with the least id, ``n_chars`` follows."""
    kept = lines.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document with the least id of each class stays.

    Rows of one id stay or go together, equal ones once; rows without an id stay.
    """
    found = jaccard.similar_documents(docs)
    kept = found.where("doc_id = class_id").select("doc_id").distinct()
    rows = docs.select(*COLUMNS).join(kept, "doc_id").dropDuplicates(["doc_id", "text"])
    return rows.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a document is repeated as its draw says."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the tokenised documents into sequences of at most 4096 tokens."""
    return packing.pack(packing.tokenized_pieces(docs).drop("ids"))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_similar),
    ("source_mixing", mix_to_weights),
    ("best_fit_packing", pack_sequences),
]

#: No stage but line dedup and mixing can be said in SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    for place, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if place < len(STAGES) - 1:
            rows = staged(rows, name)
    return rows
