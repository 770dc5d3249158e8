"""Document fingerprints: every shingle hash below a fixed fraction, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callstream.llm.common import documents, staged

WORDS = 5
#: One in so many hashes stays: those from 0 to 2**64 / SCALE.
SCALE = 4
#: Texts with at most so many distinct shingles keep all of them.
WHOLE = 128


def _below(hash_: Column) -> Column:
    return (hash_ >= 0) & (hash_ < F.lit((1 << 64) // SCALE))


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS) -> DataFrame:
    """Add the sketch of a text column: struct of ``scale`` and sorted ``hashes``.

    A shingle is ``words`` words in a row (parted by space, tab, LF, VT, FF, CR), a shorter text
    is one shingle, and a null text or one without words has none. Of the distinct shingle
    hashes those below 1/SCALE of all values stay; a text with at most WHOLE of them keeps all
    and has scale 1. Equal texts have equal sketches. Nothing is drawn at random, so sketches of
    parts can be merged (``merged``) and those of very unequal texts compared.

    Each step is a projection of its own: a lambda would compute what it reads from outside
    again for every element.
    """
    split = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    hashed = F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn("__words", hashed)
    n = F.size("__words")
    rows = F.transform(
        F.sequence(F.lit(0), n - words),
        lambda i: F.xxhash64(*[F.get("__words", i + j) for j in range(words)]),
    )
    short = F.when(n > 0, F.array(F.xxhash64("__words"))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__shingles", F.array_distinct(F.when(n >= words, rows).otherwise(short)))
    whole = F.size("__shingles") <= WHOLE
    kept = F.when(whole, F.col("__shingles")).otherwise(F.filter("__shingles", _below))
    sketch = F.struct(
        F.when(whole, 1).otherwise(SCALE).alias("scale"), F.sort_array(kept).alias("hashes")
    )
    return df.withColumn(out, sketch).drop("__words", "__shingles")


def _at_scale(sketch: Column, scale: Column) -> Column:
    return F.when(sketch["scale"] >= scale, sketch["hashes"]).otherwise(
        F.filter(sketch["hashes"], _below)
    )


def merged(a: Column, b: Column) -> Column:
    """Sketch of the union of two shingle sets."""
    scale = F.greatest(a["scale"], b["scale"])
    hashes = F.array_union(_at_scale(a, scale), _at_scale(b, scale))
    return F.struct(scale.alias("scale"), F.sort_array(hashes).alias("hashes"))


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; of two sketches without hashes, whether they are equal."""
    scale = F.greatest(a["scale"], b["scale"])
    left, right = _at_scale(a, scale), _at_scale(b, scale)
    both = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - both
    return F.when(either > 0, both / either).otherwise((a == b).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds; null without any to compare."""
    scale = F.greatest(a["scale"], b["scale"])
    left, right = _at_scale(a, scale), _at_scale(b, scale)
    return F.when(F.size(left) > 0, F.size(F.array_intersect(left, right)) / F.size(left))


def fingerprint(sketch: Column) -> Column:
    """The sketch as text: the scale and 16 hexadecimal digits per hash."""
    digits = F.transform(sketch["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 16, "0"))
    return F.concat_ws(":", sketch["scale"].cast("string"), F.array_join(digits, ""))


def with_previous(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, previous_id, previous_chars) by ascending id; before the first comes the last.

    The ids are range-partitioned; across the borders of partitions a table of one row per
    partition is used. Rows with a null id are left out; ids are expected to be unique, or with
    ``key``, a column that orders rows of one id, pairs of both; ``previous_key`` is added then.
    """
    chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars")
    names = ["doc_id", *([key] if key else [])]
    ranged = staged(
        docs.where("doc_id IS NOT NULL")
        .select(*names, chars)
        .repartitionByRange(*names)
        .withColumn("part", F.spark_partition_id()),
        "ranged-ids",
    )
    here = F.struct(*names, "chars")
    ends = ranged.groupBy("part").agg(F.max(here).alias("end"))
    order = Window.orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    border = F.coalesce(F.lag("end").over(order), F.last("end").over(everything))
    borders = staged(ends.select("part", border.alias("border")), "range-borders")
    inside = F.lag(here).over(Window.partitionBy("part").orderBy(*names))
    return (
        ranged.withColumn("inside", inside)
        .join(F.broadcast(borders), "part")
        .withColumn("previous", F.coalesce("inside", "border"))
        .select(
            *names,
            F.col("previous.doc_id").alias("previous_id"),
            *([F.col(f"previous.{key}").alias("previous_key")] if key else []),
            F.col("previous.chars").alias("previous_chars"),
        )
    )


def _described(rows: DataFrame, *kept: str) -> DataFrame:
    """Results of rows with ``text``, ``start`` (of the next text) and ``next_sketch``."""
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    left = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), left), "start"))
    rows = with_sketch(with_sketch(rows, "text", "own"), "edited", "changed")
    own, changed = F.col("own"), F.col("changed")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(changed).alias("edited_fingerprint"),
        similarity(own, changed).alias("near_edited"),
        similarity(own, F.col("next_sketch")).alias("near_next"),
        *kept,
    )


def _without_next(docs: DataFrame) -> DataFrame:
    """Results of rows that have no next one: null but for the row's own."""
    rows = with_sketch(docs, "text", "own")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.lit(None).cast("string").alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        F.lit(None).cast("string").alias("edited_fingerprint"),
        F.lit(None).cast("double").alias("near_edited"),
        F.lit(None).cast("double").alias("near_next"),
    )


def describe_beside_next(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, and what becomes of both when it is edited.

    The edited text is the text with its last quarter replaced by the start of the next one, by
    ascending id; the last row's next is the first. Rows that repeat an id are in the order of
    the hashes of their texts; of rows that repeat the text too, all but the last are followed
    by a copy of themselves. Rows with a null id have no place in the order: their columns of
    the edit and of the next text are null. A null text counts as empty.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = docs.where("doc_id IS NOT NULL")
    nameless = _without_next(docs.where("doc_id IS NULL"))
    repeated = placed.groupBy("doc_id").count().where("count > 1").limit(1).count()
    copies = None
    names = ["doc_id"]
    if repeated:
        names.append("key")
        placed = placed.withColumn("key", F.xxhash64("text"))
        many = staged(placed.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1"), "repeated")
        single = placed.join(many, names, "left_anti")
        whole = placed.join(many, names).dropDuplicates(names)
        copied = whole.withColumn(
            "start", F.substring("text", F.lit(1), F.floor(F.char_length("text") / 4).cast("int"))
        )
        copied = _described(with_sketch(copied, "text", "next_sketch"), "n")
        copies = copied.withColumn("n", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).drop("n")
        placed = single.unionByName(whole.drop("n"))
    order = staged(with_previous(placed, *names[1:]), "previous-ids")
    # Each document sends its own sketch and the start of its text to the one before it.
    sent = with_sketch(placed.join(order, names), "text", "next_sketch").select(
        F.col("previous_id").alias("doc_id"),
        *[F.col("previous_key").alias(name) for name in names[1:]],
        F.substring("text", F.lit(1), F.floor(F.col("previous_chars") / 4).cast("int")).alias("start"),
        "next_sketch",
    )
    found = _described(placed.join(sent, names)).unionByName(nameless)
    return found.unionByName(copies) if copies is not None else found


def op4_scaled_sketch(spark, sf_dir):
    """Every row of ``documents`` gives one row, also with a null or a repeated ``doc_id``."""
    return describe_beside_next(documents(spark, sf_dir))
