"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callstream.llm.common import ROW, documents, ship, staged, unpacked, whole_row

#: Sources whose rates are broadcast (about 1 kB each); more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
ADDED = ("copy", "mix_key")


def hashed_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of the joined parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *_texts(parts))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def hashed_key(*parts: Column | str) -> Column:
    """A whole number of 60 bits from the md5 of the joined parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *_texts(parts))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def _texts(parts: tuple[Column | str, ...]) -> list[Column]:
    return [
        F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null"))
        for p in parts
    ]


def poisson_steps(rate: float) -> tuple[int, list[float]]:
    """First count and the distribution function from there on, up to 1.

    Counts that 52-bit numbers cannot reach are left out, so the list is about
    ``24 * sqrt(rate)`` long and the inversion is exact.
    """
    if not rate > 0:
        return 0, [1.0]
    width = 12 * math.sqrt(rate) + 40
    first = max(0, math.floor(rate - width))
    last = math.ceil(rate + width)
    logs = [k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(first, last + 1)]
    steps = np.cumsum(np.exp(logs))
    end = int(np.searchsorted(steps, 1 - 2.0**-53)) if steps[-1] >= 1 - 2.0**-53 else len(steps) - 1
    return first, [*steps[:end].tolist(), 1.0]


def _with_steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        steps = [poisson_steps(rate) for rate in frame["rate"]]
        yield frame.assign(first=[s[0] for s in steps], steps=[s[1] for s in steps])


def source_rates(
    docs: DataFrame,
    weights: DataFrame | None = None,
    temperature: float = 0.5,
    repetition: float = 1.0,
) -> DataFrame:
    """Mean number of copies of a document per source: (source, size, rate).

    ``weights`` (source, weight) gives target shares of the bytes of text; a source that it
    lacks gets none. Without it a source of b bytes weighs ``b ** temperature``. The copies
    have ``repetition`` times the bytes of the input. A null source is a source of its own;
    a source without any text gets the rate ``repetition``.
    """
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    sizes = staged(docs.groupBy("source").agg(size.alias("size")), "source-sizes")
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), temperature))
    else:
        given = weights.groupBy(F.col("source").alias("named")).agg(F.sum("weight").alias("weight"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("named")), "left").select(
            "source", "size", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")
        )
    sized = F.col("size") > 0
    total, weight = weighed.agg(F.sum("size"), F.sum(F.when(sized, F.col("weight")))).first()
    rate = F.col("weight") / F.lit(weight or 1.0) * F.lit(repetition * (total or 0)) / F.col("size")
    return weighed.select("source", "size", F.when(sized, rate).otherwise(repetition).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    temperature: float = 0.5,
    repetition: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """Copies of the documents in random order, sources in their target proportions.

    Each document draws a number in [0, 1) from ``md5(seed:doc_id)`` and inverts with it the
    Poisson distribution whose mean is its source's rate (``source_rates``); a document is
    repeated that often, so a rate below one leaves documents out. Returns the input columns,
    ``copy`` (from 1) and ``mix_key``; the rows lie in order of ``mix_key`` over all partitions.

    The draw depends on seed and ``doc_id`` alone: a task that runs again repeats it. Repeated
    rows of one ``doc_id`` get as many copies each; a null ``doc_id`` counts as one id. Null or
    empty texts are copied like others. An empty table gives an empty table. Input columns
    named like the two added ones are replaced.
    """
    ship(docs.sparkSession)
    rates = source_rates(docs, weights, temperature, repetition)
    kind = docs.schema["source"].dataType.simpleString()
    stepped = rates.select(F.col("source").alias("__source"), "rate").mapInPandas(
        _with_steps, f"__source {kind}, rate double, first long, steps array<double>"
    )
    rates = staged(stepped.drop("rate"), "source-rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rows = docs.select(
        whole_row(docs),
        F.col("source").alias("__from"),
        F.col("doc_id").alias("__id"),
        hashed_unit(str(seed), F.col("doc_id")).alias("__u"),
    )
    copies = F.col("first") + F.size(F.filter("steps", lambda step: step <= F.col("__u")))
    copied = (
        rows.join(rates, F.col("__from").eqNullSafe(F.col("__source")))
        .withColumn("__n", copies)
        .where("__n > 0")
        .select(ROW, "__id", F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("copy"))
        .withColumn("mix_key", hashed_key(str(seed), "order", F.col("__id"), F.col("copy")))
    )
    ordered = copied.repartitionByRange("mix_key").sortWithinPartitions("mix_key", "__id", "copy")
    return ordered.select(*unpacked(docs.columns, ADDED), *ADDED)


def op10_poisson_mix(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir))


OP10_SQL = """
WITH sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0)) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN size > 0
    THEN pow(size::DOUBLE, 0.5) / (sum(CASE WHEN size > 0 THEN pow(size::DOUBLE, 0.5) END) OVER ())
      * (sum(size) OVER ())::DOUBLE / size
    ELSE 1.0 END AS rate
  FROM sizes
), counts AS (
  SELECT source, rate, unnest(range(0, floor(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k
  FROM rates
), pmf AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p FROM counts
), cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf
), drawn AS (
  SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
    / 4503599627370496.0::DOUBLE AS u
  FROM documents
), counted AS (
  SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang,
    any_value(d.source) AS source, any_value(d.n_chars) AS n_chars,
    count(*) FILTER (WHERE c.c <= d.u) AS n
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
  GROUP BY d.doc_id
), copied AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1)) AS copy FROM counted
)
SELECT *, ('0x' || substr(md5('17:order:' || coalesce(doc_id::VARCHAR, 'null') || ':'
  || copy::VARCHAR), 1, 15))::BIGINT AS mix_key
FROM copied
"""
