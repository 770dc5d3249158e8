"""Fields and types that messages have, against those that are declared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callstream.functions.messages import parse_untyped
from callstream.schemas import CALLS

#: What a value of a declared type is written as in JSON; others are compared by their own name.
_WRITTEN = {"string": "STRING", "timestamp": "STRING", "timestamp_ntz": "STRING", "date": "STRING"}


def message_fields(messages: DataFrame) -> DataFrame:
    """``field``, ``type``, ``messages`` and ``nulls`` of every field found in JSON objects.

    The type is the least one that all values of the field have: ``VARIANT`` if they have none in
    common, ``VOID`` if all are null; nested fields are part of it. Messages that are no JSON
    object have no fields. Counts and types are combined before the shuffle, so there is one row per
    field and task to be sent. Of a stream: output mode complete or update.
    """
    value = messages.select(parse_untyped().alias("record"))
    spark = messages.sparkSession
    found = value.lateralJoin(spark.tvf.variant_explode(F.col("record").outer()))
    return (
        found.where(F.col("key").isNotNull())
        .groupBy(F.col("key").alias("field"))
        .agg(
            F.schema_of_variant_agg("value").alias("type"),
            F.count(F.lit(1)).alias("messages"),
            F.count_if(F.is_variant_null("value")).alias("nulls"),
        )
    )


def schema_drift(fields: DataFrame, declared: StructType = CALLS) -> DataFrame:
    """What of ``message_fields`` is not as ``declared``: ``field``, ``drift``, ``type``, ``messages``.

    ``drift`` is "undeclared" for a field that the schema lacks, "type" for values of another type
    than is declared, and "absent" for a declared field that no message has (no type, 0 messages).
    A field that is only ever null is as declared. Batch input only: a field is absent from the whole
    of the messages, not from a micro-batch; take the result of a stream of ``message_fields``.
    """
    spark = fields.sparkSession
    rows = []
    for field in declared:
        kind = field.dataType.simpleString()
        rows.append((field.name, _WRITTEN.get(kind, kind.upper())))
    known = spark.createDataFrame(rows, "declared_field string, declared_type string")
    both = fields.join(F.broadcast(known), F.col("field") == F.col("declared_field"), "left")
    fits = F.col("type").isin("VOID") | (F.col("type") == F.col("declared_type"))
    drift = F.when(F.col("declared_field").isNull(), "undeclared").when(~fits, "type")
    found = both.select("field", drift.alias("drift"), "type", "messages").where("drift IS NOT NULL")
    absent = known.join(fields, F.col("field") == F.col("declared_field"), "left_anti").select(
        F.col("declared_field").alias("field"),
        F.lit("absent").alias("drift"),
        F.lit(None).cast("string").alias("type"),
        F.lit(0).cast("long").alias("messages"),
    )
    return found.union(absent)
