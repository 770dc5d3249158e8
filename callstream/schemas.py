"""Column names and schemas shared by every module."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType, TimestampType

CRIME_ID = "crime_id"
CALL_TYPE = "original_crime_type_name"
DISPOSITION = "disposition"
DESCRIPTION = "disposition_description"
CALL_TIME = "call_date_time"

# Field names and types of a call record, in message order.
CALLS = StructType(
    [
        StructField(CRIME_ID, StringType()),
        StructField(CALL_TYPE, StringType()),
        StructField("report_date", TimestampType()),
        StructField("call_date", TimestampType()),
        StructField("offense_date", TimestampType()),
        StructField("call_time", StringType()),
        StructField(CALL_TIME, TimestampType()),
        StructField(DISPOSITION, StringType()),
        StructField("address", StringType()),
        StructField("city", StringType()),
        StructField("state", StringType()),
        StructField("agency_id", StringType()),
        StructField("address_type", StringType()),
        StructField("common_location", StringType()),
    ]
)

# Fields of the code table file. Codes stay strings ("22" is one).
CODES = StructType(
    [
        StructField("disposition_code", StringType()),
        StructField("description", StringType()),
    ]
)


def narrowed(fields: list[str] | None) -> StructType:
    """``CALLS`` restricted to ``fields``, in the given order."""
    return CALLS if fields is None else StructType([CALLS[name] for name in fields])
