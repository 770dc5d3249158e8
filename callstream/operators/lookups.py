"""The static code table and the join that adds its descriptions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callstream.operators.distinct import task_salt
from callstream.schemas import DESCRIPTION, DISPOSITION

# The disposition codes of the call records and what they mean.
DISPOSITION_CODES = [
    ("ABA", "Abated"),
    ("ADM", "Admonished"),
    ("ADV", "Advised"),
    ("ARR", "Arrest"),
    ("CAN", "Cancel"),
    ("CSA", "CPSA assignment"),
    ("22", "Cancel"),
    ("CIT", "Cited"),
    ("CRM", "Criminal Activation"),
    ("GOA", "Gone on Arrival"),
    ("HAN", "Handled"),
    ("NCR", "Non-Criminal"),
    ("ND", "No Disposition"),
    ("NOM", "No Merit"),
    ("PAS", "Premises Appears Secure"),
    ("REP", "Report"),
    ("SFD", "SFFD Medical Staff Engaged"),
    ("UTL", "Unable to Locate"),
    ("VAS", "Vehicle Appears Secure"),
]

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
# Copies of a code table that is too large to broadcast, unless the caller asks for more.
JOIN_SALTS = 16


@dataclass(frozen=True)
class CodeTableSize:
    """Measured size of a code table."""

    rows: int
    bytes: int

    def fits_broadcast(self, max_rows: int, max_bytes: int) -> bool:
        return self.rows <= max_rows and self.bytes <= max_bytes


def default_codes(spark: SparkSession) -> DataFrame:
    """The fixed code table."""
    return spark.createDataFrame(
        DISPOSITION_CODES, f"{DISPOSITION} string, {DESCRIPTION} string"
    )


def code_table_size(codes: DataFrame) -> CodeTableSize:
    """Rows and text bytes; runs one small job."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c in (DISPOSITION, DESCRIPTION)]
    size = F.coalesce(F.sum((text[0] + text[1]).cast("long")), F.lit(0))
    return CodeTableSize(*codes.agg(F.count(F.lit(1)), size).first())


def with_description(
    calls: DataFrame,
    codes: DataFrame,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    size: CodeTableSize | None = None,
    salts: int = JOIN_SALTS,
) -> DataFrame:
    """Inner join on the disposition code; calls with no or an unknown code drop out.

    A code table measured within the bounds is broadcast. A larger one is joined
    by a salted shuffle, so that a code held by a third of all calls is split over
    up to ``salts`` tasks (as many as the scan has, if that is less). Choose them so
    that the hottest code divided by them fits a task; the code table is copied as
    often. ``size`` spares the job that measures the table.
    """
    size = size or code_table_size(codes)
    if size.fits_broadcast(max_rows, max_bytes):
        return calls.join(F.broadcast(codes), DISPOSITION)
    salted_calls = calls.where(F.col(DISPOSITION).isNotNull()).withColumn(
        "_salt", task_salt(salts)
    )
    all_salts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted_codes = codes.withColumn("_salt", all_salts).hint("merge")
    return salted_calls.join(salted_codes, [DISPOSITION, "_salt"]).drop("_salt")
