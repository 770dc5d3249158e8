"""What the operators share: staged tables, whole rows kept aside, words of a text."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import callstream
from callstream.workspace import scratch_dir

#: Space, tab, line feed, vertical tab, form feed, carriage return: what parts words.
BLANKS = b" \t\n\x0b\x0c\r"
#: Holds a whole input row while an operator works beside it, so no name can clash.
ROW = "__row"
_caches: dict[str, dict] = {}


def cache(module: str) -> dict:
    """What a Python worker keeps from task to task, until a task of another module begins."""
    return _caches.setdefault(module, {})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_callstream_shipped", False):
        return
    root = Path(callstream.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="callstream-code-")) / "callstream_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._callstream_shipped = True


def _begin_task(module: str) -> None:
    """Empty what other modules kept in this worker: workers outlive stages and operators."""
    others = [kept for name, kept in _caches.items() if name != module and kept]
    for kept in others:
        kept.clear()
    if others:
        _return_memory()


def _return_memory() -> None:
    """Give the system what the allocators hold free; an idle worker would keep it to its end."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def in_arrow(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers, which give their memory back."""
    module = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin_task(module)
        try:
            yield from function(batches)
        finally:
            _return_memory()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation of what came before.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias(ROW)


def unpacked(columns: Iterable[str], replaced: Iterable[str] = ()) -> list[Column]:
    """The columns of the kept row, without those that an operator's own replace."""
    gone = {name.lower() for name in replaced}
    return [F.col(f"{ROW}.`{c}`").alias(c) for c in columns if c.lower() not in gone]


def as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each text of an Arrow column, null for null, one after the other."""
    return (text.as_py() for text in column.cast(pa.binary()))
