"""Results of queries as tables whose readers see one whole version.

Rows lie in folders that never change. A version is a small file, made in one step, that names the
folders of the table; readers take the newest one or stay with one they have chosen. Three kinds
of change make a version: a new result, more rows, and rows that replace others by key. The last two
add a layer; ``FAN`` layers of a level are merged into one of the next level, so a row is written
once per level, however large the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callstream.workspace import drop_folder, hadoop_path

#: Layers of one level that are merged into one.
FAN = 8
#: A version that is not the newest stays at least so long for those who read it.
RETAIN_SECONDS = 600
_LAYER = "_layer"


@dataclass(frozen=True)
class Version:
    """What a table holds: its layers, oldest first, as (folder, level)."""

    number: int = -1
    layers: list[tuple[str, int]] = field(default_factory=list)
    keys: list[str] | None = None
    #: The last micro-batch of each query that is in the table.
    done: dict[str, int] = field(default_factory=dict)


def _versions(spark: SparkSession, path: str) -> dict[int, int]:
    """Number of each version and when it was made, in milliseconds."""
    files, folder = hadoop_path(spark, f"{path}/_versions")
    if not files.exists(folder):
        return {}
    found = [(s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(folder)]
    return {int(name[:-5]): at for name, at in found if name.endswith(".json")}


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version of the table, the newest by default; one without layers if there is none."""
    known = _versions(spark, path)
    if number is None:
        number = max(known, default=None)
        if number is None:
            return Version()
    elif number not in known:
        raise ValueError(f"{path} has no version {number} any more")
    files, file = hadoop_path(spark, f"{path}/_versions/{number:020d}.json")
    stream = files.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    said = json.loads(text)
    return Version(number, [tuple(layer) for layer in said["layers"]], said["keys"], said["done"])


def _publish(spark: SparkSession, path: str, new: Version) -> None:
    """Make ``new`` a version in one step; an error if another writer has made that number."""
    files, draft = hadoop_path(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    said = {"layers": new.layers, "keys": new.keys, "done": new.done}
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps(said).encode()))
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark._jsparkSession.sessionState().newHadoopConf()
    )
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never_replace = spark.sparkContext._gateway.new_array(rename, 1)
    never_replace[0] = rename.NONE
    _, name = hadoop_path(spark, f"{path}/_versions/{new.number:020d}.json")
    context.rename(files.makeQualified(draft), files.makeQualified(name), never_replace)


def _forget(spark: SparkSession, path: str) -> None:
    """Drop versions that newer ones replaced ``RETAIN_SECONDS`` ago, and their folders."""
    made = _versions(spark, path)
    numbers = sorted(made)
    newest = made[numbers[-1]]
    # A version is current until the next one is made.
    gone = [n for n, after in zip(numbers, numbers[1:]) if newest - made[after] > 1000 * RETAIN_SECONDS]
    if not gone:
        return
    kept = {folder for folder, _ in version(spark, path, numbers[len(gone)]).layers}
    for number in gone:
        for folder, _ in version(spark, path, number).layers:
            if folder not in kept:  # a folder that left the table never returns
                drop_folder(spark, f"{path}/{folder}")
    for number in gone:
        drop_folder(spark, f"{path}/_versions/{number:020d}.json")


def _writer(spark: SparkSession) -> str | None:
    """The id of the streaming query that runs this micro-batch."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def _written(rows: DataFrame, path: str, order: int) -> str:
    """The rows in a folder of their own. Names sort as the layers do."""
    folder = f"data/{order:020d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    return folder


def _new_rows(rows: DataFrame, path: str, known: Version, batch_id: int) -> str | None:
    """The rows in a folder, or None if the table has this micro-batch. It is run in any case:
    a query with state must see each of its micro-batches run."""
    folder = _written(rows, path, known.number + 1)
    if known.done.get(_writer(rows.sparkSession) or "", -1) < batch_id:
        return folder
    drop_folder(rows.sparkSession, f"{path}/{folder}")
    return None


def _after(spark: SparkSession, known: Version, batch_id: int, **changed) -> Version:
    writer = _writer(spark)
    done = known.done | ({writer: batch_id} if writer else {})
    return replace(known, number=known.number + 1, done=done, **changed)


def write_latest(result: DataFrame, path: str, batch_id: int) -> None:
    """Make ``result`` the table. A micro-batch that is repeated changes nothing.

    One writer at a time: a second one fails.
    """
    spark = result.sparkSession
    known = version(spark, path)
    folder = _new_rows(result, path, known, batch_id)
    if folder is None:
        return
    _publish(spark, path, _after(spark, known, batch_id, layers=[(folder, 0)], keys=None))
    _forget(spark, path)


def append_rows(rows: DataFrame, path: str, batch_id: int) -> str | None:
    """Add ``rows`` to the table, once per micro-batch; the folder written, or None if the
    micro-batch had been added before."""
    return _add_layer(rows, path, batch_id, None)


def merge_latest(rows: DataFrame, path: str, batch_id: int, keys: list[str]) -> None:
    """Put ``rows`` in place of those with equal ``keys``. Only they are written; readers and
    merges of layers take the newest row of a key."""
    _add_layer(rows, path, batch_id, keys)


def _add_layer(rows: DataFrame, path: str, batch_id: int, keys: list[str] | None) -> str | None:
    spark, schema = rows.sparkSession, rows.schema
    known = version(spark, path)
    folder = _new_rows(rows, path, known, batch_id)
    if folder is None:
        return None
    _publish(spark, path, _after(spark, known, batch_id, layers=[*known.layers, (folder, 0)], keys=keys))
    for new in _folds(spark, path, schema):
        _publish(spark, path, new)
    _forget(spark, path)
    return folder


def _folds(spark: SparkSession, path: str, schema: StructType) -> Iterator[Version]:
    """Versions with the same rows in fewer layers, as long as a level is full."""
    while True:
        known = version(spark, path)
        last = known.layers[-FAN:]
        if len(last) < FAN or len({level for _, level in last}) > 1:
            return
        folders = [folder for folder, _ in last]
        order = int(folders[-1].split("/")[1].split("-")[0])
        folder = _written(_rows(spark, path, schema, folders, known.keys), path, order)
        layers = [*known.layers[:-FAN], (folder, last[0][1] + 1)]
        yield replace(known, number=known.number + 1, layers=layers)


def _rows(
    spark: SparkSession, path: str, schema: StructType, folders: list[str], keys: list[str] | None
) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(*[f"{path}/{folder}" for folder in folders])
    if not keys or len(folders) == 1:
        return found
    name = F.regexp_extract("_metadata.file_path", "/data/([0-9]+)-[^/]*/[^/]*$", 1).alias(_LAYER)
    others = [F.col(f"`{c}`") for c in schema.names if c not in keys]
    value = F.struct(*others, F.lit(0).alias(_LAYER)).alias("_value")
    newest = found.select(*keys, value, name).groupBy(*keys)
    newest = newest.agg(F.max_by("_value", _LAYER).alias("_value"))
    return newest.select(*[c if c in keys else F.col(f"_value.`{c}`").alias(c) for c in schema.names])


def read_latest(
    spark: SparkSession, path: str, schema: StructType, number: int | None = None
) -> DataFrame:
    """The table as of a version, the newest by default. Empty if there is none.

    What the version names is read, whatever is written meanwhile, for ``RETAIN_SECONDS``
    after it has been replaced.
    """
    known = version(spark, path, number)
    return _rows(spark, path, schema, [folder for folder, _ in known.layers], known.keys)
