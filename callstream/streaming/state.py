"""What a checkpoint holds: its state as a table, and how far it has read.

The number of state partitions is fixed for the life of a checkpoint. To change it, stop the
query, write its state as a table (``write_state``), and start a new query, with a new checkpoint
and the wanted ``spark.sql.shuffle.partitions``, from that table and from where the old one
stopped (``committed_offsets`` of a topic, ``files_read`` of a folder).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callstream.workspace import hadoop_path

_LOGGED = "path string, batchId long"


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The operators with state of a query: ``operatorId``, ``operatorName``, ``stateStoreName``,
    ``numPartitions``, ``minBatchId``, ``maxBatchId``."""
    found = spark.read.format("state-metadata").load(checkpoint)
    return found.drop("operatorProperties")


def read_state(
    spark: SparkSession, checkpoint: str, operator: int = 0, batch_id: int | None = None
) -> DataFrame:
    """The state of one operator after its last committed micro-batch, or after ``batch_id``:
    a column for each key and for each value, and the ``partition_id`` that holds the row.

    Each state partition is read by one task. The query may be running.
    """
    reader = spark.read.format("statestore").option("operatorId", operator)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint).select("key.*", "value.*", "partition_id")


def _last_commit(spark: SparkSession, checkpoint: str) -> int:
    files, folder = hadoop_path(spark, f"{checkpoint}/commits")
    names = [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []
    done = [int(name) for name in names if name.isdigit()]
    if not done:
        raise ValueError(f"no micro-batch of {checkpoint} is committed")
    return max(done)


def committed_offsets(spark: SparkSession, checkpoint: str) -> list[str]:
    """Up to where each source of a query has been read by committed micro-batches, as JSON.

    For a topic it is what ``kafka_messages`` takes as ``starting``.
    """
    log = spark.read.text(f"{checkpoint}/offsets/{_last_commit(spark, checkpoint)}", wholetext=True)
    # One line for the version, one for the settings, then one for each source.
    return log.first()["value"].strip().split("\n")[2:]


def one_spelling(path: Column) -> Column:
    """File paths are logged with ``file:///`` and named with ``file:/`` elsewhere."""
    return F.regexp_replace(path, "^([^:/]+):/+", "$1:/")


def files_read(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame:
    """``path`` of each file of a folder that committed micro-batches of a query have read."""
    offset = F.get_json_object(F.lit(committed_offsets(spark, checkpoint)[source]), "$.logOffset")
    lines = spark.read.text(f"{checkpoint}/sources/{source}")
    logged = lines.select(F.from_json("value", _LOGGED).alias("file")).select("file.*")
    logged = logged.where(F.col("path").isNotNull() & (F.col("batchId") <= offset.cast("long")))
    return logged.select(one_spelling(F.col("path")).alias("path")).distinct()


def write_state(
    spark: SparkSession, checkpoint: str, path: str, operator: int = 0, batch_id: int | None = None
) -> None:
    """Write the state of one operator as a parquet table; fails if ``path`` exists."""
    state = read_state(spark, checkpoint, operator, batch_id)
    state.drop("partition_id").write.parquet(path)
