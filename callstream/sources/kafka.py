"""Kafka topics. Needs the public ``spark-sql-kafka-0-10`` package on the classpath."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def kafka_options(
    servers: str,
    topic: str,
    starting: str = "earliest",
    max_offsets: int | None = 10_000,
    min_partitions: int | None = None,
    streaming: bool = True,
    ending: str | None = None,
    pattern: bool = False,
    group_prefix: str | None = None,
    **options: str,
) -> dict[str, str]:
    """Options of the Kafka source.

    ``pattern`` takes ``topic`` as a pattern of names; ``ending`` ends a batch read there;
    ``group_prefix`` names the consumer group. ``options`` are passed on as they are:
    ``failOnDataLoss``, or security settings such as ``kafka.security.protocol``.

    ``max_offsets`` limits what one micro-batch admits. ``min_partitions`` splits
    long topic partitions by offset range, so that a topic with few partitions, or
    one hot partition, is still read by many tasks.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribePattern" if pattern else "subscribe": topic,
        "startingOffsets": starting,
        **options,
    }
    if not streaming and ending is not None:
        options["endingOffsets"] = ending
    if group_prefix is not None:
        options["groupIdPrefix"] = group_prefix
    if streaming and max_offsets is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def offsets_per_trigger(per_partition_per_second: int, partitions: int, batch_seconds: int) -> int:
    """A rate limit per topic partition and second as a limit per micro-batch."""
    return per_partition_per_second * partitions * batch_seconds


def kafka_messages(
    spark: SparkSession, servers: str, topic: str, streaming: bool = True, **limits
) -> DataFrame:
    """A topic as messages: ``value`` with ``partition``, ``offset`` and ``timestamp``."""
    reader = spark.readStream if streaming else spark.read
    options = kafka_options(servers, topic, streaming=streaming, **limits)
    rows = reader.format("kafka").options(**options).load()
    return rows.select("value", "partition", "offset", "timestamp")
