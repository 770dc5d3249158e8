"""Where checkpoints and intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

_FOLDERS: list[str] = []


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``.

    Where that is unset, below the warehouse folder, which all executors share as well.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/callstream/{label}-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    return folder


def hadoop_path(spark: SparkSession, path: str):
    """File system and path object of ``path``, whatever store it is in."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def drop_folder(spark: SparkSession, folder: str) -> None:
    files, path = hadoop_path(spark, folder)
    files.delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Drop all folders that ``scratch_dir`` has named in this process.

    For the caller to use once no result of theirs is read any more: results are read from
    them, and queries started without a checkpoint folder resume from them.
    """
    while _FOLDERS:
        drop_folder(spark, _FOLDERS.pop())
