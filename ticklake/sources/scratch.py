"""Tables of intermediate rows, as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only in local mode."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"on {master}, spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "ticklake-scratch")
    return at.rstrip("/")


def written(rows: DataFrame) -> tuple[DataFrame, str]:
    """rows, written and read back, and where they are."""
    spark = rows.sparkSession
    path = f"{folder(spark)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def once(rows: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build(rows) for a build that reads its rows several times, which would be worked out anew each time.

    The rows are written first and go in the end; the result, which should be small, is written as well.
    """
    table, path = written(rows)
    try:
        return written(build(table))[0]
    finally:
        jvm = rows.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(rows.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
