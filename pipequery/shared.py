"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in a local session and one under the warehouse on a cluster."""
    if known := spark.conf.get("spark.checkpoint.dir", None):
        return known.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return "file://" + tempfile.mkdtemp(prefix="pipequery-")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pipequery"
