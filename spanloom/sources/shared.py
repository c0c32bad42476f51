"""Written tables in the folder that all executors share.

A table that several later steps read is written there once: it survives the loss of any executor and cuts the lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one is set if the session is local; a cluster
    without it is an error, as its executors share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
            current = context._jsc.sc().getCheckpointDir()
        folder = current.get()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """A reader of what was written. It stays until the shared folder is cleared, as readers may be used at any time."""
    path = new_path(frame.sparkSession, name)
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
