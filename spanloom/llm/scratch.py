"""Written tables in the folder that all executors share.

Iterative operators cut their lineage here: a written table survives the loss of any executor, is columnar and
compressed, and can be dropped as soon as the next step has been written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanloom.sources.shared import shared_folder


def unused(columns: list[str], name: str) -> str:
    """The name, with as many underscores as it takes to be none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch at most. Rows here hold whole texts; a batch is in memory several times on its way.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS if they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Scratch:
    """Tables of one operator run, each under its own name."""

    def __init__(self, spark: SparkSession, owner: str) -> None:
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark)}/{owner}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, frame: DataFrame, name: str) -> DataFrame:
        """Write the frame and return a reader of what was written."""
        frame.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
