"""Streams of documents and signals.

Each micro-batch is an ordinary table: documents are chunked or tokenised as they come, signals replace those of the same
id in a state table that is written anew under a version, so a batch that runs again gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators import evolve as V
from spanloom.plans.evolution import route_batch


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", kind: str = "parquet") -> DataFrame:
    """Documents of files as they arrive in a folder."""
    return spark.readStream.schema(schema).format(kind).load(folder)


def run_available(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Works on all that has arrived, batch by batch, and ends."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Versions:
    """A table under a folder, a version per batch."""

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root, schema

    def _path(self, batch: int) -> str:
        return f"{self.root}/version={batch}"

    def current(self, before: int | None = None) -> DataFrame:
        """The newest version (before a batch)."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = files.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in store.listStatus(files)] if store.exists(files) else []
        versions = sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))
        versions = [v for v in versions if before is None or v < before]
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._path(versions[-1]))

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.select(*[f.name for f in self.current(batch).schema]).write.mode("overwrite").parquet(self._path(batch))


class SignalState(Versions):
    """The latest row of each signal, and the support of buckets."""

    def upsert(self, news: DataFrame, batch: int) -> None:
        """Of several rows of one signal in a batch the last by created_at wins."""
        last = V.latest(news, "signal_id", F.struct("created_at", F.xxhash64(*news.columns)))
        self.put(V.upserted(self.current(batch), last.select(*[f.name for f in self.current(batch).schema]), "signal_id"), batch)

    def support(self) -> DataFrame:
        return V.support(self.current())


class Router:
    """Signals (signal_id, doc_ref, source_embedding_text, reason_embedding_text, created_at) routed batch by batch.

    A batch is embedded and routed against the two indexes as they were before it; signals of one batch don't see each
    other. Its mappings and vectors then replace those of the same signals."""

    VECTORS = "signal_id string, bucket_id string, source_vector array<double>, reason_vector array<double>"
    MAPPINGS = "signal_id string, bucket_id string, doc_ref string, created boolean, score double, route_reason string, assigned_at long"

    def __init__(self, spark: SparkSession, root: str, config: V.RouteConfig | None = None, dim: int = 256) -> None:
        self.vectors, self.mappings = Versions(spark, f"{root}/vectors", self.VECTORS), Versions(spark, f"{root}/mappings", self.MAPPINGS)
        self.config, self.dim = config or V.RouteConfig(), dim

    def route(self, news: DataFrame, batch: int) -> None:
        last = V.latest(news, "signal_id", F.struct("created_at", F.xxhash64(*news.columns)))
        zero = F.array_repeat(F.lit(0.0), self.dim)
        for side in ("source", "reason"):
            own = V.dense(V.hash_embedding(last, "signal_id", f"{side}_embedding_text", self.dim), "signal_id", self.dim)
            last = last.join(own.withColumnRenamed("vector", f"{side}_vector"), "signal_id", "left").withColumn(f"{side}_vector", F.coalesce(f"{side}_vector", zero))
        before = self.vectors.current(batch).join(last.select("signal_id"), "signal_id", "left_anti")
        index = lambda side: before.select("signal_id", "bucket_id", F.col(f"{side}_vector").alias("vector"))
        routed = route_batch(last, index("source"), index("reason"), self.config).withColumnRenamed("query_id", "signal_id")
        rows = last.join(routed, "signal_id").withColumn("assigned_at", F.col("created_at"))
        self.mappings.put(V.upserted(self.mappings.current(batch), rows.select(*[f.split()[0] for f in self.MAPPINGS.split(", ")]), "signal_id"), batch)
        self.vectors.put(before.unionByName(rows.select("signal_id", "bucket_id", "source_vector", "reason_vector")), batch)

    def buckets(self) -> DataFrame:
        now = self.mappings.current()
        return V.bucket_states(now, now)
