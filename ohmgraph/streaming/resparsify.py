"""A stream of edges kept small: above the threshold, everything held is sparsified again.

Each micro-batch writes a version of the held edges under its batch id; a repeated batch starts from the version
before its own and overwrites it, so retries don't count edges twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.components import materialize
from ..params import Params
from ..plans.sparsify import ready, sparsify

EDGES = "u long, v long, w double"


class EdgeStream:
    """State folder of a stream; params.reweight "inverse" keeps repeated sampling unbiased."""

    def __init__(self, spark: SparkSession, folder: str, n: int, params: Params, threshold: int | None = None):
        self.spark, self.folder, self.n, self.params = spark, folder.rstrip("/"), n, params
        self.threshold = params.threshold(n) if threshold is None else threshold

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().partition("=")[2]) for p in done)

    def version(self, number: int) -> DataFrame:
        return self.spark.read.schema(EDGES).parquet(f"{self.folder}/batch={number}")

    def current(self, before: int | None = None) -> DataFrame:
        """The held edges, after the last batch or the last one before `before`."""
        have = [v for v in self._versions() if before is None or v < before]
        return self.version(have[-1]) if have else self.spark.createDataFrame([], EDGES)

    def absorb(self, batch: DataFrame, number: int) -> None:
        held = materialize(ready(self.current(number).unionByName(batch.selectExpr("cast(u as long) u", "cast(v as long) v", "cast(w as double) w")), self.params))
        if held.count() > self.threshold:
            held = sparsify(held, self.n, self.params.with_(sampling_seed=self.params.sampling_seed + number)).edges
        held.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def start(self, edges: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """edges: a streaming DataFrame (u, v, w)."""
        return edges.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def finish(self) -> DataFrame:
        """The final sparsification of what is held."""
        return sparsify(self.current(), self.n, self.params).edges
