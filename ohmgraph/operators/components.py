"""Connected components of a link table by alternating large-star and small-star steps.

Each step joins a node's links with the least neighbour found by a partial-sum aggregate, so no node's links are
gathered in one row; the number of rounds grows with the logarithm of the longest path. Each round's links are a
table in the shared checkpoint folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import arrays as A


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode (tests), an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="ohmgraph-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder; packed edges in small files, as a file is read at once."""
    path = f"{shared_dir(df.sparkSession)}/ohmgraph-{uuid.uuid4().hex}"
    packed = "u" in df.columns and isinstance(df.schema["u"].dataType, BinaryType)
    df.write.parquet(path) if not packed else df.write.option("maxRecordsPerFile", 64 if "bin" in df.columns else 2).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    # large: v > u hang on the least neighbour of u or u itself; small: links run from the greater to the lesser node
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node of the component of each of n nodes."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _at_once(links: DataFrame) -> DataFrame:
    found = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).toArrow()
    u, v = (found.column(c).to_numpy() for c in ("u", "v"))
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    label = nodes[labels(len(nodes), flat[: len(u)], flat[len(u) :])] if len(nodes) else nodes
    return links.sparkSession.createDataFrame(pa.table({"node": nodes.astype(np.int64), "component": label.astype(np.int64)}), "node long, component long")


def forest(links: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """(u, v): links with the components of links (u, v), each task's nodes hung on the least one that its links reach.

    A task holds a link a node, and sends no more than it holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.empty(0, dtype=np.int64)
        for t in A.chunks(batches, rows):
            ends = A.column(t, "u"), A.column(t, "v")
            if len(u):  # links between nodes that are known to hang together say nothing
                at = [np.minimum(np.searchsorted(u, x), len(u) - 1) for x in ends]
                hung = [np.where(u[i] == x, v[i], x) for i, x in zip(at, ends, strict=True)]
                new = hung[0] != hung[1]
                if not new.any():
                    continue
                ends = hung[0][new], hung[1][new]
            ends = np.concatenate((u, ends[0])), np.concatenate((v, ends[1]))
            nodes, flat = np.unique(np.concatenate(ends), return_inverse=True)
            label = labels(len(nodes), flat[: len(ends[0])], flat[len(ends[0]) :])
            u, v = nodes, nodes[label]
            u, v = u[u != v], v[u != v]
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    if isinstance(links.schema["u"].dataType, BinaryType):  # packed
        cast = links.select("u", "v")
    else:
        cast = links.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    tasks = 2 * links.sparkSession.sparkContext.defaultParallelism
    return cast.coalesce(tasks).mapInArrow(work, "u long, v long").distinct()


def components(links: DataFrame, max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """(node, component) for every node of links (u, v); component is the least node that can be reached.

    at_once: a table of at most so many links, counted first, is labelled on the driver in one go."""
    if at_once and links.limit(at_once + 1).count() <= at_once:
        return _at_once(links.where("u <> v"))
    now = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        now = materialize(_star(_star(now, True), False))
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
