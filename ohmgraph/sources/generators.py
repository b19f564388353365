"""Made graphs and vectors, from hashes of positions: the same numbers on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import graph as G


def random_matrix(spark: SparkSession, n_rows: int, n_cols: int, draws: int, seed: int, strict_lower: bool = False) -> DataFrame:
    """(row, col, value) of at most `draws` places with values in (-1, 1); places drawn twice count once."""
    at = lambda role, n: F.floor(H.coin(role, F.col("id"), seed=seed) * n).cast("long")
    out = spark.range(draws).select(at("gr", n_rows).alias("row"), at("gc", n_cols).alias("col"), H.uniform("gv", F.col("id"), seed=seed).alias("value"), "id")
    if strict_lower:
        out = out.where("row > col")
    return out.groupBy("row", "col").agg(F.min_by("value", "id").alias("value"))


def random_edges(spark: SparkSession, n: int, draws: int, seed: int) -> DataFrame:
    """Edges with weights in (0, 1)."""
    low = random_matrix(spark, n, n, draws, seed, strict_lower=True)
    return low.select(F.col("col").alias("u"), F.col("row").alias("v"), F.abs("value").alias("w"))


def random_incidence(spark: SparkSession, n: int, edges: int, seed: int) -> DataFrame:
    """(edge, node, value): two entries of opposite sign for each of `edges` columns; their ends differ."""
    a = F.floor(H.coin("ia", F.col("id"), seed=seed) * n).cast("long")
    b = (a + 1 + F.floor(H.coin("ib", F.col("id"), seed=seed) * (n - 1)).cast("long")) % n
    x = H.coin("iv", F.col("id"), seed=seed)
    entry = lambda node, y: F.struct(node.alias("node"), y.alias("value"))
    return spark.range(edges).select(F.col("id").alias("edge"), F.explode(F.array(entry(a, x), entry(b, -x))).alias("e")).select("edge", "e.*")


def random_vector(spark: SparkSession, n: int, seed: int, zero_sum: bool = False) -> DataFrame:
    """(node, x), x in (-1, 1); zero_sum takes off the mean."""
    out = spark.range(n).select(F.col("id").alias("node"), H.uniform("vx", F.col("id"), seed=seed).alias("x"))
    if not zero_sum:
        return out
    mean = out.agg(F.avg("x").alias("m")).first()["m"]  # one number
    return out.withColumn("x", F.col("x") - F.lit(mean))


def path_with_shortcuts(spark: SparkSession, n: int = 100, step: int = 10) -> DataFrame:
    """A path of n nodes, and from each step-th node an edge to the last one before the next step; weights 1."""
    path = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    cuts = spark.range(n // step).select((F.col("id") * step).alias("u"), (F.col("id") * step + step - 1).alias("v"))
    return G.coalesced(G.canonical(path.unionByName(cuts).withColumn("w", F.lit(1.0))))
