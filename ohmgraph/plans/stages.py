"""The stages of one sparsification as files, to compare runs and implementations stage by stage.

In a folder: `laplacian.mtx`; `incidence.mtx` (edge by node, edges by ordinal); `sketch.csv` and `solution.csv` (a line
a node, without header); `edges.csv` (ordinal, u, v, w, distance, probability, coin, kept, by ordinal). Each is a
folder of text parts in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import leverage, sample, sketch, solver
from ..operators.components import materialize
from ..params import Params
from ..sources import matrix_market as MM
from ..sources import text as TX
from .sparsify import ready

EDGES = "ordinal long, u long, v long, w double, d double, p double, coin double, kept boolean"


def _every_node(spark: SparkSession, rows: DataFrame, column: str, n: int, k: int) -> DataFrame:
    """(row, values) of all n nodes; those without edges are zero."""
    none = F.array_repeat(F.lit(0.0), k)
    return spark.range(n).withColumnRenamed("id", "node").join(rows, "node", "left").select(F.col("node").alias("row"), F.coalesce(column, none).alias("values"))


def write_stages(edges: DataFrame, n: int, p: Params, folder: str) -> None:
    spark = edges.sparkSession
    numbered = materialize(G.ordinals(ready(edges, p)))
    held = numbered.drop("ordinal")
    k = p.jl_dim(n)
    y = materialize(sketch.wide(held, p, k))
    x = materialize(solver.solve(held, y, k, p.strategy))
    decided = sample.decide(leverage.probabilities(leverage.diff_norms(numbered, x), p.beta(n), k), p.sampling_seed, p.reweight, p.hash_flavour)
    MM.write_matrix(G.laplacian(held), f"{folder}/laplacian.mtx", n, symmetric=True)
    MM.write_matrix(G.incidence_by_ordinal(numbered).select(F.col("edge").alias("row"), F.col("node").alias("col"), "value"), f"{folder}/incidence.mtx", numbered.count(), columns=n)
    TX.write_dense_csv(_every_node(spark, y, "y", n, k), f"{folder}/sketch.csv")
    TX.write_dense_csv(_every_node(spark, x, "x", n, k), f"{folder}/solution.csv")
    decided.orderBy("ordinal").select("ordinal", "u", "v", "w", "d", "p", "coin", "kept").write.mode("overwrite").csv(f"{folder}/edges.csv")


def read_stages(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """laplacian, incidence, sketch and solution as (row, col, value), and edges."""
    found = {name: MM.read_matrix(spark, f"{folder}/{name}.mtx")[0] for name in ("laplacian", "incidence")}
    found |= {name: TX.read_dense_csv(spark, f"{folder}/{name}.csv") for name in ("sketch", "solution")}
    return found | {"edges": spark.read.schema(EDGES).csv(f"{folder}/edges.csv")}
