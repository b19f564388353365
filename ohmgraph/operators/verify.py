"""Checks of a sparsified graph against its original."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H
from . import graph as G
from .components import components, forest, labels, materialize


#: Links whose components are found on the driver, counted first: 16 MB of endpoints.
AT_ONCE = 1_000_000
#: Edges that a task of probes works on at once.
EDGES = 1 << 19
#: Entries of probes that it holds; edges whose differences are taken at once.
HELD, STEP = 1 << 22, 1 << 10


def labelled(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(node, component); with n also of nodes without edges."""
    found = components(materialize(forest(edges)), at_once=AT_ONCE)
    if n is None:
        return found
    every = edges.sparkSession.range(n).withColumnRenamed("id", "node")
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def count_components(edges: DataFrame, n: int | None = None) -> int:
    """Over all n nodes; without n, over the nodes up to the greatest that has an edge."""
    if n is None:
        top = edges.agg(F.max("v")).first()[0]
        n = 0 if top is None else int(top) + 1
    links = materialize(forest(edges))
    some = links.limit(AT_ONCE + 1).toArrow()
    if some.num_rows <= AT_ONCE:
        u, v = (A.column(some, c) for c in ("u", "v"))
        nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
        return n - len(nodes) + len(np.unique(labels(len(nodes), flat[: len(u)], flat[len(u) :])))
    touched = components(links).agg(F.count(F.lit(1)), F.countDistinct("component")).first()
    return n - touched[0] + touched[1]


def probe_vectors(edges: DataFrame, probes: int, seed: int, flavour: str = "xx") -> DataFrame:
    """(probe, node, x): uniform vectors on the nodes with an edge."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    grid = nodes.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))))
    return grid.select("probe", "node", H.uniform("pr", F.col("probe"), F.col("node"), seed=seed, flavour=flavour).alias("x"))


def forms(edges: DataFrame, probes: int, seed: int, flavour: str = "xx") -> DataFrame:
    """(probe, value) for hashed probes. A task makes the entries of the nodes it meets, so nothing is joined, and sends
    a row a probe."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for t in A.chunks(batches, EDGES):
            w = A.column(t, "w")
            nodes, flat = np.unique(np.concatenate((A.column(t, "u"), A.column(t, "v"))), return_inverse=True)
            u, v = flat[: len(w)], flat[len(w) :]
            total = np.zeros(probes) if total is None else total
            wide = max(1, HELD // len(nodes))
            for a in range(0, probes, wide):
                js = range(a, min(probes, a + wide))
                x = np.empty((len(nodes), len(js)))
                for i in js:
                    x[:, i - a] = A.uniform(A.bits32("pr", [i], [nodes], [None], seed, flavour)[0])
                for b in range(0, len(w), STEP):
                    d = x[u[b : b + STEP]]
                    d -= x[v[b : b + STEP]]
                    d *= d
                    total[a : a + len(js)] += w[b : b + STEP] @ d
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(probes, dtype=np.int32)), pa.array(total)], ["probe", "value"])

    return edges.select("u", "v", "w").mapInArrow(work, "probe int, value double").groupBy("probe").agg(F.sum("value").alias("value"))


def form_errors(before: DataFrame, after: DataFrame) -> DataFrame:
    """(probe, before, after, error) of two tables of forms."""
    a, b = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    both = a.join(b, "probe", "left").withColumn("after", F.coalesce("after", F.lit(0.0)))
    return both.withColumn("error", F.abs(F.col("after") - F.col("before")) / F.col("before"))


def probe_errors(original: DataFrame, sparse: DataFrame, probes: int, seed: int, flavour: str = "xx") -> DataFrame:
    """(probe, before, after, error)."""
    return form_errors(forms(original, probes, seed, flavour), forms(sparse, probes, seed, flavour))


def probe_summary(errors: DataFrame, epsilon: float) -> DataFrame:
    """Violations (bounds included), mean, population deviation and maximum of the errors."""
    return errors.agg(
        F.count_if(F.col("after") >= (1 + epsilon) * F.col("before")).alias("upper_bound_violations"),
        F.count_if(F.col("after") <= (1 - epsilon) * F.col("before")).alias("lower_bound_violations"),
        F.avg("error").alias("mean_rel_error"),
        F.stddev_pop("error").alias("std_dev_rel_error"),
        F.max("error").alias("max_rel_error"),
    )


def added_edges(original: DataFrame, sparse: DataFrame) -> DataFrame:
    """Edges of sparse that original doesn't have."""
    return sparse.join(original.select("u", "v"), ["u", "v"], "left_anti")


def invalid_laplacian(matrix: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(kind, at, amount): columns that don't add up to 0, and places unlike their mirror."""
    sums = G.column_sums(matrix).where(F.abs("total") > tolerance).select(F.lit("column").alias("kind"), F.col("col").cast("string").alias("at"), F.col("total").alias("amount"))
    odd = G.asymmetric(matrix, tolerance).select(F.lit("mirror").alias("kind"), F.concat_ws(",", "row", "col").alias("at"), F.col("gap").alias("amount"))
    return sums.unionByName(odd)


def differences(a: DataFrame, b: DataFrame, epsilon: float) -> DataFrame:
    """Places of two tables of numbers (row, col, value) that differ by more than epsilon or exist in one; NaNs agree."""
    x = a.select("row", "col", F.col("value").alias("a"), F.lit(1).alias("_a"))
    y = b.select("row", "col", F.col("value").alias("b"), F.lit(1).alias("_b"))
    both = x.join(y, ["row", "col"], "full_outer")
    agree = (F.isnan("a") & F.isnan("b")) | (F.abs(F.col("a") - F.col("b")) <= epsilon)
    return both.where(F.col("_a").isNull() | F.col("_b").isNull() | ~agree | (F.isnan("a") != F.isnan("b"))).select("row", "col", "a", "b")


def cut_weight(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """One row: weight across a partition (node, side), each cut edge counted from both of its ends."""
    at = lambda s: sides.select(F.col("node").alias(s), F.col("side").alias(f"s{s}"))
    both = edges.join(at("u"), "u").join(at("v"), "v")
    return both.agg(F.coalesce(F.sum(F.when(F.col("su") != F.col("sv"), 2 * F.col("w"))), F.lit(0)).alias("cut_weight"))


def cut_change(original: DataFrame, sparse: DataFrame, sides: DataFrame) -> DataFrame:
    """One row: weight across a partition before and after, and their ratio (null where nothing was cut)."""
    a, b = cut_weight(original, sides).withColumnRenamed("cut_weight", "before"), cut_weight(sparse, sides).withColumnRenamed("cut_weight", "after")
    both = a.select("before", F.lit(0.0).alias("after")).unionByName(b.select(F.lit(0.0).alias("before"), "after"))
    return both.agg(F.sum("before").alias("before"), F.sum("after").alias("after")).withColumn("ratio", F.expr("try_divide(after, before)"))


def degree_change(original: DataFrame, sparse: DataFrame) -> DataFrame:
    """One row: norm of the difference of the diagonals."""
    a, b = G.degrees(original), G.degrees(sparse).withColumnRenamed("degree", "other")
    gap = F.coalesce("degree", F.lit(0.0)) - F.coalesce("other", F.lit(0.0))
    return a.join(b, "node", "full_outer").agg(F.sqrt(F.sum(gap * gap)).alias("norm"))
