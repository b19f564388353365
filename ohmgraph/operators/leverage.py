"""Effective resistances and sampling probabilities of edges, as columns on the edge rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import arrays as A
from ..params import Params
from . import graph as G
from . import sketch, solver
from .components import materialize

#: Numbers of a solution that are broadcast (64 MB); edges whose distances are found at once.
HELD, STEP = 8_000_000, 1 << 9


def diff_norms(edges: DataFrame, x: DataFrame) -> DataFrame:
    """edges with d, the distance of the endpoints' rows of x (node, x array). Where x is within HELD numbers, counted
    first, it is broadcast; else joined."""
    x = materialize(x)
    width = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("k")).first()
    if 0 < width["n"] * (width["k"] or 0) <= HELD:
        return _broadcast_norms(edges, x, width["k"])
    side = lambda s: x.select(F.col("node").alias(s), F.col("x").alias(f"x{s}"))
    gap = F.zip_with("xu", "xv", lambda a, b: (a - b) * (a - b))
    both = edges.join(side("u"), "u").join(side("v"), "v")
    return both.withColumn("d", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, t: acc + t))).drop("xu", "xv")


def _broadcast_norms(edges: DataFrame, x: DataFrame, k: int) -> DataFrame:
    found = x.toArrow()
    nodes, rows = A.column(found, "node"), A.unlisted(found, "x", k)
    order = np.argsort(nodes)
    shared = edges.sparkSession.sparkContext.broadcast((nodes[order], rows[order]))
    names = edges.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, rows = shared.value
        for t in batches:
            u, v = (t.column(names.index(c)).to_numpy() for c in ("u", "v"))
            i, j = np.searchsorted(nodes, u), np.searchsorted(nodes, v)
            known = (nodes[np.minimum(i, len(nodes) - 1)] == u) & (nodes[np.minimum(j, len(nodes) - 1)] == v)
            if not known.all():  # as a join does
                t, i, j = t.filter(pa.array(known)), i[known], j[known]
            d = np.empty(len(i))
            for a in range(0, len(i), STEP):
                gap = rows[i[a : a + STEP]] - rows[j[a : a + STEP]]
                d[a : a + STEP] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(d)], [*names, "d"])

    return edges.mapInArrow(work, StructType([*edges.schema.fields, StructField("d", DoubleType())]))


def prefix_norms(edges: DataFrame, x: DataFrame, ks: list[int]) -> DataFrame:
    """(u, v, w and d{k} for each k), packed: distances over the first k columns of x. edges are packed. As many columns are
    broadcast at once as are within HELD numbers; where not even one is, rows are joined."""
    x, top = materialize(x), max(ks)
    n = x.count()
    if n > HELD:
        out = G.rows(edges)
        for k in ks:
            out = diff_norms(out, x.select("node", F.slice("x", 1, k).alias("x"))).withColumnRenamed("d", f"d{k}")
        names = ["u", "v", "w", *[f"d{k}" for k in ks]]
        pack = lambda batches: (b for t in A.chunks(batches, 1 << 18) for b in A.packed(names, [A.column(t, c) for c in names]))
        return out.select(*names).mapInArrow(pack, ", ".join(f"{c} binary" for c in names))
    step, out = max(1, HELD // max(1, n)), edges.select("u", "v", "w")
    for a in range(0, top, step):
        b = min(top, a + step)
        out = _prefix_pass(out, x.select("node", F.slice("x", a + 1, b - a).alias("x")), a, b, ks)
        out = materialize(out) if b < top else out.drop("s")
    return out


def _prefix_pass(edges: DataFrame, x: DataFrame, start: int, stop: int, ks: list[int]) -> DataFrame:
    """edges with d{k} for each k from start (not included) to stop, and s, the sum of squares up to stop."""
    found = x.toArrow()
    nodes, rows = A.column(found, "node"), A.unlisted(found, "x", stop - start)
    order = np.argsort(nodes)
    shared = edges.sparkSession.sparkContext.broadcast((nodes[order], rows[order]))
    cuts = [start, *sorted({k for k in ks if start < k < stop}), stop]
    old = [c for c in edges.columns if c != "s"]
    names = [*old, *[f"d{k}" for k in cuts[1:] if k in ks], "s"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, rows = shared.value
        for t in A.plain(batches):
            known = {c: t.column(c).to_numpy() for c in t.schema.names}
            i, j = np.searchsorted(nodes, known["u"]), np.searchsorted(nodes, known["v"])
            total = known["s"].copy() if start else np.zeros(len(i))
            sums = np.empty((len(cuts) - 1, len(i)))
            for a in range(0, len(i), STEP):
                gap = rows[i[a : a + STEP]]
                gap -= rows[j[a : a + STEP]]
                for c, (p, q) in enumerate(zip(cuts, cuts[1:])):
                    part = gap[:, p - start : q - start]
                    sums[c, a : a + STEP] = np.einsum("ij,ij->i", part, part)
            for c, k in enumerate(cuts[1:]):
                total = total + sums[c]
                if k in ks:
                    known[f"d{k}"] = np.sqrt(total)
            known["s"] = total
            yield from A.packed(names, [known[c] for c in names])

    return edges.mapInArrow(work, ", ".join(f"{c} binary" for c in names))


def probabilities(edges: DataFrame, beta: float, k: int) -> DataFrame:
    """edges (with d) with p = min(1, beta w d^2 / k)."""
    return edges.withColumn("p", F.least(F.lit(1.0), F.lit(beta) * F.col("w") * F.col("d") * F.col("d") / F.lit(float(k))))


def estimate(edges: DataFrame, n: int, p: Params) -> DataFrame:
    """edges with d and p: sketch, solve, distances, probabilities."""
    k = p.jl_dim(n)
    x = solver.solve(edges, sketch.wide(edges, p, k), k, p.strategy)
    return probabilities(diff_norms(edges, x), p.beta(n), k)


def exact_resistance(edges: DataFrame, nodes: int) -> DataFrame:
    """edges with resistance, from a dense solve with one column a node; for graphs of at most solver.DENSE_NODES."""
    if nodes > solver.DENSE_NODES:
        raise ValueError("exact resistances need a small graph")
    ids = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    order = ids.withColumn("i", F.row_number().over(_by_node()) - 1)
    unit = order.select("node", F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda j: F.when(j == F.col("i"), 1.0).otherwise(0.0)).alias("y"))
    x = solver.solve(edges, unit, nodes, "dense")
    at = lambda s: order.select(F.col("node").alias(s), F.col("i").alias(f"i{s}")).join(x.select(F.col("node").alias(s), F.col("x").alias(f"x{s}")), s)
    both = edges.join(at("u"), "u").join(at("v"), "v")
    get = lambda a, i: F.get(a, i)
    r = get("xu", F.col("iu")) + get("xv", F.col("iv")) - 2 * get("xu", F.col("iv"))
    return both.withColumn("resistance", r).drop("xu", "xv", "iu", "iv")


def _by_node():
    from pyspark.sql import Window

    return Window.orderBy("node")
