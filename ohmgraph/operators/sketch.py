"""Johnson-Lindenstrauss sketches Y = B' S of the signed incidence matrix; S is hashed, never stored."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H
from ..params import Params
from . import graph as G

#: Columns put together in one array expression; edges that a task works on at once; numbers that it holds.
WIDTH, EDGES, HELD = 64, 1 << 18, 1 << 23


def entry(j: Column | int, p: Params, u: str = "u", v: str = "v") -> Column:
    """S at edge (u, v), column j."""
    make = {"uniform": H.uniform, "discrete": H.sign, "gaussian": H.gaussian}[p.sketch]
    j = F.lit(j) if isinstance(j, int) else j
    scale = 1.0 if p.sketch == "gaussian" else p.jl_scaling
    return make("sk", F.col(u), F.col(v), j, seed=p.sketch_seed, flavour=p.hash_flavour) * F.lit(scale)


def rows(edges: DataFrame, p: Params, start: int, stop: int) -> DataFrame:
    """(u, v, s): columns start to stop of S for each edge."""
    return edges.select("u", "v", F.array(*[entry(j, p) for j in range(start, stop)]).alias("s"))


def long(edges: DataFrame, p: Params, k: int) -> DataFrame:
    """(node, j, y): the product in long form."""
    spread = edges.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    value = F.sqrt("w") * entry(F.col("j"), p)
    at = lambda node, x: F.struct(F.col(node).alias("node"), x.alias("y"))
    both = spread.select("j", F.explode(F.array(at("v", value), at("u", -value))).alias("e")).select("j", "e.*")
    return both.groupBy("node", "j").agg(F.sum("y").alias("y"))


def values(u: np.ndarray, v: np.ndarray, js: Sequence[int], p: Params) -> np.ndarray:
    """(len(js), edges): columns js of S as an array, the numbers of entry()."""
    bits = lambda role: A.bits32(role, [], [u, v], js, p.sketch_seed, p.hash_flavour)
    if p.sketch == "gaussian":
        return np.sqrt(-2.0 * np.log(A.coin(bits("skr")))) * np.cos(2 * math.pi * A.coin(bits("ska")))
    return _shaped(bits("sk"), p)


def _shaped(bits: np.ndarray, p: Params) -> np.ndarray:
    return (A.uniform if p.sketch == "uniform" else A.sign)(bits) * p.jl_scaling


def same_bits(p: Params) -> tuple:
    """Sketches that agree in this are made from the same bits."""
    return p.sketch == "gaussian", p.sketch_seed, p.hash_flavour


def wide(edges: DataFrame, p: Params, k: int, also: Sequence[Params] = ()) -> DataFrame:
    """(node, y array of k): sums by node in each task, over arrays and with each entry of S made once, then one shuffle
    of those. Few tasks, as each sends up to nodes x columns; a task lets go of its sums beyond HELD numbers. also: more
    sketches of the same bits, whose k columns each follow. Packed edges with a column bin meet by it in a task."""
    every, each = [p, *also], k
    k = each * len(every)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, y = np.empty(0, dtype=np.int64), np.empty((0, k))
        give = lambda: pa.RecordBatch.from_arrays([pa.array(nodes), A.lists(y)], ["node", "y"])
        for t in A.chunks(batches, EDGES):
            u, v, root = A.column(t, "u"), A.column(t, "v"), np.sqrt(A.column(t, "w"))
            here, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
            order = np.argsort(flat[: len(u)], kind="stable")  # sums of neighbours are near each other
            u, v, root, i, j = u[order], v[order], root[order], flat[: len(u)][order], flat[len(u) :][order]
            new = np.setdiff1d(here, nodes, assume_unique=True)
            if len(new):
                if len(nodes) and (len(nodes) + len(new)) * k > HELD:
                    yield give()
                    nodes, y, new = nodes[:0], y[:0], here
                nodes, y = np.concatenate((nodes, new)), np.concatenate((y, np.zeros((len(new), k))))
                order = np.argsort(nodes)
                nodes, y = nodes[order], y[order]
            at = np.searchsorted(nodes, here)
            for a in range(0, each, 8):
                js = range(a, min(each, a + 8))
                s = np.empty((len(every), len(js), len(u)))
                for b in range(0, len(u), A.BLOCK):
                    some = slice(b, b + A.BLOCK)
                    if also:
                        bits = A.bits32("sk", [], [u[some], v[some]], js, p.sketch_seed, p.hash_flavour)
                    for c, q in enumerate(every):
                        np.multiply(_shaped(bits, q) if also else values(u[some], v[some], js, q), root[some], out=s[c, :, some])
                for c in range(len(every)):
                    sums = [np.bincount(j, x, len(here)) - np.bincount(i, x, len(here)) for x in s[c]]
                    y[at, c * each + a : c * each + a + len(js)] += np.stack(sums, axis=1)
        if len(nodes):
            yield give()

    tasks = 2 * edges.sparkSession.sparkContext.defaultParallelism
    if "bin" in edges.columns:
        edges = edges.repartitionById(tasks, F.pmod("bin", F.lit(tasks)).cast("int"))
    else:
        edges = edges.repartition(tasks) if G.is_packed(edges) else edges.coalesce(tasks)
    parts = edges.select("u", "v", "w").mapInArrow(work, "node long, y array<double>")
    blocks = [range(a, min(k, a + WIDTH)) for a in range(0, k, WIDTH)]
    sums = parts.groupBy("node").agg(*[F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(k)])
    return sums.select("node", F.concat(*[F.array(*[f"y{j}" for j in b]) for b in blocks]).alias("y"))
