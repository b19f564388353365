"""Solves L X = Y for all columns of Y at once.

Strategies, chosen by counted sizes: `dense` for components of a few thousand nodes, each solved on its own and dealt to
tasks together; `columns` where the edges fit in a task: edges are broadcast and the columns of Y dealt to tasks, each a
conjugate gradient over numpy arrays, preconditioned by a multigrid of aggregated nodes (see `multigrid`); `distributed`
beyond: block conjugate gradients, preconditioned with the diagonal, over rows of the adjacency packed into a table.
There the vectors, as many columns at a time as are HELD numbers, are on the driver and broadcast each step; with more
nodes than that they are a table in the shared folder each step. `auto` takes small components by the first and what
is left by one of the others. All project onto the components' zero-sum spaces; a zero column stays zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..params import ACCEPT_RELATIVE, MAX_ITERATIONS, STOP_RESIDUAL
from . import graph as G
from .components import components, forest, labels, materialize
from .multigrid import Multigrid, dots

#: Bounds of the first two strategies, counted before they are chosen; 24 bytes an edge are broadcast.
DENSE_NODES, COLUMN_EDGES = 3000, 5_000_000
#: Links whose components are found on the driver; edges of small components, and entries of rows, that a task takes.
AT_ONCE, BIN_EDGES, PACK = 1_000_000, 250_000, 1 << 21
#: Numbers of a block of vectors on the driver, of which there are about six; entries multiplied at once.
HELD, STEP = 8_000_000, 1 << 13
#: Numbers of a block of vectors in a task; rows of a packed matrix that are multiplied at once where they are dense, which
#: is where one entry in FULL of the columns that they reach is there.
BLOCK, ROWS, FULL = 1 << 20, 256, 16


def solve_dense(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact minimum-norm solution; y: n x k."""
    lap = np.zeros((n, n))
    np.add.at(lap, (u, v), -w)
    np.add.at(lap, (v, u), -w)
    np.add.at(lap, (u, u), w)
    np.add.at(lap, (v, v), w)
    label = labels(n, u, v)
    same = label[:, None] == label[None, :]
    lap += same / np.bincount(label, minlength=n)[label][:, None]
    return project(np.linalg.solve(lap, project(y, label)), label)


def project(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """x less its mean over each component."""
    size = np.bincount(label, minlength=len(label))
    mean = np.zeros_like(x)
    np.add.at(mean, label, x)
    return x - (mean / np.maximum(size, 1)[:, None])[label]


def solve_pcg(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, y: np.ndarray, max_iterations: int = MAX_ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(x, relative residual) by column."""
    grid = Multigrid(n, u, v, w)
    label = labels(n, u, v)
    out, left = np.zeros_like(y), np.zeros(y.shape[1])
    width = max(1, BLOCK // max(1, n))
    for a in range(0, y.shape[1], width):
        r = project(y[:, a : a + width], label)
        norm = np.sqrt(dots(r, r))
        at = np.flatnonzero(norm > 0)  # columns that are not done
        r, norm = r[:, at], norm[at]
        at += a
        if not len(at):
            continue
        z, x = grid(r), np.zeros_like(r)
        p, rz = z.copy(), dots(r, z)
        for _ in range(max_iterations):
            ap = grid.laplacian(p)
            step = rz / dots(p, ap)
            x += step * p
            before, r = r, r - step * ap
            now = np.sqrt(dots(r, r))
            out[:, at], left[at] = x, now / norm
            on = now > STOP_RESIDUAL
            if not on.any():
                break
            if not on.all():
                at, norm, x, p, rz, r, before = at[on], norm[on], x[:, on], p[:, on], rz[on], r[:, on], before[:, on]
            z = grid(r)
            turned, old = dots(z, r - before), rz  # flexible: the preconditioner is not quite linear
            rz = dots(r, z)
            p = z + turned / old * p
    return project(out, label), left


class NotConverged(RuntimeError):
    """A column's relative residual is above the accepted one."""


def _arrays(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = edges.select("u", "v", "w").toArrow()
    return tuple(found.column(c).to_numpy() for c in ("u", "v", "w"))


def _columns(edges: DataFrame, y: DataFrame, k: int, dense: bool) -> DataFrame:
    """The first two strategies. Edges were counted and are within bounds."""
    spark = edges.sparkSession
    u, v, w = _arrays(edges)
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, n = flat[: len(u)], flat[len(u) :], len(nodes)
    shared = spark.sparkContext.broadcast((nodes, a, b, w.astype(float)))
    groups = 1 if dense else min(k, max(1, spark.sparkContext.defaultParallelism))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [x for x in batches if len(x)]
        if not parts:
            return
        rows = pd.concat(parts)
        nodes, a, b, w = shared.value
        n = len(nodes)
        js, col = np.unique(rows["j"].to_numpy(), return_inverse=True)
        rhs = np.zeros((n, len(js)))
        rhs[np.searchsorted(nodes, rows["node"].to_numpy()), col] = rows["y"].to_numpy()
        if dense:
            x = solve_dense(n, a, b, w, rhs)
        else:
            x, left = solve_pcg(n, a, b, w, rhs)
            if (left >= ACCEPT_RELATIVE).any():
                raise NotConverged(f"relative residual {left.max():.3g}")
        yield pd.DataFrame({"node": np.repeat(nodes, len(js)), "j": np.tile(js, n), "x": x.reshape(-1)})

    long = y.select("node", F.posexplode("y").alias("j", "y"))
    solved = long.withColumn("g", F.pmod("j", F.lit(groups))).repartition(groups, "g").drop("g").mapInPandas(work, "node long, j int, x double")
    return G.to_rows(solved.select(F.col("node").alias("row"), F.col("j").alias("col"), F.col("x").alias("value"))).withColumnsRenamed({"row": "node", "values": "x"})


def _each(f, *arrays: str) -> Column:
    """f over arrays, element by element."""
    zipped = F.arrays_zip(*[F.col(a).alias(f"a{i}") for i, a in enumerate(arrays)])
    return F.transform(zipped, lambda t: f(*[t[f"a{i}"] for i in range(len(arrays))]))


def _array_sum(df: DataFrame, by: list[str], column: str, k: int) -> DataFrame:
    sums = df.groupBy(*by).agg(*[F.sum(F.col(column)[j]).alias(f"s{j}") for j in range(k)])
    return sums.select(*by, F.array(*[f"s{j}" for j in range(k)]).alias(column))


def _dots(df: DataFrame, a: str, b: str, k: int) -> np.ndarray:
    row = df.agg(*[F.sum(F.col(a)[j] * F.col(b)[j]).alias(f"d{j}") for j in range(k)]).first()
    return np.array([x or 0.0 for x in row])


def _literal(x: np.ndarray) -> Column:
    return F.lit([float(y) for y in x])


def _centred(rows: DataFrame, column: str, k: int) -> DataFrame:
    """rows with the mean over each component taken off an array column."""
    total = _array_sum(rows, ["component"], column, k).withColumnRenamed(column, "_total")
    mean = total.join(rows.groupBy("component").agg(F.count(F.lit(1)).alias("_n")), "component")
    return rows.join(mean, "component").withColumn(column, F.zip_with(column, "_total", lambda a, t: a - t / F.col("_n"))).drop("_total", "_n")


def _tables(edges: DataFrame, y: DataFrame, k: int, max_iterations: int) -> DataFrame:
    """Block PCG; k scalars a step reach the driver, everything else is in tables."""
    both = materialize(G.adjacency(edges).withColumnsRenamed({"row": "node", "col": "other", "value": "w"}).repartition("other"))
    comp = components(edges.select("u", "v"))
    base = _centred(y.join(comp, "node").join(G.degrees(edges), "node"), "y", k)
    state = base.select("node", "degree", F.array_repeat(F.lit(0.0), k).alias("x"), F.col("y").alias("r"))
    state = materialize(state.withColumn("z", F.transform("r", lambda v: v / F.col("degree"))).withColumn("p", F.col("z")))
    norm = np.sqrt(_dots(state, "r", "r", k))
    rz = _dots(state, "r", "z", k)
    left = norm.copy()
    for _ in range(max_iterations):
        if (left <= STOP_RESIDUAL).all():
            break
        sent = both.join(state.select(F.col("node").alias("other"), F.col("p").alias("q")), "other").select("node", F.transform("q", lambda t: t * F.col("w")).alias("q"))
        pulled = _array_sum(sent, ["node"], "q", k)
        moved = materialize(state.join(pulled, "node").withColumn("ap", F.zip_with("p", "q", lambda a, b: a * F.col("degree") - b)).drop("q"))
        pap = _dots(moved, "p", "ap", k)
        live = (left > STOP_RESIDUAL) & (pap > 0)
        alpha = np.divide(rz, pap, out=np.zeros(k), where=live)
        moved = moved.withColumn("_a", _literal(alpha))
        moved = moved.withColumns({"x": _each(lambda x, p, a: x + a * p, "x", "p", "_a"), "r": _each(lambda r, q, a: r - a * q, "r", "ap", "_a")})
        moved = moved.withColumn("z", F.transform("r", lambda v: v / F.col("degree")))
        fresh, old = _dots(moved, "r", "z", k), rz
        left = np.sqrt(_dots(moved, "r", "r", k))
        beta = np.divide(fresh, old, out=np.zeros(k), where=live & (old != 0))
        rz = fresh
        state = materialize(moved.withColumn("_b", _literal(beta)).withColumn("p", _each(lambda z, p, b: z + b * p, "z", "p", "_b")).select("node", "degree", "x", "r", "z", "p"))
    bad = np.divide(left, norm, out=np.zeros(k), where=norm > 0)
    if (bad >= ACCEPT_RELATIVE).any():
        raise NotConverged(f"relative residual {bad.max():.3g}")
    return _centred(state.join(comp, "node").select("node", "component", "x"), "x", k).select("node", "x")


def _solve_bin(dense: bool):
    """For a bin of whole components: (node, x) of each, solved one by one."""

    def work(edges: pa.Table, y: pa.Table) -> pa.Table:
        node, comp = A.column(y, "node"), A.column(y, "component")
        if "component" in edges.schema.names:
            u, v, w, owner = (A.column(edges, c) for c in ("u", "v", "w", "component"))
        else:
            t = pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["u", "v", "w"]), *A.plain(edges.select(["u", "v", "w"]).to_batches())])
            u, v, w = (t.column(c).to_numpy() for c in "uvw")
            known = np.argsort(node)
            owner = comp[known][np.searchsorted(node[known], u)]
        order = np.argsort(owner, kind="stable")
        u, v, w, owner = u[order], v[order], w[order], owner[order]
        at = np.lexsort((node, comp))
        node, comp = node[at], comp[at]
        rhs = A.unlisted(y, "y", len(y.column("y")[0])) if len(node) else np.empty((0, 0))
        rhs, out = rhs[at], np.zeros_like(rhs)
        names, first = np.unique(comp, return_index=True)
        for name, a, b in zip(names, first, np.append(first[1:], len(node)), strict=True):
            e = slice(*np.searchsorted(owner, (name, name + 1)))
            i, j = np.searchsorted(node[a:b], u[e]), np.searchsorted(node[a:b], v[e])
            if dense:
                out[a:b] = solve_dense(b - a, i, j, w[e], rhs[a:b])
            else:
                out[a:b], left = solve_pcg(b - a, i, j, w[e], rhs[a:b])
                if (left >= ACCEPT_RELATIVE).any():
                    raise NotConverged(f"relative residual {left.max():.3g}")
        return pa.table({"node": pa.array(node, pa.int64()), "x": A.lists(out)})

    return work


def _bins(edges: DataFrame, y: DataFrame, m: int, dense: bool) -> DataFrame:
    """Component by component, dealt to tasks in bins. edges (at most m) and y have a column component."""
    bins = max(1, -(-m // BIN_EDGES))
    of = F.pmod(F.xxhash64("component"), F.lit(bins)).cast("int").alias("bin")
    own = F.col("component").alias("component")
    left = edges.select("u", "v", F.col("w").cast("double").alias("w"), own, of).groupBy("bin")
    right = y.select("node", "y", own, of).groupBy("bin")
    return left.cogroup(right).applyInArrow(_solve_bin(dense), "node long, x array<double>")


def _packed_bins(facts: Facts, y: DataFrame, dense: bool) -> DataFrame:
    """As _bins, of packed edges, which facts deals once."""
    edges, comp = facts.dealt
    right = y.select("node", "y").join(comp, "node")
    return edges.groupBy("bin").cogroup(right.groupBy("bin")).applyInArrow(_solve_bin(dense), "node long, x array<double>")


def _tagged(df: DataFrame, comp: DataFrame, node: str) -> DataFrame:
    return df.join(comp.select(F.col("node").alias(node), F.col("component").alias("component")), node)  # columns of its own


def _owners(edges: DataFrame) -> DataFrame:
    """(node, component), to be broadcast where it is small."""
    comp = materialize(components(materialize(forest(edges)), at_once=AT_ONCE))
    return comp.hint("broadcast") if comp.count() <= AT_ONCE else comp


def _pack(batches: Iterator[pa.RecordBatch], nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries (row, col, value) as a row of binary arrays a chunk: rows, where each starts, columns, values."""
    for t in A.chunks(batches, PACK):
        row = np.searchsorted(nodes, A.column(t, "row")).astype(np.int32)
        order = np.argsort(row, kind="stable")
        rows, start = np.unique(row[order], return_index=True)
        col = np.searchsorted(nodes, A.column(t, "col")).astype(np.int32)[order]
        parts = (rows, start.astype(np.int64), col, A.column(t, "value")[order].astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["rows", "start", "col", "value"])


def _both_ways(edges: DataFrame, shared, blocks: int) -> DataFrame:
    """Entries of the adjacency of packed edges, by ranges of rows; packed. shared: the nodes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = shared.value
        for t in A.chunks(batches, PACK >> 1):
            u, v, w = (A.column(t, c) for c in "uvw")
            row, col, value = np.concatenate((u, v)), np.concatenate((v, u)), np.concatenate((w, w))
            yield from A.dealt((np.searchsorted(nodes, row) * blocks // len(nodes)).astype(np.int32), ("row", "col", "value"), (row, col, value), "part")

    dealt = edges.select("u", "v", "w").mapInArrow(work, "part int, row binary, col binary, value binary")
    return dealt.repartitionById(blocks, F.col("part")).select("row", "col", "value")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (row, col, value) as they are, or of packed ones a batch a row."""
    for b in batches:
        if not pa.types.is_binary(b.schema.field("row").type):
            yield b
            continue
        for i in range(b.num_rows):
            cells = [(t, b.column(c)[i].as_buffer()) for c, t in (("row", pa.int64()), ("col", pa.int64()), ("value", pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(t, x.size // 8, [None, x]) for t, x in cells], ["row", "col", "value"])


def _dense_times(rows: np.ndarray, start: np.ndarray, col: np.ndarray, value: np.ndarray, p: np.ndarray) -> np.ndarray:
    """As _times, by whole matrices over ROWS rows and the columns that they reach, where these are dense."""
    out, ends = np.empty((len(rows), p.shape[1])), np.append(start, len(col))
    for a in range(0, len(rows), ROWS):
        b = min(a + ROWS, len(rows))
        cut = slice(ends[a], ends[b])
        reached = np.zeros(len(p), dtype=bool)
        reached[col[cut]] = True
        nodes = np.flatnonzero(reached)
        if (b - a) * len(nodes) > FULL * (ends[b] - ends[a]):
            out[a:b] = _times(rows[a:b], start[a:b] - start[a], col[cut], value[cut], p)
            continue
        place = np.cumsum(reached) - 1
        matrix = np.zeros((b - a, len(nodes)))
        np.add.at(matrix, (np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), place[col[cut]]), value[cut])
        out[a:b] = matrix @ p[nodes]
    return out


def _times(rows: np.ndarray, start: np.ndarray, col: np.ndarray, value: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The packed rows times p; a row can run over several steps."""
    out = np.zeros((len(rows), p.shape[1]))
    for a in range(0, len(col), STEP):
        b = min(a + STEP, len(col))
        i, j = np.searchsorted(start, a, side="right") - 1, np.searchsorted(start, b)
        out[i:j] += np.add.reduceat(p[col[a:b]] * value[a:b, None], np.maximum(start[i:j] - a, 0), axis=0)
    return out


def _packed(edges: DataFrame, y: DataFrame, k: int, max_iterations: int, facts: Facts) -> DataFrame:
    """Block PCG with the vectors on the driver. Nodes were counted: a column of them is within HELD."""
    spark = edges.sparkSession
    found = facts.owners.join(G.degrees(edges), "node").toArrow()
    nodes, owner, degree = (A.column(found, c) for c in ("node", "component", "degree"))
    order = np.argsort(nodes)
    nodes, owner, degree = nodes[order], owner[order], degree[order].astype(float)[:, None]
    label, n = np.searchsorted(nodes, owner), len(nodes)
    shared = spark.sparkContext.broadcast(nodes)
    blocks = max(1, -(-2 * facts.links // PACK))
    if G.is_packed(edges):
        both = _both_ways(edges, shared, blocks)
    else:
        both = G.adjacency(edges).repartitionByRange(blocks, "row")
    rows = materialize(both.mapInArrow(lambda x: _pack(_opened(x), shared.value), "rows binary, start binary, col binary, value binary"))

    def times(p: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(p)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                for r in t.to_pylist():
                    ids = np.frombuffer(r["rows"], np.int32)
                    q = _dense_times(ids, np.frombuffer(r["start"], np.int64), np.frombuffer(r["col"], np.int32), np.frombuffer(r["value"]), sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), A.lists(q)], ["i", "q"])

        got = rows.mapInArrow(work, "i int, q array<double>").toArrow()
        out = np.zeros_like(p)
        np.add.at(out, A.column(got, "i"), A.unlisted(got, "q", p.shape[1]))
        sent.destroy()
        return out

    width, out = max(1, HELD // n), None
    for a in range(0, k, width):
        some = F.slice("y", a + 1, min(k - a, width)).alias("y")
        t = y.select("node", some).join(F.broadcast(spark.createDataFrame(pa.table({"node": nodes}), "node long")) if n <= AT_ONCE else G.degrees(edges), "node", "left_semi").toArrow()
        r = np.zeros((n, min(k - a, width)))
        r[np.searchsorted(nodes, A.column(t, "node"))] = A.unlisted(t, "y", r.shape[1])
        x = _block_pcg(times, project(r, label), degree, max_iterations)
        part = spark.createDataFrame(pa.table({"node": pa.array(nodes), "x": A.lists(project(x, label))}), "node long, x array<double>")
        part = materialize(part) if width < k else part
        out = part if out is None else out.join(part.withColumnRenamed("x", "_x"), "node").select("node", F.concat("x", "_x").alias("x"))
    return out


def _block_pcg(times, r: np.ndarray, degree: np.ndarray, max_iterations: int) -> np.ndarray:
    """x for right-hand sides r; times(p) is the adjacency times p. Columns stop one by one."""
    dot = lambda a, b: np.einsum("ij,ij->j", a, b)
    k = r.shape[1]
    x, z = np.zeros_like(r), r / degree
    p, rz = z.copy(), dot(r, z)
    norm = np.sqrt(dot(r, r))
    left = norm.copy()
    for _ in range(max_iterations):
        live = left > STOP_RESIDUAL
        if not live.any():
            break
        ap = p * degree - times(p)
        pap = dot(p, ap)
        live &= pap > 0
        alpha = np.divide(rz, pap, out=np.zeros(k), where=live)
        x += alpha * p
        r = r - alpha * ap
        z = r / degree
        fresh, left = dot(r, z), np.sqrt(dot(r, r))
        p = z + np.divide(fresh, rz, out=np.zeros(k), where=live & (rz != 0)) * p
        rz = fresh
    bad = np.divide(left, norm, out=np.zeros(k), where=norm > 0)
    if (bad >= ACCEPT_RELATIVE).any():
        raise NotConverged(f"relative residual {bad.max():.3g}")
    return x


def _distributed(edges: DataFrame, y: DataFrame, k: int, max_iterations: int, facts: Facts | None = None) -> DataFrame:
    facts = facts or Facts(edges)
    if facts.nodes <= HELD:
        return _packed(edges, y, k, max_iterations, facts)
    return _tables(G.rows(edges), y, k, max_iterations)


class Facts:
    """What a choice of strategy needs to know of edges: counted when first asked for, and kept for more solves of them."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    @cached_property
    def links(self) -> int:
        return G.count(self.edges)

    @cached_property
    def nodes(self) -> int:
        return G.degrees(self.edges).count()

    @cached_property
    def owners(self) -> DataFrame:
        return _owners(self.edges)

    @cached_property
    def few(self) -> bool:
        """Whether the driver can hold the owners."""
        return self.nodes <= AT_ONCE

    @cached_property
    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and components, of a graph whose owners are few."""
        found = self.owners.toArrow()
        order = np.argsort(A.column(found, "node"))
        return A.column(found, "node")[order], A.column(found, "component")[order]

    @cached_property
    def dealt(self) -> tuple[DataFrame, DataFrame]:
        """Packed edges by bin of components, and (node, component, bin) of the nodes."""
        spark, (nodes, owner) = self.edges.sparkSession, self.held
        rank = np.unique(owner, return_inverse=True)[1]
        of = (rank % max(1, -(-self.links // BIN_EDGES))).astype(np.int32)
        shared = spark.sparkContext.broadcast((nodes, of))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes, of = shared.value
            for t in A.chunks(batches, PACK):
                u, v, w = (A.column(t, c) for c in "uvw")
                yield from A.dealt(of[np.searchsorted(nodes, u)], ("u", "v", "w"), (u, v, w), "bin")

        edges = materialize(self.edges.select("u", "v", "w").mapInArrow(work, "bin int, u binary, v binary, w binary"))
        table = pa.table({"node": nodes, "component": owner, "bin": of})
        return edges, materialize(spark.createDataFrame(table, "node long, component long, bin int")).hint("broadcast")

    @property
    def handy(self) -> DataFrame:
        """Packed edges, by bins where that deals them evenly: where all components are small."""
        return self.dealt[0] if self.few and self.small[1] == self.small[2] else self.edges

    @cached_property
    def small(self) -> tuple[DataFrame, int, int]:
        """The components of at most DENSE_NODES nodes, their number, and that of all."""
        size = self.owners.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        small = materialize(size.where(F.col("n") <= DENSE_NODES).select("component"))
        return small, small.count(), self.owners.select("component").distinct().count()


def solve(edges: DataFrame, y: DataFrame, k: int, strategy: str = "auto", max_iterations: int = MAX_ITERATIONS, facts: Facts | None = None) -> DataFrame:
    """(node, x array of k) for each node with an edge. y: (node, y array of k); isolated nodes need no solution. facts:
    of the edges, where they are solved for more than once."""
    facts = facts or Facts(edges)
    if strategy == "distributed":
        return _distributed(edges, y, k, max_iterations, facts)
    m = facts.links
    if m <= COLUMN_EDGES and (strategy == "columns" or facts.nodes <= DENSE_NODES):
        return _columns(G.rows(edges), y, k, strategy != "columns")
    comp = facts.owners
    if G.is_packed(edges):
        if facts.few and (strategy != "auto" or facts.small[1] == facts.small[2]):
            return _packed_bins(facts, y, strategy != "columns")
        edges = G.rows(edges)
    edges, y = _tagged(edges, comp, "u"), _tagged(materialize(y), comp, "node")
    if strategy != "auto":
        return _bins(edges, y, m, strategy == "dense")
    small, few, of = facts.small
    if few == of:
        return _bins(edges, y, m, True)
    rest = materialize(edges.join(small, "component", "left_anti").select("u", "v", "w"))
    other = y.join(small, "component", "left_anti").select("node", "y")
    out = _columns(rest, other, k, False) if rest.count() <= COLUMN_EDGES else _distributed(rest, other, k, max_iterations)
    if few:
        out = out.unionByName(_bins(edges.join(small, "component", "left_semi"), y.join(small, "component", "left_semi"), m, True))
    return out


def _flows(edges: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """(node, q array of k): L x, by sums in each task over arrays; x is within HELD numbers and broadcast."""
    found = x.toArrow()
    nodes, values = A.column(found, "node"), A.unlisted(found, "x", k)
    order = np.argsort(nodes)
    shared = edges.sparkSession.sparkContext.broadcast((nodes[order], np.ascontiguousarray(values[order].T)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, values = shared.value
        total = np.zeros_like(values)
        for t in A.chunks(batches, BIN_EDGES):
            u, v, w = np.searchsorted(nodes, A.column(t, "u")), np.searchsorted(nodes, A.column(t, "v")), A.column(t, "w")
            order = np.argsort(u, kind="stable")  # sums of neighbours are near each other
            u, v, w = u[order], v[order], w[order]
            for j in range(k):
                flow = w * (values[j][u] - values[j][v])
                total[j] += np.bincount(u, flow, len(nodes)) - np.bincount(v, flow, len(nodes))
        some = total.any(axis=0)
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), A.lists(total.T[some])], ["node", "q"])

    tasks = 2 * edges.sparkSession.sparkContext.defaultParallelism
    some = edges.select("u", "v", "w")
    some = some.repartition(tasks) if G.is_packed(edges) else some.coalesce(tasks)
    return _array_sum(some.mapInArrow(work, "node long, q array<double>"), ["node"], "q", k)


def residuals(edges: DataFrame, x: DataFrame, y: DataFrame, k: int) -> np.ndarray:
    """Relative residual of each column."""
    x = materialize(x)
    if 0 < x.count() * k <= HELD:
        rows = x.join(y, "node").join(_flows(edges, x, k), "node", "left")
        zero = F.array_repeat(F.lit(0.0), k)
        rows = rows.withColumn("r", F.zip_with("y", F.coalesce("q", zero), lambda a, b: a - b))
        top, bottom = _dots(rows, "r", "r", k), _dots(rows, "y", "y", k)
        return np.sqrt(np.divide(top, bottom, out=np.zeros(k), where=bottom > 0))
    edges = G.rows(edges)
    both = G.adjacency(edges).withColumnsRenamed({"row": "node", "col": "other", "value": "w"})
    sent = both.join(x.select(F.col("node").alias("other"), F.col("x").alias("q")), "other").select("node", F.transform("q", lambda t: t * F.col("w")).alias("q"))
    pulled = _array_sum(sent, ["node"], "q", k)
    rows = x.join(y, "node").join(G.degrees(edges), "node").join(pulled, "node")
    rows = rows.withColumn("r", F.transform(F.arrays_zip("y", "x", "q"), lambda t: t["y"] - (t["x"] * F.col("degree") - t["q"])))
    top, bottom = _dots(rows, "r", "r", k), _dots(rows, "y", "y", k)
    return np.sqrt(np.divide(top, bottom, out=np.zeros(k), where=bottom > 0))


def grounded(x: DataFrame, node: int) -> DataFrame:
    """The solution that is 0 at one node, as of a system without that node's row and column."""
    base = x.where(F.col("node") == node).select("x").first()
    if base is None:
        raise ValueError(f"node {node} has no solution")
    return x.withColumn("x", F.zip_with("x", F.lit([float(v) for v in base["x"]]), lambda a, b: a - b))
