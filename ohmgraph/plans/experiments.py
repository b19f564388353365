"""Experiment grids: each point sparsifies, checks components and probes, and gives one result row."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import graph as G
from ..operators import leverage, sample, sketch, solver
from ..operators import verify as V
from ..operators.components import materialize
from ..operators.solver import Facts
from ..params import Params, library_defaults
from ..sources import matrix_market as MM
from ..sources.text import append_result
from .sparsify import STAGES, Result, Timer, ready, sparsify

SKETCHES = ("uniform", "discrete")
_BASE = Params(jl_factor=4.0, sketch_seed=0, sampling_seed=0)


def known(edges: DataFrame, n: int, probes: int) -> tuple[DataFrame, int]:
    """What all points of a grid compare with: the forms of its graph's probes, and the number of its components."""
    return materialize(V.forms(edges, probes, seed=0)), V.count_components(edges, n)


class Shared:
    """New weights of a grid's edges, found once for the points of one kind of sketch.

    A column of a sketch doesn't depend on how many there are, and sketch and solution are proportional to the scaling. So
    each kind is sketched and solved once, with the most columns of its points and the greatest scaling, so that no point's
    residuals are above the solver's bounds; each point takes its share of the distances. Edges are packed. The times of a
    row's stages are those of the stages that its point shares."""

    def __init__(self, edges: DataFrame, n: int, points: Iterable[Params], forming: float):
        self.edges, self.n, self.forming, self.points = G.packed(edges), n, forming, list(dict.fromkeys(points))
        if not G.is_packed(edges):
            self.edges = materialize(self.edges)
        self.facts = Facts(self.edges)
        self.most: dict[Params, Params] = {}
        for p in self.points:
            old = self.most.get(self.kind(p), p)
            self.most[self.kind(p)] = p if abs(p.jl_scaling) > abs(old.jl_scaling) else old
        self.found: dict[tuple, tuple[DataFrame, dict[Params, int], dict[str, float]]] = {}
        self.sketches: dict[Params, tuple[DataFrame, int, float]] = {}

    def kind(self, p: Params) -> Params:
        """All that sketch and solution depend on but for the scaling; the factor as the number of columns."""
        return Params(jl_factor=p.jl_dim(self.n), sketch=p.sketch, sketch_seed=p.sketch_seed, hash_flavour=p.hash_flavour, strategy=p.strategy)

    def family(self, p: Params) -> tuple:
        """All that points of one table of new weights have in common."""
        return self.kind(p).with_(jl_factor=1.0), p.sampling_seed

    def _family(self, family: tuple) -> tuple[DataFrame, dict[Params, int], dict[str, float]]:
        points, timer = [p for p in self.points if self.family(p) == family], Timer(active=True, seconds={"evim": self.forming})
        most, ks = max(points, key=lambda p: abs(p.jl_scaling)), sorted({p.jl_dim(self.n) for p in points})
        y, timer.seconds["jl"] = self._sketch(family[0], ks[-1])
        with timer.stage("solve"):
            x = timer.held(solver.solve(self.edges, y, ks[-1], most.strategy, facts=self.facts))
        with timer.stage("diff_norm"):
            found = timer.held(leverage.prefix_norms(self.edges, x, ks))
        with timer.stage("reweight"):
            scale = lambda p: 1.0 if p.sketch == "gaussian" or p.jl_scaling == most.jl_scaling else abs(p.jl_scaling / most.jl_scaling)
            shares = [(p.jl_dim(self.n), scale(p), p.beta(self.n), float(p.jl_dim(self.n)), p.reweight) for p in points]
            chosen = timer.held(sample.decide_packed(found, shares, family[1], most.hash_flavour))
        return chosen, {p: i for i, p in enumerate(points)}, timer.seconds

    def _sketch(self, kind: Params, k: int) -> tuple[DataFrame, float]:
        """Sketch of a family with k columns, and the seconds it took: families of the same bits are sketched together."""
        if kind not in self.sketches:
            like: dict[Params, list[Params]] = {}
            for p in self.points:
                if sketch.same_bits(p) == sketch.same_bits(kind):
                    like.setdefault(self.family(p)[0], []).append(p)
            most = [max(some, key=lambda p: abs(p.jl_scaling)) for some in like.values()]
            top, timer = max(p.jl_dim(self.n) for some in like.values() for p in some), Timer(active=True)
            edges = self.facts.handy
            with timer.stage("jl"):
                if kind.sketch == "gaussian":
                    most = most[:1]
                y = timer.held(sketch.wide(edges, most[0], top, most[1:]))
            for i, one in enumerate(like):
                place = 0 if kind.sketch == "gaussian" else i
                self.sketches[one] = y, place * top, timer.seconds["jl"]
        y, start, seconds = self.sketches[kind]
        return y.select("node", F.slice("y", start + 1, k).alias("y")), seconds

    def kept(self, p: Params, timer: Timer) -> DataFrame:
        """Kept edges of a point, packed."""
        if self.family(p) not in self.found:
            self.found[self.family(p)] = self._family(self.family(p))
        chosen, at, seconds = self.found[self.family(p)]
        timer.seconds |= seconds
        return sample.share(chosen, at[p])

    def sparsify(self, p: Params, timer: Timer) -> Result:
        """The point's result; of an edge that is not kept there is u, v and w alone."""
        self.kept(p, timer)
        chosen, at, _ = self.found[self.family(p)]
        i = at[p]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in A.plain(batches):
                new = t.column(f"n{i}").to_numpy()
                yield pa.RecordBatch.from_arrays([*[t.column(c) for c in "uvw"], pa.array(new != 0), pa.array(new, mask=new == 0)], ["u", "v", "w", "kept", "new_w"])

        return Result(chosen.mapInArrow(work, "u long, v long, w double, kept boolean, new_w double"), self.n, p, timer)


def run_point(name: str, edges: DataFrame, n: int, p: Params, probes: int = 100, original: tuple[DataFrame, int] | None = None, shared: Shared | None = None, **extra) -> tuple[Row, DataFrame]:
    """(result row, kept edges). original: what is known of edges, found here where it is not given; shared: of a grid."""
    timer = Timer(active=True)
    out = shared.sparsify(p, timer) if shared else sparsify(edges, n, p, timer)
    kept = shared.kept(p, timer) if shared else out.edges  # of a table
    before, parts = original or known(edges, n, probes)
    checks = V.probe_summary(V.form_errors(before, V.forms(kept, probes, seed=0)), p.epsilon).first()
    same = parts == V.count_components(kept, n)
    rate = G.count(kept) / shared.facts.links if shared and shared.facts.links else out.stats.first()["sparsification_rate"]
    times = {f"{x}_time": timer.seconds[x] for x in STAGES}
    row = Row(dataset=name, epsilon=p.epsilon, sketch_type=p.sketch, **extra, **times, cc_success=same, **checks.asDict(), sparsification_rate=rate)
    return row, out.edges


def basic_grid() -> Iterator[tuple[Params, dict]]:
    for epsilon in (0.75, 0.5, 0.25):
        for kind in SKETCHES:
            yield _BASE.with_(epsilon=epsilon, sketch=kind), {}


def jl_scaling_grid(n: int) -> Iterator[tuple[Params, dict]]:
    k = _BASE.jl_dim(n)
    for scaling in (math.sqrt(3), 1 / math.sqrt(3), 1 / math.sqrt(k), math.sqrt(k)):
        for kind in SKETCHES:
            yield _BASE.with_(jl_scaling=scaling, sketch=kind), {"jl_scaling_factor": scaling}


def jl_dim_grid(n: int) -> Iterator[tuple[Params, dict]]:
    for factor in (1.5, 4.0, 10.0):
        for kind in SKETCHES:
            p = _BASE.with_(jl_factor=factor, sketch=kind)
            yield p, {"jl_factor": factor, "jl_scaling_factor": p.jl_scaling, "jl_dim": p.jl_dim(n)}


def space_grid() -> Iterator[tuple[Params, dict]]:
    for kind in SKETCHES:
        yield _BASE.with_(epsilon=0.25, sketch=kind), {}


def run_grid(spark: SparkSession, name: str, edges: DataFrame, n: int, grid: Iterable[tuple[Params, dict]], probes: int = 100, results: str | None = None, laplacians: str | None = None) -> DataFrame:
    """All points of a grid; results appends rows to a table, laplacians writes each result's matrix to a folder. Packed edges
    must be ready: u < v, no parallel ones, weights above 0."""
    timer, points = Timer(active=True), list(grid)
    raw = edges if G.is_packed(edges) else materialize(edges)
    with timer.stage("evim"):
        held = materialize(raw if G.is_packed(edges) else G.packed(ready(raw, _BASE)))
    original = known(held, n, probes)
    shared = Shared(held, n, [p for p, _ in points], timer.seconds["evim"])
    rows, plain = [], G.rows(held)
    for i, (p, extra) in enumerate(points):
        row, kept = run_point(name, plain, n, p, probes, original=original, shared=shared, **extra)
        rows.append(row)
        if results:
            append_result(spark.createDataFrame([row]), results)
        if laplacians:
            MM.write_matrix(G.laplacian(kept), f"{laplacians}/{name}_static_{i}_{p.sketch}.mtx", n)
    return spark.createDataFrame(rows)


def dataset_stats(name: str, edges: DataFrame, n: int, notes: str = "") -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("num_edges")).select(F.lit(name).alias("dataset"), F.lit(n).cast("long").alias("num_nodes"), "num_edges", F.lit(notes).alias("notes"))


def space_use_simple(edges: DataFrame, n: int) -> DataFrame:
    """Entries of the Laplacian alone, and whether a zero right-hand side gives a zero solution (it does)."""
    return G.size_of(edges.limit(0), edges)


def total_runtime(results: DataFrame) -> DataFrame:
    """results with the sum of the five stage times, and the average number of edges a node where known."""
    return results.withColumn("total_runtime", sum(F.col(f"{x}_time") for x in STAGES))


def library_run(edges: DataFrame, n: int, **changes) -> DataFrame:
    return sparsify(edges, n, library_defaults(**changes)).edges
