"""The whole sparsification, with stage times."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import leverage, sample, sketch, solver
from ..operators.components import materialize
from ..params import Params, command_line_defaults
from ..sources import matrix_market as MM

STAGES = ("evim", "jl", "solve", "diff_norm", "reweight")


@dataclass
class Timer:
    """Seconds by stage; only an active timer makes a stage compute its result on its own."""

    active: bool = False
    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        yield
        self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def held(self, df: DataFrame) -> DataFrame:
        return materialize(df) if self.active else df

    @property
    def total(self) -> float:
        return sum(self.seconds.get(x, 0.0) for x in STAGES)


@dataclass
class Result:
    decided: DataFrame
    n: int
    params: Params
    timer: Timer

    @property
    def edges(self) -> DataFrame:
        return sample.kept(self.decided)

    @property
    def laplacian(self) -> DataFrame:
        return G.laplacian(self.edges)

    @property
    def delta(self) -> DataFrame:
        return sample.delta(self.decided)

    @property
    def stats(self) -> DataFrame:
        return sample.stats(self.decided)


def ready(edges: DataFrame, p: Params) -> DataFrame:
    """Canonical edges with parallel ones added up and weights checked."""
    return G.check_weights(G.coalesced(G.canonical(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w")))), p.negative_weights)


def sparsify(edges: DataFrame, n: int, p: Params, timer: Timer | None = None) -> Result:
    """Sketch all current edges, solve, sample by leverage, and give the kept edges new weights.

    The edge table is scanned several times, and later stages need its exact rows, so it is written once.
    """
    timer = timer or Timer()
    with timer.stage("evim"):
        held = materialize(ready(edges, p))
    return decided(rated(held, n, p, timer), n, p, timer)


def rated(held: DataFrame, n: int, p: Params, timer: Timer, facts: solver.Facts | None = None) -> DataFrame:
    """Edges that are ready with d, the distance of their endpoints: sketch, solve and distances."""
    k = p.jl_dim(n)
    with timer.stage("jl"):
        y = timer.held(sketch.wide(held, p, k))
    with timer.stage("solve"):
        x = timer.held(solver.solve(held, y, k, p.strategy, facts=facts))
    with timer.stage("diff_norm"):
        return timer.held(leverage.diff_norms(held, x))


def decided(found: DataFrame, n: int, p: Params, timer: Timer) -> Result:
    """What is kept of edges with d."""
    with timer.stage("reweight"):
        chosen = timer.held(sample.decide(leverage.probabilities(found, p.beta(n), p.jl_dim(n)), p.sampling_seed, p.reweight, p.hash_flavour))
    return Result(chosen, n, p, timer)


def sparsify_dataset(spark: SparkSession, path: str, epsilon: float = 0.5, output: str | None = None, params: Params | None = None, timer: Timer | None = None) -> Result:
    """A Matrix Market graph; with output, the Laplacian of the result is written there."""
    p = params or command_line_defaults(epsilon=epsilon)
    matrix, n, _ = MM.read_matrix(spark, path)
    out = sparsify(G.upper_triangle(matrix), n, p, timer)
    if output:
        MM.write_matrix(out.laplacian, output, n)
    return out


def sparsify_stored_laplacian(spark: SparkSession, path: str, params: Params, timer: Timer | None = None) -> Result:
    """As sparsify, for a file that holds a Laplacian."""
    matrix, n, _ = MM.read_matrix(spark, path)
    return sparsify(G.edges_of_laplacian(matrix), n, params, timer)


def laplacian_of_file(spark: SparkSession, path: str, params: Params) -> DataFrame:
    """The Laplacian of a graph file, without sparsification."""
    matrix, _, _ = MM.read_matrix(spark, path)
    return G.laplacian(ready(G.upper_triangle(matrix), params))
