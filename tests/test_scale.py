"""Work over arrays: hashes as columns and as arrays, solves by component, rows packed."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmgraph.functions import arrays as A
from ohmgraph.functions import hashing as H
from ohmgraph.operators import leverage, sketch, solver
from ohmgraph.operators import verify as V
from ohmgraph.operators.components import components, forest
from ohmgraph.params import library_defaults
from ohmgraph.plans import experiments as X

from .test_engine import dense, graph, random_edges


@pytest.mark.parametrize("flavour", ["md5", "xx"])
def test_array_hashes_are_those_of_columns(spark, flavour):
    pairs = [(0, 9), (10, 99999), (-5, 1 << 62), ((1 << 63) - 1, -(1 << 63)), (7, 123456789)]
    df = spark.createDataFrame(pairs, "u long, v long")
    u, v = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    for seed in (0, 3, 1 << 40):
        got = A.bits32("a role that is long", [-2], [u, v], [0, 10, 4000], seed, flavour)
        want = [H.bits32("a role that is long", F.lit(-2), F.col("u"), F.col("v"), F.lit(j), seed=seed, flavour=flavour) for j in (0, 10, 4000)]
        assert got.T.tolist() == [list(r) for r in df.select(*want).collect()]
        one = H.bits32("pr", F.lit(1), F.col("u"), seed=seed, flavour=flavour)
        assert A.bits32("pr", [1], [u], [None], seed, flavour)[0].tolist() == [r[0] for r in df.select(one).collect()]


def test_md5_of_every_length():
    for n in range(1, 19):
        x = np.array([10 ** (n - 1), 10**n - 1], dtype=np.int64)
        got = A.bits32("sk", [], [x, x], [5], 1, "md5")[0]
        assert got.tolist() == [int(hashlib.md5(f"sk,{t},{t},5,1".encode()).hexdigest()[:8], 16) for t in x]


def islands():
    """Components of 40, 12, 3 and 2 nodes."""
    edges = random_edges(40, 160)
    edges += [(u + 50, v + 50, w) for u, v, w in random_edges(12, 30)] + [(70, 71, 2.0), (71, 72, 0.5), (80, 81, 1.0)]
    return edges


@pytest.mark.parametrize("limits", [{"COLUMN_EDGES": 10, "BIN_EDGES": 20}, {"COLUMN_EDGES": 10, "DENSE_NODES": 12, "HELD": 120, "PACK": 50, "STEP": 7}])
def test_solves_by_component(spark, monkeypatch, limits):
    for name, x in limits.items():
        monkeypatch.setattr(solver, name, x)
    edges = islands()
    df = graph(spark, edges).cache()
    y = sketch.wide(df, library_defaults(), 5).cache()
    want, rhs = np.linalg.pinv(dense(edges, 82)), np.zeros((82, 5))
    for r in y.collect():
        rhs[r.node] = r.y
    nodes = {x for u, v, _ in edges for x in (u, v)}
    for strategy in ("auto", "dense", "columns", "distributed"):
        x = {r.node: r.x for r in solver.solve(df, y, 5, strategy).collect()}
        assert x.keys() == nodes
        for node, got in x.items():
            assert np.allclose(got, (want @ rhs)[node], atol=1e-5), strategy


def test_vectors_in_tables(spark, monkeypatch):
    """More nodes than the driver holds."""
    monkeypatch.setattr(solver, "HELD", 2)
    edges = [(0, 1, 1.0), (1, 2, 2.0), (5, 6, 0.5)]
    df = graph(spark, edges)
    y = sketch.wide(df, library_defaults(), 2).cache()
    assert (solver.residuals(df, solver.solve(df, y, 2, "distributed"), y, 2) < 1e-6).all()


def test_a_step_of_packed_rows():
    rnd = np.random.default_rng(0)
    a = rnd.random((30, 40)) * (rnd.random((30, 40)) < 0.5)
    a[3] = 1.0
    row, col = np.nonzero(a)
    rows, start = np.unique(row, return_index=True)
    p = rnd.random((40, 3))
    for step in (1, 7, 64, 10_000):
        solver.STEP, old = step, solver.STEP
        try:
            assert np.allclose(solver._times(rows, start, col, a[row, col], p), (a @ p)[rows])
        finally:
            solver.STEP = old


def test_distances_broadcast_and_joined_agree(spark, monkeypatch):
    df = graph(spark, islands()).withColumn("more", F.col("u") + 1)
    x = spark.range(75).select(F.col("id").alias("node"), F.array(F.sqrt("id"), F.lit(1.0) / (F.col("id") + 1)).alias("x"))
    got = sorted(leverage.diff_norms(df, x).collect())
    monkeypatch.setattr(leverage, "HELD", 0)
    want = sorted(leverage.diff_norms(df, x).select(*df.columns, "d").collect())
    assert [tuple(r)[:-1] for r in got] == [tuple(r)[:-1] for r in want] and np.allclose([r.d for r in got], [r.d for r in want])


def test_sums_let_go_and_forests_keep_components(spark, monkeypatch):
    monkeypatch.setattr(sketch, "EDGES", 8)
    monkeypatch.setattr(sketch, "HELD", 40)
    df = graph(spark, islands()).repartition(3).cache()
    p = library_defaults()
    a = {(r.node, r.j): r.y for r in sketch.long(df, p, 5).collect()}
    b = {(r.node, j): y for r in sketch.wide(df, p, 5).collect() for j, y in enumerate(r.y)}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    links = forest(df, 8)
    assert sorted(components(links).collect()) == sorted(components(df.select("u", "v")).collect())
    assert V.count_components(df, 82) == 4 + 82 - 57


def test_forms_are_those_of_columns(spark):
    df = graph(spark, islands())
    for flavour in ("xx", "md5"):
        got = {r.probe: r.value for r in V.forms(df, 3, 4, flavour).collect()}
        x = V.probe_vectors(df, 3, 4, flavour).collect()
        at = {(r.probe, r.node): r.x for r in x}
        for i in range(3):
            assert abs(got[i] - sum(w * (at[i, u] - at[i, v]) ** 2 for u, v, w in islands())) < 1e-9


def test_a_grid_checks_its_graph_once(spark, monkeypatch):
    seen = []
    count, forms = V.count_components, V.forms
    monkeypatch.setattr(V, "count_components", lambda e, n=None: seen.append("components") or count(e, n))
    monkeypatch.setattr(V, "forms", lambda *a, **kw: seen.append("forms") or forms(*a, **kw))
    p = library_defaults()
    rows = X.run_grid(spark, "g", graph(spark, islands()), 82, [(p, {}), (p, {})], probes=5).collect()
    assert len(rows) == 2 and seen.count("forms") == seen.count("components") == 3
    alone, _ = X.run_point("g", graph(spark, islands()), 82, p, probes=5)
    skip = {f"{s}_time" for s in X.STAGES}
    want = {k: v for k, v in alone.asDict().items() if k not in skip}
    for r in rows:
        assert {k: pytest.approx(v) for k, v in r.asDict().items() if k not in skip} == want


def test_residuals_of_wrong_solutions(spark, monkeypatch):
    df = graph(spark, islands()).cache()
    y = sketch.wide(df, library_defaults(), 3).cache()
    x = y.select("node", F.transform("y", lambda t: t * 0.3).alias("x")).cache()
    got = solver.residuals(df, x, y, 3)
    monkeypatch.setattr(solver, "HELD", 0)
    assert np.allclose(got, solver.residuals(df, x, y, 3)) and (got > 0.1).all()
    assert solver.residuals(df, x.withColumn("x", F.transform("x", lambda t: t * 0)), y, 3).max() == pytest.approx(1.0)


def test_points_that_differ_in_scaling_share_a_solve(spark, monkeypatch):
    df = graph(spark, islands()).cache()
    solved, solve = [], solver.solve
    monkeypatch.setattr(solver, "solve", lambda edges, y, k, *a, **kw: solved.append(k) or solve(edges, y, k, *a, **kw))
    points = list(X.jl_scaling_grid(82))
    rows = X.run_grid(spark, "g", df, 82, points, probes=5).collect()
    assert len(solved) == 2 and len(rows) == len(points)
    skip = {f"{s}_time" for s in X.STAGES}
    assert all(r[s] > 0 for r in rows for s in skip)
    p, extra = points[2]
    alone = X.run_point("g", df, 82, p, probes=5, **extra)[0].asDict()
    assert {k: pytest.approx(v) for k, v in rows[2].asDict().items() if k not in skip} == {k: v for k, v in alone.items() if k not in skip}
    assert [len(X.Shared(df, 82, [p for p, _ in grid], 0.0).most) for grid in (X.basic_grid(), X.jl_dim_grid(82))] == [2, 6]


def test_every_scaling_gives_the_edges_of_a_run_alone(spark):
    df = graph(spark, islands()).cache()
    for kind in ("uniform", "discrete", "gaussian"):
        points = [library_defaults(sketch=kind, jl_scaling=x, beta_constant=0.3) for x in (0.2, 1.7, -0.9, 0.0)]
        shared = X.Shared(df, 82, points, 0.0)
        for p in points:
            got, want = (sorted(tuple(r) for r in x.edges.collect()) for x in (shared.sparsify(p, X.Timer(active=True)), X.sparsify(df, 82, p)))
            assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=0)


@pytest.mark.parametrize("at_once", [V.AT_ONCE, 20, 0])
def test_components_counted_on_the_driver_or_not(spark, monkeypatch, at_once):
    monkeypatch.setattr(V, "AT_ONCE", at_once)
    assert V.count_components(graph(spark, islands()), 90) == 4 + 90 - 57
    assert V.count_components(graph(spark, []), 7) == 7


def test_solves_of_a_grid_find_its_components_once(spark, monkeypatch):
    df = graph(spark, islands()).cache()
    found, owners = [], solver._owners
    monkeypatch.setattr(solver, "COLUMN_EDGES", 10)
    monkeypatch.setattr(solver, "_owners", lambda edges: found.append(edges) or owners(edges))
    points = [library_defaults(jl_factor=x, beta_constant=0.3) for x in (0.5, 1.0, 2.0)]
    shared = X.Shared(df, 82, points, 0.0)
    got = [sorted(tuple(r) for r in shared.sparsify(p, X.Timer(active=True)).edges.collect()) for p in points]
    assert len(found) == 1
    for p, rows in zip(points, got, strict=True):
        want = sorted(tuple(r) for r in X.sparsify(df, 82, p).edges.collect())
        assert [r[:2] for r in rows] == [r[:2] for r in want] and np.allclose([r[2] for r in rows], [r[2] for r in want], atol=0)
