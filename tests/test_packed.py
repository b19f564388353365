"""Packed edges: the supplier graph, grids and solves over them."""

import itertools

import numpy as np
import pytest

from ohmgraph.operators import graph as G
from ohmgraph.operators import leverage, sketch, solver
from ohmgraph.operators.components import materialize
from ohmgraph.operators.multigrid import Multigrid
from ohmgraph.params import library_defaults
from ohmgraph.plans import experiments as X
from ohmgraph.plans import tables as T

from .test_engine import dense, graph
from .test_scale import islands


@pytest.mark.parametrize("shift", [0, 1 << 40])
def test_supplier_graph_of_odd_lines(spark, tmp_path, monkeypatch, shift):
    monkeypatch.setattr(T, "LINES", 7)
    monkeypatch.setattr(T, "AT_ONCE", 5)
    orders = [(1, 2, 2, 3), (2, 1), (5, 5), (None, 4, 9), (7, -3, 1, 2, 12, 5)]
    lines = [(i if i else None, None if s is None else s + shift) for i, order in enumerate(orders) for s in order]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for order in orders[1:]:
        for u, v in itertools.combinations(sorted({s + shift for s in order if s is not None}), 2):
            want[u, v] = want.get((u, v), 0.0) + 1
    assert {(r.u, r.v): r.w for r in T.supplier_graph(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("grid", [X.jl_dim_grid, X.jl_scaling_grid])
def test_a_grid_is_sketched_once_for_both_kinds(spark, monkeypatch, grid):
    df = graph(spark, islands()).cache()
    drawn, solved, wide, solve = [], [], sketch.wide, solver.solve
    monkeypatch.setattr(sketch, "wide", lambda *a, **kw: drawn.append(1) or wide(*a, **kw))
    monkeypatch.setattr(solver, "solve", lambda *a, **kw: solved.append(1) or solve(*a, **kw))
    points = [p.with_(beta_constant=0.3) for p, _ in grid(82)][:4]
    shared = X.Shared(df, 82, points, 0.0)
    got = [sorted(tuple(r) for r in G.rows(shared.kept(p, X.Timer(active=True))).collect()) for p in points]
    assert len(drawn) == 1 and len(solved) == 2
    for p, rows in list(zip(points, got, strict=True))[2:]:
        want = sorted(tuple(r) for r in X.sparsify(df, 82, p).edges.collect())
        assert [r[:2] for r in rows] == [r[:2] for r in want] and np.allclose([r[2] for r in rows], [r[2] for r in want], atol=0)


def test_distances_in_several_passes(spark, monkeypatch):
    df = graph(spark, islands()).cache()
    y = sketch.wide(df, library_defaults(), 7).withColumnRenamed("y", "x").cache()
    monkeypatch.setattr(leverage, "HELD", 60 * 3)
    found = leverage.prefix_norms(materialize(G.packed(df)), y, [2, 3, 7]).collect()
    x = {r.node: np.array(r.x) for r in y.collect()}
    for r in found:
        u, v = np.frombuffer(r.u, np.int64), np.frombuffer(r.v, np.int64)
        for k in (2, 3, 7):
            assert np.allclose(np.frombuffer(r[f"d{k}"]), [np.linalg.norm((x[a] - x[b])[:k]) for a, b in zip(u, v, strict=True)])


def test_columns_are_solved_together(monkeypatch):
    calls, call = [], Multigrid.__call__
    monkeypatch.setattr(Multigrid, "__call__", lambda self, r: calls.append(1) or call(self, r))
    u, v = np.triu_indices(400, 1)
    w, rnd = np.ones(len(u)), np.random.default_rng(0)
    y = rnd.random((400, 20)) * np.logspace(0, -3, 20)
    y[:, 3] = 0
    x, left = solver.solve_pcg(400, u, v, w, y)
    assert len(calls) < 20 and (left < 1e-6).all() and np.allclose(x, (y - y.mean(0)) / 400, atol=1e-8)


@pytest.mark.parametrize("full", [1, 16, 1000])
def test_packed_solves(spark, monkeypatch, full):
    for name, value in {"COLUMN_EDGES": 10, "BIN_EDGES": 60, "PACK": 50, "ROWS": 9, "FULL": full}.items():
        monkeypatch.setattr(solver, name, value)
    edges = islands()
    df = materialize(G.packed(graph(spark, edges)))
    y = materialize(sketch.wide(df, library_defaults(), 5))
    want, rhs = np.linalg.pinv(dense(edges, 82)), np.zeros((82, 5))
    for r in y.collect():
        rhs[r.node] = r.y
    facts = solver.Facts(df)
    assert facts.links == len(edges) and facts.nodes == 57
    for strategy in ("auto", "columns", "dense", "distributed"):
        x = {r.node: r.x for r in solver.solve(df, y, 5, strategy, facts=facts).collect()}
        assert len(x) == 57 and all(np.allclose(got, (want @ rhs)[node], atol=1e-5) for node, got in x.items()), strategy
