"""Queries of the catalog over whole small tables, against brute force."""

import itertools

import pytest
from pyspark.sql import Row

from ohmgraph.operators import verify as V
from ohmgraph.plans import catalog


def tables(spark, folder, suppliers, orders):
    """supplier and lineitem tables; orders: the suppliers of each order."""
    spark.createDataFrame([(i,) for i in range(suppliers)], "s_suppkey long").write.parquet(f"{folder}/supplier.parquet")
    lines = [(i, s) for i, order in enumerate(orders) for s in order]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("at_once", [V.AT_ONCE, 0])
def test_components_of_every_edge(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(V, "AT_ONCE", at_once)
    orders = [(i, i + 1) for i in range(3, 17)] + [(20, 25, 22), (25, 28), (30, 31), (30, 31), (33, 33)]
    d = tables(spark, tmp_path, 40, orders)
    want = list(range(40))
    for _ in want:
        for order in orders:
            low = min(want[s] for s in order)
            want = [low if x in {want[s] for s in order} else x for x in want]
    got = {r.node: r.component for r in catalog.connected_components(spark, d).collect()}
    assert got == dict(enumerate(want))


def test_grounding_drops_only_the_last_node(spark, tmp_path):
    orders = [(i, (7 * i + 1) % 30) for i in range(30)] + [(3, 29, 14), (28, 29)]
    d = tables(spark, tmp_path, 30, orders)
    want = {}
    for order in orders:
        for u, v in itertools.permutations(set(order), 2):
            want[u, v] = want.get((u, v), 0) - 1
            want[u, u] = want.get((u, u), 0) + 1
    got = {(r.row, r.col): r.value for r in catalog.grounded_laplacian(spark, d).collect()}
    assert got == {k: x for k, x in want.items() if max(k) < 29}


@pytest.mark.parametrize("name", ["basic", "jl_dim", "jl_scaling"])
def test_experiments_run_on_all_suppliers(spark, tmp_path, monkeypatch, name):
    d = tables(spark, tmp_path, 30, [(0, 1, 2), (27, 29), (5, 28)])
    seen = []

    def run_point(dataset, edges, n, p, probes=100, **extra):
        seen.append((dataset, edges.count(), n, probes, extra.get("jl_dim", p.jl_dim(30)) == p.jl_dim(30)))
        return Row(dataset=dataset), edges

    monkeypatch.setattr(catalog.X, "run_point", run_point)
    assert getattr(catalog, f"experiment_{name}")(spark, d).count() == len(seen) > 5
    assert set(seen) == {("supplier", 5, 30, 100, True)}
