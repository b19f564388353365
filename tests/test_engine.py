import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmgraph import cli
from ohmgraph.operators import graph as G
from ohmgraph.operators import leverage, sample, sketch, solver
from ohmgraph.operators import verify as V
from ohmgraph.operators.components import components
from ohmgraph.params import Params, command_line_defaults, library_defaults
from ohmgraph.plans import experiments as X
from ohmgraph.plans import stages as ST
from ohmgraph.plans.sparsify import laplacian_of_file, ready, sparsify, sparsify_dataset, sparsify_stored_laplacian
from ohmgraph.sources import generators as R
from ohmgraph.sources import matrix_market as MM
from ohmgraph.sources import text as TX
from ohmgraph.streaming.resparsify import EdgeStream

EDGES = "u long, v long, w double"


def graph(spark, edges):
    return spark.createDataFrame([(int(u), int(v), float(w)) for u, v, w in edges], EDGES)


def path_with_shortcuts():
    return [(i, i + 1, 1.0) for i in range(99)] + [(10 * i, 10 * i + 9, 1.0) for i in range(10)]


def random_edges(n, m, seed=0):
    rnd = np.random.default_rng(seed)
    pairs = {tuple(sorted(p)) for p in rnd.integers(0, n, (m, 2)).tolist() if p[0] != p[1]}
    return [(u, v, float(w)) for (u, v), w in zip(sorted(pairs), rnd.uniform(0.1, 3, len(pairs)))]


def dense(edges, n):
    lap = np.zeros((n, n))
    for u, v, w in edges:
        lap[u, v] -= w
        lap[v, u] -= w
        lap[u, u] += w
        lap[v, v] += w
    return lap


def as_dense(matrix, n):
    out = np.zeros((n, n))
    for r in matrix.collect():
        out[r.row, r.col] += r.value
    return out


def test_parameters():
    p = library_defaults()
    assert math.isclose(p.beta(1000), 16 * math.log(1000)) and p.jl_dim(1000) == 15 and p.threshold(1000) == 1000 * 111 * 2
    assert command_line_defaults().jl_dim(1000) == 40 and command_line_defaults().sketch == "discrete"
    with pytest.raises(ValueError):
        Params(sketch="other")
    with pytest.raises(ValueError):
        Params(epsilon=0)


def test_laplacian_and_incidence(spark):
    edges = random_edges(30, 120)
    df = graph(spark, edges)
    lap = dense(edges, 30)
    assert np.allclose(as_dense(G.laplacian(df), 30), lap)
    assert V.invalid_laplacian(G.laplacian(df)).count() == 0
    b = {}
    for r in G.incidence(df).collect():
        b.setdefault((r.u, r.v), np.zeros(30))[r.node] = r.value
    m = np.array(list(b.values()))
    assert np.allclose(m.T @ m, lap) and all((x != 0).sum() == 2 for x in m)
    assert G.size_of(df, df).first()[0] == 2 * len(edges) + np.count_nonzero(lap)
    assert np.allclose(as_dense(G.add(G.laplacian(df), G.laplacian(df).withColumn("value", -F.col("value"))), 30), 0)


def test_input_rules(spark):
    raw = graph(spark, [(3, 1, 2.0), (1, 3, 1.0), (2, 2, 5.0), (0, 1, 0.0), (4, 5, -1.0)])
    assert {tuple(r) for r in ready(raw, library_defaults(negative_weights="abs")).collect()} == {(1, 3, 3.0), (4, 5, 1.0)}
    assert {tuple(r) for r in ready(raw, library_defaults(negative_weights="drop")).collect()} == {(1, 3, 3.0)}
    with pytest.raises(Exception, match="negative weight"):
        ready(raw, library_defaults()).collect()
    with pytest.raises(Exception, match="out of bounds"):
        G.check_bounds(raw, 5).collect()


@pytest.mark.parametrize("kind", ["uniform", "discrete", "gaussian"])
def test_sketch_forms_agree(spark, kind):
    edges = graph(spark, random_edges(40, 200))
    p = library_defaults(sketch=kind)
    a = {(r.node, r.j): r.y for r in sketch.long(edges, p, 70).collect()}
    b = {(r.node, j): y for r in sketch.wide(edges, p, 70).collect() for j, y in enumerate(r.y)}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    sums = np.zeros(70)
    for (_, j), y in a.items():
        sums[j] += y
    assert np.abs(sums).max() < 1e-9


def test_solvers_agree(spark):
    edges = random_edges(60, 240) + [(70, 71, 2.0), (71, 72, 0.5)]
    df = graph(spark, edges).cache()
    y = sketch.wide(df, library_defaults(), 5).cache()
    want = np.linalg.pinv(dense(edges, 73))
    rhs = np.zeros((73, 5))
    for r in y.collect():
        rhs[r.node] = r.y
    for strategy in ("dense", "columns", "distributed"):
        x = solver.solve(df, y, 5, strategy)
        for r in x.collect():
            assert np.allclose(r.x, (want @ rhs)[r.node], atol=1e-5), strategy
        assert (solver.residuals(df, x, y, 5) < 1e-6).all()


def test_zero_column_and_hard_graph(spark):
    df = graph(spark, [(i, i + 1, 1.0) for i in range(300)])
    y = df.sparkSession.range(301).select(F.col("id").alias("node"), F.array(F.lit(0.0), (F.col("id") - 150.0)).alias("y"))
    for r in solver.solve(df, y, 2, "columns").collect():
        assert r.x[0] == 0.0
    u, v, w = np.arange(999), np.arange(1, 1000), np.ones(999)
    rhs = np.random.default_rng(0).uniform(-1, 1, (1000, 1))
    _, left = solver.solve_pcg(1000, u, v, w, rhs - rhs.mean())
    assert left[0] < 1e-6


def test_wide_graphs():
    """Graphs on which the diagonal alone takes as many steps as they are wide."""
    rnd = np.random.default_rng(0)
    i = np.arange(9999)
    at = np.arange(316 * 316).reshape(316, 316)
    u, v = np.concatenate((at[:, :-1].ravel(), at[:-1].ravel())), np.concatenate((at[:, 1:].ravel(), at[1:].ravel()))
    uneven = np.exp(3 * rnd.normal(size=len(u)))
    for n, a, b, w in ((10_000, i, i + 1, np.ones(9999)), (316 * 316, u, v, np.ones(len(u))), (316 * 316, u, v, uneven)):
        y = rnd.normal(size=(n, 1))
        x, left = solver.solve_pcg(n, a, b, w, y)
        flow = w * (x[a, 0] - x[b, 0])
        lx = np.bincount(a, flow, n) - np.bincount(b, flow, n)
        assert left[0] < 0.01 and np.linalg.norm(lx - (y[:, 0] - y.mean())) < 0.01 * np.linalg.norm(y)


def test_edge_list_of_several_files(spark, tmp_path):
    """The head in a small first file, parallels over files: as one file in the order of their names."""
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "part-00000").write_text("\n500 1\n")
    (folder / "part-00001").write_text("0 1 5\n")
    (folder / "part-00002").write_text("1 0 9\n" + "".join(f"{i} {i + 1} {i}.5\n" for i in range(1, 400)))
    (folder / "part-00003").write_text("2 1 8\n499 3\n")
    edges, n = TX.read_edge_list(spark, str(folder))
    assert n == 500 and {tuple(r) for r in edges.collect()} == {(0, 1, 5.0), (3, 499, 1.0)} | {(i, i + 1, i + 0.5) for i in range(1, 400)}


def test_leverage(spark):
    edges = random_edges(50, 300)
    df = graph(spark, edges)
    pinv = np.linalg.pinv(dense(edges, 50))
    exact = leverage.exact_resistance(df, 50).collect()
    assert all(abs(r.resistance - (pinv[r.u, r.u] + pinv[r.v, r.v] - 2 * pinv[r.u, r.v])) < 1e-8 for r in exact)
    assert abs(sum(r.w * r.resistance for r in exact) - 49) < 1e-6
    p = library_defaults(jl_factor=30.0)
    got = {(r.u, r.v): r.d * r.d / p.jl_dim(50) for r in leverage.estimate(df, 50, p).collect()}
    ratio = np.array([got[r.u, r.v] / r.resistance for r in exact])
    assert 0.9 < ratio.mean() < 1.1
    d = library_defaults(jl_factor=30.0, sketch="discrete")
    three = {(r.u, r.v): r.d * r.d / d.jl_dim(50) for r in leverage.estimate(df, 50, d).collect()}
    assert 2.7 < np.mean([three[r.u, r.v] / r.resistance for r in exact]) < 3.3


@pytest.mark.parametrize("seed", range(3))
def test_sampling_half(spark, seed):
    edges = random_edges(400, 60000, seed)
    df = graph(spark, edges).withColumn("p", F.lit(0.5))
    made = sample.decide(df, seed)
    s = sample.stats(made).first()
    assert abs(s.original_num_edges / s.final_num_edges - 2) < 0.05
    before, after = (x.agg(F.sum("w")).first()[0] for x in (df, sample.kept(made)))
    assert abs(before / after - math.sqrt(2)) < 0.05
    after = sample.kept(sample.decide(df, seed, "inverse")).agg(F.sum("w")).first()[0]
    assert abs(before / after - 1) < 0.05


def test_sampling_constructed(spark):
    edges = sorted(path_with_shortcuts())
    dropped = {11 * i + 2 + 2 * j for i in range(10) for j in range(5)}
    df = spark.createDataFrame([(u, v, w, 0.0 if i in dropped and i < 109 else 1.0) for i, (u, v, w) in enumerate(edges)], EDGES + ", p double")
    made = sample.decide(df, 1)
    assert V.count_components(df, 100) == 1 and V.count_components(sample.kept(made), 100) == 40
    assert {r.change for r in sample.delta(made).collect()} == {-1.0}


def test_components(spark):
    chain = [(i, i + 1, 1.0) for i in range(0, 60)] + [(100, 101, 1.0), (103, 101, 1.0)]
    got = {r.node: r.component for r in components(graph(spark, chain)).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[103] == got[101] == 100 and len(got) == 64
    assert V.count_components(graph(spark, chain), 200) == 2 + 200 - 64
    assert components(graph(spark, [])).count() == 0
    assert sorted(components(graph(spark, chain), at_once=1000).collect()) == sorted(components(graph(spark, chain), at_once=10).collect())
    assert components(graph(spark, []), at_once=10).count() == 0


def test_sparsify_end_to_end(spark):
    edges = random_edges(120, 6500)
    df = graph(spark, edges)
    out = sparsify(df, 120, library_defaults(epsilon=0.75, beta_constant=1.0, jl_factor=8.0, reweight="inverse"))
    kept = out.edges.cache()
    assert V.added_edges(df, kept).count() == 0 and 0.05 < out.stats.first().sparsification_rate < 0.6
    assert V.count_components(kept, 120) == V.count_components(df, 120) == 1
    s = V.probe_summary(V.probe_errors(df, kept, 50, 0), 0.75).first()
    assert s.upper_bound_violations == s.lower_bound_violations == 0 and s.mean_rel_error < 0.2
    assert V.invalid_laplacian(out.laplacian, 1e-8).count() == 0


def test_probe_bounds_are_inclusive(spark):
    e = spark.createDataFrame([(0, 2.0, 3.0, 0.5), (1, 2.0, 1.0, 0.5), (2, 2.0, 2.0, 0.0)], "probe int, before double, after double, error double")
    s = V.probe_summary(e, 0.5).first()
    assert (s.upper_bound_violations, s.lower_bound_violations) == (1, 1)


def test_differences(spark):
    rows = lambda *x: spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "row long, col long, value double")
    nan = float("nan")
    assert [r.col for r in V.differences(rows(1.0, nan, 2.0, nan), rows(1.0, nan, 2.5, 1.0), 0.1).orderBy("col").collect()] == [2, 3]
    assert V.differences(rows(1.0, 2.0), rows(1.0), 0.1).count() == 1


def test_matrix_market(spark, tmp_path):
    (tmp_path / "g.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n2 1 1.5\n3 3 3\n3 1 2\n")
    matrix, n, kind = MM.read_matrix(spark, str(tmp_path / "g.mtx"))
    assert n == 3 and kind == "real symmetric"
    assert sorted(tuple(r) for r in matrix.collect()) == [(0, 1, 1.5), (0, 2, 2.0), (1, 0, 1.5), (2, 0, 2.0), (2, 2, 3.0)]
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 1\n1 2\n")
    assert MM.read_matrix(spark, str(tmp_path / "p.mtx"))[0].first().value == 1.0
    for single in (False, True):
        MM.write_matrix(matrix, str(tmp_path / "out"), n, single=single)
        assert sorted(MM.read_matrix(spark, str(tmp_path / "out"))[0].collect()) == sorted(matrix.collect())
    assert sorted((r.row, r["values"]) for r in MM.read_dense(spark, str(tmp_path / "g.mtx")).collect()) == [(0, [0.0, 1.5, 2.0]), (1, [1.5, 0.0, 0.0]), (2, [2.0, 0.0, 3.0])]
    with pytest.raises(ValueError):
        (tmp_path / "bad").write_text("1 2\n")
        MM.read_matrix(spark, str(tmp_path / "bad"))


def test_text_sources(spark, tmp_path):
    (tmp_path / "e.txt").write_text("4 9\n\n1 0 2.5\n0 1 9\n2 2 1\n3 2\n")
    edges, n = TX.read_edge_list(spark, str(tmp_path / "e.txt"), 7.0)
    assert n == 4 and {tuple(r) for r in edges.collect()} == {(0, 1, 2.5), (2, 3, 7.0)}
    TX.edge_list_to_matrix_market(spark, str(tmp_path / "e.txt"), str(tmp_path / "e.mtx"))
    assert MM.read_matrix(spark, str(tmp_path / "e.mtx"))[0].count() == 4
    (tmp_path / "d.csv").write_text("1,2\n3,4\n")
    assert {tuple(r) for r in TX.read_dense_csv(spark, str(tmp_path / "d.csv")).collect()} == {(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)}
    (tmp_path / "x.csv").write_text("1,\n3,oops\n")
    assert sum(math.isnan(r.value) for r in TX.read_dense_csv(spark, str(tmp_path / "x.csv"), strict=False).collect()) == 2
    with pytest.raises(Exception, match="not a number"):
        TX.read_dense_csv(spark, str(tmp_path / "x.csv")).collect()
    (tmp_path / "v.csv").write_text("1.5, 2\n")
    assert [r.value for r in TX.read_vector(spark, str(tmp_path / "v.csv")).orderBy("i").collect()] == [1.5, 2.0]
    (tmp_path / "f.csv").write_text("true,false\n")
    assert [r.value for r in TX.read_flags(spark, str(tmp_path / "f.csv")).orderBy("i").collect()] == [True, False]
    with pytest.raises(ValueError):
        TX.read_vector(spark, str(tmp_path / "d.csv"))


def test_stream(spark, tmp_path):
    edges = random_edges(60, 3000)
    graph(spark, edges).repartition(4).write.parquet(str(tmp_path / "in"))
    p = library_defaults(epsilon=0.75, beta_constant=1.0, jl_factor=4.0, reweight="inverse")
    state = EdgeStream(spark, f"file://{tmp_path}/state", 60, p, threshold=500)
    stream = spark.readStream.schema(EDGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state.start(stream, str(tmp_path / "progress")).awaitTermination()
    held = state.current()
    assert 0 < held.count() < len(edges) and V.added_edges(graph(spark, edges), held).count() == 0
    assert V.count_components(held, 60) == 1
    before = sorted(held.collect())
    last = state._versions()[-1]
    state.absorb(spark.createDataFrame([], EDGES), last + 1)
    state.absorb(spark.createDataFrame([], EDGES), last + 1)  # a retry changes nothing
    assert len(before) >= state.current().count() > 0


def test_dataset_and_cli(spark, tmp_path, capsys):
    matrix = G.adjacency(graph(spark, random_edges(30, 200)))
    MM.write_matrix(matrix, str(tmp_path / "g.mtx"), 30)
    out = sparsify_dataset(spark, str(tmp_path / "g.mtx"), output=str(tmp_path / "o.mtx"))
    assert V.invalid_laplacian(MM.read_matrix(spark, str(tmp_path / "o.mtx"))[0], 1e-8).count() == 0
    assert out.stats.first().final_num_edges > 0
    assert cli.main(["-i", str(tmp_path / "g.mtx"), "-e", "0.5", "-b"], spark) == 0
    assert "kept" in capsys.readouterr().out


def test_experiment_row(spark):
    row, _ = X.run_point("g", graph(spark, random_edges(20, 80)), 20, library_defaults(), probes=5)
    want = ["dataset", "epsilon", "sketch_type", "evim_time", "jl_time", "solve_time", "diff_norm_time", "reweight_time", "cc_success", "upper_bound_violations", "lower_bound_violations", "mean_rel_error", "std_dev_rel_error", "max_rel_error", "sparsification_rate"]
    assert list(row.asDict()) == want and row.cc_success
    assert [len(list(g)) for g in (X.basic_grid(), X.jl_scaling_grid(20), X.jl_dim_grid(20), X.space_grid())] == [6, 8, 6, 2]


def test_generators(spark):
    g = R.path_with_shortcuts(spark)
    assert sorted(tuple(r) for r in g.collect()) == sorted(path_with_shortcuts())
    m = R.random_matrix(spark, 103, 91, 900, 1).collect()
    assert 800 < len(m) <= 900 and all(0 <= r.row < 103 and 0 <= r.col < 91 and abs(r.value) < 1 for r in m)
    assert all(r.row > r.col for r in R.random_matrix(spark, 40, 40, 300, 2, strict_lower=True).collect())
    b = R.random_incidence(spark, 50, 200, 3).groupBy("edge").agg(F.count("*").alias("n"), F.countDistinct("node").alias("d"), F.sum("value").alias("s")).collect()
    assert len(b) == 200 and all(r.n == r.d == 2 and r.s == 0 for r in b)
    assert abs(R.random_vector(spark, 100, 4, zero_sum=True).agg(F.sum("x")).first()[0]) < 1e-9
    assert R.random_edges(spark, 30, 200, 5).where("u >= v or w <= 0").count() == 0


def test_stored_laplacian_and_grounding(spark, tmp_path):
    edges = random_edges(30, 200)
    df = graph(spark, edges)
    MM.write_matrix(G.adjacency(df), str(tmp_path / "g.mtx"), 30)
    MM.write_matrix(laplacian_of_file(spark, str(tmp_path / "g.mtx"), library_defaults()), str(tmp_path / "l.mtx"), 30)
    got = sparsify_stored_laplacian(spark, str(tmp_path / "l.mtx"), library_defaults(beta_constant=1000.0)).edges.collect()
    assert {(r.u, r.v) for r in got} == {(u, v) for u, v, _ in edges}
    y = sketch.wide(df, library_defaults(), 2)
    x = {r.node: r.x for r in solver.grounded(solver.solve(df, y, 2, "dense"), 29).collect()}
    rhs = np.array([r.y for r in y.orderBy("node").collect()])
    want = np.linalg.solve(dense(edges, 30)[:29, :29], rhs[:29])
    assert x[29] == [0.0, 0.0] and all(np.allclose(x[i], want[i]) for i in range(29))


def test_config_file(tmp_path):
    (tmp_path / "c.toml").write_text('epsilon = 0.25\nsketch-seed = 7\n')
    a = cli._arguments(["--config", str(tmp_path / "c.toml"), "--sketch-seed", "9"])
    assert (a.epsilon, a.sketch_seed, a.jl_factor) == (0.25, 9, 4.0)


def test_ordinals(spark):
    edges = random_edges(60, 500)
    got = G.ordinals(graph(spark, edges).repartition(7)).collect()
    assert {(r.u, r.v): r.ordinal for r in got} == {(u, v): i for i, (u, v, _) in enumerate(sorted(edges))} and len(got) == len(edges)
    assert G.ordinals(graph(spark, [])).count() == 0
    inc = G.incidence_by_ordinal(G.ordinals(graph(spark, edges))).collect()
    want = {(i, x): s * math.sqrt(w) for i, (u, v, w) in enumerate(sorted(edges)) for x, s in ((u, -1), (v, 1))}
    assert {(r.edge, r.node): r.value for r in inc} == want


def test_stage_files(spark, tmp_path):
    edges = [(u, v, w) for u, v, w in random_edges(40, 300)]
    p = library_defaults(epsilon=0.75, beta_constant=1.0, reweight="inverse")
    n = 42  # two nodes without edges
    ST.write_stages(graph(spark, edges), n, p, f"file://{tmp_path}")
    got = ST.read_stages(spark, f"file://{tmp_path}")
    tables = {name: np.zeros((300 if name == "incidence" else n, n if name in ("laplacian", "incidence") else p.jl_dim(n))) for name in ("laplacian", "incidence", "sketch", "solution")}
    for name, a in tables.items():
        for r in got[name].collect():
            a[r.row, r.col] = r.value
    lap = dense(edges, n)
    assert np.allclose(tables["laplacian"], lap) and np.allclose(tables["incidence"].T @ tables["incidence"], lap)
    assert np.allclose(lap @ tables["solution"], tables["sketch"], atol=1e-6) and not tables["solution"][40:].any()
    kept = {(r.u, r.v) for r in got["edges"].collect() if r.kept}
    assert kept == {(r.u, r.v) for r in sparsify(graph(spark, edges), n, p).edges.collect()} and 0 < len(kept) < len(edges)


def test_cut_change(spark):
    sides = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "node long, side int")
    a, b = graph(spark, [(0, 1, 2), (1, 2, 3), (0, 2, 9)]), graph(spark, [(0, 1, 4)])
    assert tuple(V.cut_change(a, b, sides).first()) == (10.0, 8.0, 0.8)
    assert tuple(V.cut_change(graph(spark, [(0, 2, 1)]), graph(spark, []), sides).first()) == (0.0, 0.0, None)
