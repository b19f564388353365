"""Named queries over the sample tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import graph as G
from ..operators import leverage, sample, sketch, solver
from ..operators import verify as V
from ..operators.components import materialize, shared_dir
from ..params import Params, command_line_defaults, library_defaults
from ..sources import generators as GEN
from ..sources import matrix_market as MM
from ..sources import text as TX
from ..streaming.resparsify import EdgeStream
from . import experiments as X
from . import stages as ST
from . import tables as T
from .sparsify import sparsify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Parameters of queries with an oracle: hashes that other SQL engines have; few columns; strong sampling.
P = Params(epsilon=0.75, beta_constant=1.0, sketch_seed=3, sampling_seed=5, hash_flavour="md5")
K, PROBES = 4, 8


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(x) -> Column:
    return F.round(x, 6) + F.lit(0.0)


def n_suppliers(spark: SparkSession, sf_dir: str) -> int:
    return T.read(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] + 1


# --- ingest ------------------------------------------------------------------

@query(f"WITH {T.G} SELECT u, v, w FROM g")
def supplier_edges(spark, d):
    return T.supplier_graph(spark, d)


@query(f"WITH {T.RAW} SELECT least(u, v) AS u, greatest(u, v) AS v, w, ord FROM raw WHERE u <> v AND w <> 0")
def canonical_edges(spark, d):
    return G.canonical(T.supplier_pairs(spark, d))


@query(f"WITH {T.RAW} SELECT least(u, v) AS u, greatest(u, v) AS v, sum(w) AS w FROM raw WHERE u <> v AND w <> 0 GROUP BY 1, 2 HAVING sum(w) <> 0")
def coalesced_edges(spark, d):
    return G.coalesced(G.canonical(T.supplier_pairs(spark, d)))


@query(f"WITH {T.RAW} SELECT least(u, v) AS u, greatest(u, v) AS v, arg_min(w, ord) AS w FROM raw WHERE u <> v AND w <> 0 GROUP BY 1, 2")
def first_weight_wins(spark, d):
    return G.first_wins(T.supplier_pairs(spark, d), "ord")


@query(f"WITH {T.NATION} SELECT u, v, w FROM nn WHERE u < v")
def upper_triangle(spark, d):
    return G.upper_triangle(T.nation_graph(spark, d).selectExpr("u AS row", "v AS col", "w AS value"))


@query(f"WITH {T.NATION} SELECT least(u, v) AS u, greatest(u, v) AS v, sum(w) AS w FROM nn WHERE u <> v GROUP BY 1, 2")
def nation_edges(spark, d):
    return G.coalesced(G.canonical(T.nation_graph(spark, d)))


@query(f"WITH {T.G} SELECT u, v, w FROM g WHERE u >= 9 OR v >= 9")
def out_of_bounds(spark, d):
    return G.out_of_bounds(T.supplier_graph(spark, d), 9)


@query(f"WITH {T.RAW} SELECT least(u, v) AS u, greatest(u, v) AS v, sum(w - 20) AS w FROM raw WHERE u <> v AND w - 20 > 0 GROUP BY 1, 2")
def drop_negative_weights(spark, d):
    raw = T.supplier_pairs(spark, d).withColumn("w", F.col("w") - 20)
    return G.coalesced(G.check_weights(G.canonical(raw), "drop").select("u", "v", "w"))


@query(f"WITH {T.RAW} SELECT least(u, v) AS u, greatest(u, v) AS v, sum(abs(w - 20)) AS w FROM raw WHERE u <> v AND w - 20 <> 0 GROUP BY 1, 2")
def absolute_weights(spark, d):
    raw = T.supplier_pairs(spark, d).withColumn("w", F.col("w") - 20)
    return G.coalesced(G.check_weights(G.canonical(raw), "abs").select("u", "v", "w"))


# --- matrices ------------------------------------------------------------------

@query(f"WITH {T.G} SELECT node, sum(w) AS degree FROM (SELECT u AS node, w FROM g UNION ALL SELECT v, w FROM g) GROUP BY node")
def weighted_degree(spark, d):
    return G.degrees(T.supplier_graph(spark, d))


@query(f"WITH {T.G}, {T.LAP} SELECT row, col, value FROM lap")
def laplacian(spark, d):
    return G.laplacian(T.supplier_graph(spark, d))


@query(f"WITH {T.G}, {T.LAP} SELECT col, sum(value) AS total FROM lap GROUP BY col")
def laplacian_column_sums(spark, d):
    return G.column_sums(G.laplacian(T.supplier_graph(spark, d)))


@query("SELECT CAST(0 AS BIGINT) AS violations")
def laplacian_validity(spark, d):
    return V.invalid_laplacian(G.laplacian(T.supplier_graph(spark, d))).agg(F.count(F.lit(1)).alias("violations"))


@query(f"WITH {T.G}, {T.LAP} SELECT row AS u, col AS v, -value AS w FROM lap WHERE row < col")
def edges_from_laplacian(spark, d):
    return G.edges_of_laplacian(G.laplacian(T.supplier_graph(spark, d)))


@query(f"WITH {T.G} SELECT u, v, v AS node, round(sqrt(w), 6) AS value FROM g UNION ALL SELECT u, v, u, round(-sqrt(w), 6) FROM g")
def incidence_matrix(spark, d):
    return G.incidence(T.supplier_graph(spark, d)).withColumn("value", r6("value"))


@query(f"WITH {T.G} SELECT u, v, w, row_number() OVER (ORDER BY u, v) - 1 AS ordinal FROM g")
def edge_ordinals(spark, d):
    return G.ordinals(T.supplier_graph(spark, d))


@query(f"WITH {T.G}, o AS (SELECT *, row_number() OVER (ORDER BY u, v) - 1 AS edge FROM g) SELECT edge, v AS node, round(sqrt(w), 6) AS value FROM o UNION ALL SELECT edge, u, round(-sqrt(w), 6) FROM o")
def incidence_by_ordinal(spark, d):
    return G.incidence_by_ordinal(G.ordinals(T.supplier_graph(spark, d))).withColumn("value", r6("value"))


@query(f"WITH {T.G} SELECT node, round(sum(w), 6) AS norm2 FROM (SELECT u AS node, w FROM g UNION ALL SELECT v, w FROM g) GROUP BY node")
def incidence_row_norms(spark, d):
    return G.incidence(T.supplier_graph(spark, d)).groupBy("node").agg(r6(F.sum(F.col("value") * F.col("value"))).alias("norm2"))


@query(f"WITH {T.G} SELECT count(*) AS num_edges FROM g")
def edge_count(spark, d):
    return G.num_edges(T.supplier_graph(spark, d))


@query(f"WITH {T.G}, {T.LAP} SELECT CAST((SELECT count(*) FROM lap) + 2 * (SELECT count(*) FROM g WHERE w > 5) AS BIGINT) AS entries")
def entries_held(spark, d):
    g = T.supplier_graph(spark, d)
    return G.size_of(g.where("w > 5"), g)


@query(f"WITH {T.G}, {T.LAP} SELECT round(sqrt(sum(value * value)), 6) AS norm FROM lap")
def frobenius_norm(spark, d):
    return G.frobenius(G.laplacian(T.supplier_graph(spark, d))).select(r6("norm").alias("norm"))


@query(f"WITH {T.G} SELECT round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std_dev FROM g")
def weight_statistics(spark, d):
    return T.supplier_graph(spark, d).agg(r6(F.avg("w")).alias("mean"), r6(F.stddev_pop("w")).alias("std_dev"))


@query(f"WITH {T.G}, b AS (SELECT u AS row, v AS col, w - 5 AS value FROM g) SELECT row, col, sum(value) AS value FROM (SELECT * FROM b UNION ALL SELECT row, col, CASE WHEN value % 2 = 0 THEN -value ELSE value END FROM b) GROUP BY 1, 2 HAVING sum(value) <> 0")
def matrix_sum(spark, d):
    b = T.supplier_graph(spark, d).selectExpr("u AS row", "v AS col", "w - 5 AS value")
    return G.add(b, b.withColumn("value", F.when(F.col("value") % 2 == 0, -F.col("value")).otherwise(F.col("value"))))


@query(f"WITH {T.G}, {T.LAP} SELECT row, col, value FROM lap, (SELECT max(s_suppkey) AS last FROM supplier) WHERE row < last AND col < last")
def grounded_laplacian(spark, d):
    return G.grounded(G.laplacian(T.supplier_graph(spark, d)), n_suppliers(spark, d))


@query(f"WITH {T.NATION} SELECT u AS row, v AS col, abs(w - 50) AS value FROM nn WHERE u > v")
def strict_lower(spark, d):
    return G.strict_lower_abs(T.nation_graph(spark, d).selectExpr("u AS row", "v AS col", "w - 50 AS value"))


@query(f"WITH {T.NATION}, l AS (SELECT u, v, abs(w - 50) AS w FROM nn WHERE u > v) SELECT u AS row, v AS col, w AS value FROM l UNION ALL SELECT v, u, w FROM l")
def symmetrised(spark, d):
    return G.symmetrised(T.nation_graph(spark, d).selectExpr("u AS row", "v AS col", "w - 50 AS value"))


@query(f"WITH {T.NATION} SELECT u AS row, v AS col, CASE WHEN u = v THEN abs(w - 50) ELSE -abs(w - 50) END AS value FROM nn WHERE w <> 50")
def sign_normalised(spark, d):
    return G.sign_normalised(T.nation_graph(spark, d).where("w <> 50").selectExpr("u AS row", "v AS col", "w - 50 AS value"))


@query(f"WITH {T.NATION} SELECT u AS row, v AS col, CASE WHEN abs((w - 50) * 1e-5) <= 5e-5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM nn")
def value_pattern(spark, d):
    return G.pattern(T.nation_graph(spark, d).selectExpr("u AS row", "v AS col", "(w - 50) * 1e-5D AS value"))


@query(f"WITH {T.NATION} SELECT u AS row, v AS col, w AS value FROM nn WHERE u <> v")
def diagonal_removed(spark, d):
    return G.without_diagonal(T.nation_graph(spark, d).selectExpr("u AS row", "v AS col", "w AS value"))


@query(f"WITH {T.NATION} SELECT u AS row, CAST(row_number() OVER (PARTITION BY u ORDER BY v) - 1 AS INTEGER) AS col, w AS value FROM nn")
def dense_round_trip(spark, d):
    return G.from_rows(G.to_rows(T.nation_graph(spark, d).selectExpr("u AS row", "v AS col", "w AS value")))


@query(f"WITH {T.G} SELECT 'supplier' AS dataset, (SELECT max(s_suppkey) + 1 FROM supplier) AS num_nodes, count(*) AS num_edges, round(count(*) / (SELECT max(s_suppkey) + 1 FROM supplier), 6) AS average_degree FROM g")
def dataset_statistics(spark, d):
    out = X.dataset_stats("supplier", T.supplier_graph(spark, d), n_suppliers(spark, d)).drop("notes")
    return out.withColumn("average_degree", r6(F.col("num_edges") / F.col("num_nodes")))


# --- sketches ------------------------------------------------------------------

_S = T.uniform("sk", "u", "v", "j", seed=P.sketch_seed)
_J = f"gj AS (SELECT u, v, w, CAST(unnest(range({K})) AS INTEGER) AS j FROM g)"
_Y = f"y AS (SELECT node, j, sum(y) AS y FROM (SELECT v AS node, j, sqrt(w) * sqrt(3.0::DOUBLE) * {_S} AS y FROM gj UNION ALL SELECT u, j, -sqrt(w) * sqrt(3.0::DOUBLE) * {_S} FROM gj) GROUP BY 1, 2)"


@query(f"WITH {T.G}, {_J} SELECT u, v, j, CASE WHEN {T.bits('sk', 'u', 'v', 'j', seed=3)} >= 2147483648 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM gj")
def sketch_signs(spark, d):
    g = T.supplier_graph(spark, d).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(K - 1))))
    return g.select("u", "v", "j", H.sign("sk", F.col("u"), F.col("v"), F.col("j"), seed=3, flavour="md5").alias("s"))


@query(f"WITH {T.G}, {_J} SELECT u, v, j, round({_S}, 6) AS s FROM gj")
def sketch_uniforms(spark, d):
    g = T.supplier_graph(spark, d).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(K - 1))))
    return g.select("u", "v", "j", r6(H.uniform("sk", F.col("u"), F.col("v"), F.col("j"), seed=3, flavour="md5")).alias("s"))


@query(f"WITH {T.G}, {_J} SELECT u, v, CAST(j - 1 AS INTEGER) AS j, round(sqrt(3.0::DOUBLE) * {_S}, 6) AS s FROM gj WHERE j BETWEEN 1 AND 2")
def sketch_matrix_rows(spark, d):
    return sketch.rows(T.supplier_graph(spark, d), P, 1, 3).select("u", "v", F.posexplode("s").alias("j", "s")).withColumn("s", r6("s"))


@query(f"WITH {T.G}, {_J}, {_Y} SELECT node, j, round(y, 6) AS y FROM y")
def sketch_product_long(spark, d):
    return sketch.long(T.supplier_graph(spark, d), P, K).withColumn("y", r6("y"))


@query(f"WITH {T.G}, {_J}, {_Y} SELECT node, j, round(y, 6) AS y FROM y")
def sketch_product(spark, d):
    return sketch.wide(T.supplier_graph(spark, d), P, K).select("node", F.posexplode("y").alias("j", "y")).withColumn("y", r6("y"))


@query(f"SELECT CAST(unnest(range({K})) AS INTEGER) AS j, true AS is_zero")
def sketch_column_sums(spark, d):
    return sketch.long(T.supplier_graph(spark, d), P, K).groupBy("j").agg((F.abs(F.sum("y")) < 1e-6).alias("is_zero"))


@query()
def sketch_gaussian(spark, d):
    return sketch.wide(T.supplier_graph(spark, d), P.with_(sketch="gaussian"), K)


# --- probabilities and sampling -------------------------------------------------------

_R = "r AS (SELECT u, v, w, sqrt(1 / du.d + 1 / dv.d) AS d FROM g JOIN deg du ON du.node = u JOIN deg dv ON dv.node = v)"
_DEG = "deg AS (SELECT node, sum(w) AS d FROM (SELECT u AS node, w FROM g UNION ALL SELECT v, w FROM g) GROUP BY node)"
_N = "(SELECT max(s_suppkey) + 1 FROM supplier)"
_PROB = f"pr AS (SELECT u, v, w, least(1.0::DOUBLE, {P.epsilon**-2!r}::DOUBLE * ln({_N}) * w * d * d / 1.0) AS p FROM r)"
_COIN = T.coin("co", "u", "v", seed=P.sampling_seed)
_DEC = f"dec AS (SELECT *, {_COIN} AS coin, {_COIN} < p AS kept FROM pr)"
_ALL = f"WITH {T.G}, {_DEG}, {_R}, {_PROB}, {_DEC} "


def degree_probabilities(spark, d) -> DataFrame:
    """Edges with p from a bound of the resistance by degrees, which needs no solve."""
    g = T.supplier_graph(spark, d)
    deg = G.degrees(g)
    both = g.join(deg.withColumnsRenamed({"node": "u", "degree": "du"}), "u").join(deg.withColumnsRenamed({"node": "v", "degree": "dv"}), "v")
    rated = both.withColumn("d", F.sqrt(1 / F.col("du") + 1 / F.col("dv"))).drop("du", "dv")
    return leverage.probabilities(rated, P.beta(n_suppliers(spark, d)), 1)


def decided(spark, d, reweight="sqrt") -> DataFrame:
    return sample.decide(degree_probabilities(spark, d), P.sampling_seed, reweight, "md5")


_XN = "x AS (SELECT node, CAST(unnest(range(3)) AS INTEGER) AS j FROM deg)"
_XV = T.uniform("x", "node", "j", seed=9)


@query(f"WITH {T.G}, {_DEG}, {_XN}, xv AS (SELECT node, j, {_XV} AS x FROM x) SELECT u, v, w, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS d FROM g JOIN xv a ON a.node = u JOIN xv b ON b.node = v AND a.j = b.j GROUP BY 1, 2, 3")
def diff_norms(spark, d):
    g = T.supplier_graph(spark, d)
    x = G.degrees(g).select("node", F.array(*[H.uniform("x", F.col("node"), F.lit(j), seed=9, flavour="md5") for j in range(3)]).alias("x"))
    return leverage.diff_norms(g, x).select("u", "v", "w", r6("d").alias("d"))


@query(_ALL + "SELECT u, v, round(p, 6) AS p FROM pr")
def edge_probabilities(spark, d):
    return degree_probabilities(spark, d).select("u", "v", r6("p").alias("p"))


@query(f"WITH {T.G} SELECT u, v, round({_COIN}, 9) AS coin FROM g")
def edge_coins(spark, d):
    return sample.coins(T.supplier_graph(spark, d), P.sampling_seed, "md5").select("u", "v", F.round("coin", 9).alias("coin"))


@query(_ALL + "SELECT u, v, round(w / sqrt(p), 6) AS w FROM dec WHERE kept")
def reweight_sqrt(spark, d):
    return sample.kept(decided(spark, d)).withColumn("w", r6("w"))


@query(_ALL + "SELECT u, v, round(w / p, 6) AS w FROM dec WHERE kept")
def reweight_inverse(spark, d):
    return sample.kept(decided(spark, d, "inverse")).withColumn("w", r6("w"))


@query(_ALL + "SELECT u, v, round(CASE WHEN kept THEN w / sqrt(p) ELSE 0 END - w, 6) AS change FROM dec WHERE NOT kept OR w / sqrt(p) - w <> 0")
def delta_triplets(spark, d):
    return sample.delta(decided(spark, d)).withColumn("change", r6("change"))


@query(_ALL + "SELECT count(*) AS original_num_edges, count(*) FILTER (kept) AS final_num_edges, round(count(*) FILTER (kept) / count(*), 6) AS sparsification_rate FROM dec")
def sparsification_stats(spark, d):
    return sample.stats(decided(spark, d)).withColumn("sparsification_rate", r6("sparsification_rate"))


@query(f"WITH {T.G} SELECT u, v, w / 0.5::DOUBLE AS w FROM g WHERE {_COIN} <= 0.5")
def sample_half(spark, d):
    return sample.uniform_half(T.supplier_graph(spark, d), P.sampling_seed, "md5")


@query(f"WITH {T.G} SELECT u, v, w / sqrt(0.5::DOUBLE) AS w FROM g WHERE {_COIN} < 0.5")
def sample_at_probability(spark, d):
    return sample.kept(sample.decide(T.supplier_graph(spark, d).withColumn("p", F.lit(0.5)), P.sampling_seed, flavour="md5"))


# --- checks ------------------------------------------------------------------------

_HALF = f"h AS (SELECT u, v, w / 0.5::DOUBLE AS w FROM g WHERE {_COIN} <= 0.5)"


def _forms(g: str) -> str:
    x = lambda c: T.uniform("pr", "probe", c, seed=0)
    return f"SELECT probe, sum(w * ({x('u')} - {x('v')}) * ({x('u')} - {x('v')})) AS value FROM {g}, (SELECT CAST(unnest(range({PROBES})) AS INTEGER) AS probe) GROUP BY probe"


_ERR = f"err AS (SELECT a.probe, a.value AS before, b.value AS after, abs(b.value - a.value) / a.value AS error FROM ({_forms('g')}) a JOIN ({_forms('h')}) b ON a.probe = b.probe)"


@query(f"WITH {T.G} SELECT probe, round(value, 4) AS value FROM ({_forms('g')})")
def quadratic_forms(spark, d):
    return V.forms(T.supplier_graph(spark, d), PROBES, 0, "md5").withColumn("value", F.round("value", 4))


@query(f"WITH {T.G} SELECT probe, round(value, 4) AS value FROM ({_forms('g')})")
def quadratic_forms_of_vectors(spark, d):
    g = T.supplier_graph(spark, d)
    return G.quadratic_form(g, V.probe_vectors(g, PROBES, 0, "md5")).withColumn("value", F.round("value", 4))


@query(f"WITH {T.G}, {_HALF}, {_ERR} SELECT probe, round(before, 4) AS before, round(after, 4) AS after, round(error, 6) AS error FROM err")
def probe_errors(spark, d):
    g = T.supplier_graph(spark, d)
    e = V.probe_errors(g, sample.uniform_half(g, P.sampling_seed, "md5"), PROBES, 0, "md5")
    return e.select("probe", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), r6("error").alias("error"))


@query(f"WITH {T.G}, {_HALF}, {_ERR} SELECT count(*) FILTER (after >= 1.02::DOUBLE * before) AS upper_bound_violations, count(*) FILTER (after <= 0.98::DOUBLE * before) AS lower_bound_violations, round(avg(error), 6) AS mean_rel_error, round(stddev_pop(error), 6) AS std_dev_rel_error, round(max(error), 6) AS max_rel_error FROM err")
def probe_check(spark, d):
    g = T.supplier_graph(spark, d)
    s = V.probe_summary(V.probe_errors(g, sample.uniform_half(g, P.sampling_seed, "md5"), PROBES, 0, "md5"), 0.02)
    return s.select("upper_bound_violations", "lower_bound_violations", *[r6(c).alias(c) for c in ("mean_rel_error", "std_dev_rel_error", "max_rel_error")])


@query(f"""WITH RECURSIVE {T.G}, e AS (SELECT u, v FROM g UNION ALL SELECT v, u FROM g),
reach AS (SELECT s_suppkey AS node, s_suppkey AS seen FROM supplier UNION SELECT r.node, e.v FROM reach r JOIN e ON e.u = r.seen)
SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def connected_components(spark, d):
    return V.labelled(T.supplier_graph(spark, d), n_suppliers(spark, d))


@query(f"WITH {T.G}, {_HALF} SELECT u, v, w FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.u = g.u AND h.v = g.v)")
def edge_subset_check(spark, d):
    g = T.supplier_graph(spark, d)
    return V.added_edges(sample.uniform_half(g, P.sampling_seed, "md5"), g)


@query(f"WITH {T.G} SELECT coalesce(sum(CASE WHEN u % 2 <> v % 2 THEN 2 * w END), 0) AS cut_weight FROM g")
def cut_weight(spark, d):
    g = T.supplier_graph(spark, d)
    return V.cut_weight(g, G.degrees(g).select("node", (F.col("node") % 2).alias("side")))


@query(f"WITH {T.G}, {_HALF}, c AS (SELECT (SELECT sum(2 * w) FROM g WHERE u % 2 <> v % 2) AS before, (SELECT sum(2 * w) FROM h WHERE u % 2 <> v % 2) AS after) SELECT before, after, round(after / before, 6) AS ratio FROM c")
def cut_change(spark, d):
    g = T.supplier_graph(spark, d)
    sides = G.degrees(g).select("node", (F.col("node") % 2).alias("side"))
    return V.cut_change(g, sample.uniform_half(g, P.sampling_seed, "md5"), sides).withColumn("ratio", r6("ratio"))


@query(f"WITH {T.G}, {_HALF}, a AS (SELECT u AS row, v AS col, w AS value FROM g), b AS (SELECT u AS row, v AS col, w AS value FROM h) SELECT row, col, a.value AS a, b.value AS b FROM a FULL JOIN b USING (row, col) WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) > 6")
def table_differences(spark, d):
    g = T.supplier_graph(spark, d)
    m = lambda x: x.selectExpr("u AS row", "v AS col", "w AS value")
    return V.differences(m(g), m(sample.uniform_half(g, P.sampling_seed, "md5")), 6.0)


@query(f"WITH {T.G}, {_HALF}, dd AS (SELECT node, sum(w) AS x FROM (SELECT u AS node, w FROM g UNION ALL SELECT v, w FROM g UNION ALL SELECT u, -w FROM h UNION ALL SELECT v, -w FROM h) GROUP BY node) SELECT round(sqrt(sum(x * x)), 6) AS norm FROM dd")
def degree_change(spark, d):
    g = T.supplier_graph(spark, d)
    return V.degree_change(g, sample.uniform_half(g, P.sampling_seed, "md5")).select(r6("norm").alias("norm"))


# --- solves; oracles sum the walks of the graph, or state a fact that holds without one ------------------------------------

def _walks(edges: str, doublings: int = 6) -> str:
    """Tables that end in green (a, b, x): x' = green y solves L x' = y for y of sum 0, up to a constant.

    With P = D^-1 A less its constant part, green is the sum of P^t D^-1 for t below 2^doublings; the walk's second
    eigenvalue has to be well below 1, as in the dense sample graphs, which are connected."""
    out = f"""e2 AS (SELECT u AS a, v AS b, w FROM {edges} UNION ALL SELECT v, u, w FROM {edges}),
dg AS (SELECT a, sum(w) AS d FROM e2 GROUP BY a), vol AS (SELECT sum(d) AS vol FROM dg),
m0 AS MATERIALIZED (SELECT i.a, j.a AS b, coalesce(e2.w, 0.0) / i.d - j.d / vol AS x FROM dg i CROSS JOIN dg j CROSS JOIN vol LEFT JOIN e2 ON e2.a = i.a AND e2.b = j.a),
s0 AS MATERIALIZED (SELECT i.a, j.a AS b, CASE WHEN i.a = j.a THEN 1.0::DOUBLE ELSE 0.0 END AS x FROM dg i CROSS JOIN dg j)"""
    for t in range(doublings):
        out += f""",
s{t + 1} AS MATERIALIZED (SELECT a, b, sum(x) AS x FROM (SELECT a, b, x FROM s{t} UNION ALL SELECT m.a, s.b, sum(m.x * s.x) FROM m{t} m JOIN s{t} s ON m.b = s.a GROUP BY 1, 2) GROUP BY 1, 2),
m{t + 1} AS MATERIALIZED (SELECT m.a, s.b, sum(m.x * s.x) AS x FROM m{t} m JOIN m{t} s ON m.b = s.a GROUP BY 1, 2)"""
    return out + f",\ngreen AS MATERIALIZED (SELECT s.a, s.b, s.x / d AS x FROM s{doublings} s JOIN dg ON dg.a = s.b)"


#: Sketch, solve, distances and probabilities of the supplier graph, with the columns that its nodes ask for.
SOLVED = P.with_(jl_factor=4.0, strategy="auto")
_COLS = f"(SELECT CAST(greatest(1, ceil(log2(greatest({_N}, 2)) * {SOLVED.jl_factor!r})) AS INTEGER) AS k)"
_ESTIMATED = f"""WITH {T.G}, {_walks('g')}, kk AS {_COLS}, gj AS (SELECT u, v, w, CAST(unnest(range(k)) AS INTEGER) AS j FROM g, kk), {_Y},
sol AS MATERIALIZED (SELECT a AS node, j, sum(x * y) AS x FROM green JOIN y ON y.node = b GROUP BY 1, 2),
est AS (SELECT u, v, w, sqrt(sum((p.x - q.x) * (p.x - q.x))) AS d FROM g JOIN sol p ON p.node = u JOIN sol q ON q.node = v AND q.j = p.j GROUP BY 1, 2, 3),
pr AS (SELECT u, v, w, d, least(1.0::DOUBLE, {P.epsilon**-2!r}::DOUBLE * ln({_N}) * w * d * d / k) AS p FROM est, kk), {_DEC} """
_KEPT = "sp AS (SELECT u, v, w / p AS w FROM dec WHERE kept)"


@query(f"""WITH RECURSIVE {T.NATION}, e AS (SELECT u, v FROM nn WHERE u <> v UNION SELECT v, u FROM nn WHERE u <> v),
reach AS (SELECT DISTINCT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM reach r JOIN e ON e.u = r.seen)
SELECT round((count(*) - count(DISTINCT m))::DOUBLE, 6) AS total FROM (SELECT node, min(seen) AS m FROM reach GROUP BY node)""")
def leverage_total(spark, d):
    """Leverages add up to nodes less components."""
    g = materialize(nation_edges(spark, d))
    r = leverage.exact_resistance(g, G.degrees(g).count())
    return r.agg(r6(F.sum(F.col("w") * F.col("resistance"))).alias("total"))


@query(f"SELECT CAST(unnest(range(k)) AS INTEGER) AS j, s AS strategy, true AS solved FROM {_COLS}, (SELECT unnest(['columns', 'dense', 'distributed']) AS s)")
def solver_residuals(spark, d):
    """All strategies on the supplier graph, with the columns of its sketch."""
    g = materialize(T.packed_supplier_graph(spark, d))
    k = SOLVED.jl_dim(n_suppliers(spark, d))
    y, facts = materialize(sketch.wide(g, SOLVED, k)), solver.Facts(g)
    rows = [(j, s, bool(r < 1e-6)) for s in ("columns", "dense", "distributed") for j, r in enumerate(solver.residuals(g, solver.solve(g, y, k, s, facts=facts), y, k))]
    return spark.createDataFrame(rows, "j int, strategy string, solved boolean")


@query(f"""WITH {T.NATION}, ne AS (SELECT least(u, v) AS u, greatest(u, v) AS v, sum(w) AS w FROM nn WHERE u <> v GROUP BY 1, 2), {_walks('ne')}
SELECT u, v, w, round(uu.x + vv.x - uv.x - vu.x, 6) AS resistance FROM ne JOIN green uu ON uu.a = u AND uu.b = u JOIN green vv ON vv.a = v AND vv.b = v
JOIN green uv ON uv.a = u AND uv.b = v JOIN green vu ON vu.a = v AND vu.b = u""")
def effective_resistance(spark, d):
    g = materialize(nation_edges(spark, d))
    return leverage.exact_resistance(g, G.degrees(g).count()).select("u", "v", "w", r6("resistance").alias("resistance"))


@query(_ESTIMATED + "SELECT u, v, w, round(d, 5) AS d, round(p, 5) AS p FROM pr")
def leverage_estimate(spark, d):
    e = leverage.estimate(materialize(T.supplier_graph(spark, d)), n_suppliers(spark, d), SOLVED)
    return e.select("u", "v", "w", F.round("d", 5).alias("d"), F.round("p", 5).alias("p"))


@query(_ESTIMATED + "SELECT u, v, round(w / p, 4) AS w FROM dec WHERE kept")
def sparsify_by_leverage(spark, d):
    """The whole way with hashes that other SQL engines have."""
    out = sparsify(T.supplier_graph(spark, d), n_suppliers(spark, d), SOLVED.with_(reweight="inverse"))
    return out.edges.withColumn("w", F.round("w", 4))


@query(_ESTIMATED + f", {_KEPT}, ends AS (SELECT u AS node, w FROM sp UNION ALL SELECT v, w FROM sp) SELECT u AS row, v AS col, round(-w, 4) AS value FROM sp UNION ALL SELECT v, u, round(-w, 4) FROM sp UNION ALL SELECT node, node, round(sum(w), 4) FROM ends GROUP BY node")
def laplacian_by_leverage(spark, d):
    out = sparsify(T.supplier_graph(spark, d), n_suppliers(spark, d), SOLVED.with_(reweight="inverse"))
    return out.laplacian.withColumn("value", F.round("value", 4))


@query(_ESTIMATED + "SELECT u, v, round(w / p - w, 4) AS change FROM dec WHERE kept AND round(w / p - w, 4) <> 0 UNION ALL SELECT u, v, -w FROM dec WHERE NOT kept")
def delta_by_leverage(spark, d):
    out = sparsify(T.supplier_graph(spark, d), n_suppliers(spark, d), SOLVED.with_(reweight="inverse"))
    return out.delta.withColumn("change", F.round("change", 4)).where("change <> 0")


@query()
def sparsify_default(spark, d):
    return sparsify(T.supplier_graph(spark, d), n_suppliers(spark, d), command_line_defaults()).edges


@query()
def sparsify_strong(spark, d):
    return sparsify(T.supplier_graph(spark, d), n_suppliers(spark, d), library_defaults(epsilon=0.75, beta_constant=1.0, jl_factor=4.0)).edges


@query()
def sparsified_laplacian(spark, d):
    return sparsify(T.supplier_graph(spark, d), n_suppliers(spark, d), library_defaults(epsilon=0.75, beta_constant=1.0, jl_factor=4.0, reweight="inverse")).laplacian


@query("SELECT true AS subset, true AS same_components, true AS within_bounds")
def sparsify_verified(spark, d):
    """The result is a subset with the same components and, unbiased, keeps all probes within epsilon."""
    n = n_suppliers(spark, d)
    g = materialize(T.supplier_graph(spark, d))
    h = materialize(sparsify(g, n, library_defaults(epsilon=0.75, jl_factor=4.0, reweight="inverse")).edges)
    s = V.probe_summary(V.probe_errors(g, h, 100, 0), 0.75).first()
    rows = [(V.added_edges(g, h).count() == 0, V.count_components(g, n) == V.count_components(h, n), s[0] + s[1] == 0)]
    return spark.createDataFrame(rows, "subset boolean, same_components boolean, within_bounds boolean")


# --- files, streams, experiments ---------------------------------------------------------------

def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/ohmgraph-{uuid.uuid4().hex}"


@query(f"WITH {T.G}, {T.LAP} SELECT row, col, value FROM lap")
def matrix_market_round_trip(spark, d):
    path = _scratch(spark)
    MM.write_matrix(G.laplacian(T.supplier_graph(spark, d)), path, n_suppliers(spark, d), symmetric=True)
    return MM.read_matrix(spark, path)[0]


@query(f"WITH {T.NATION} SELECT u AS row, CAST(row_number() OVER (PARTITION BY u ORDER BY v) - 1 AS BIGINT) AS col, w AS value FROM nn")
def csv_round_trip(spark, d):
    path = _scratch(spark)
    TX.write_dense_csv(G.to_rows(T.nation_graph(spark, d).selectExpr("u AS row", "v AS col", "w AS value")), path)
    return TX.read_dense_csv(spark, path)


@query(f"WITH {T.RAW}, e AS (SELECT least(u, v) AS u, greatest(u, v) AS v, arg_min(w, ord) AS w FROM raw WHERE u <> v AND w <> 0 GROUP BY 1, 2) SELECT u AS row, v AS col, w AS value FROM e UNION ALL SELECT v, u, w FROM e")
def edge_list_conversion(spark, d):
    source, target = _scratch(spark), _scratch(spark)
    raw = T.supplier_pairs(spark, d).where("w <> 0")
    top = spark.createDataFrame([(-1, "100000 0"), (0, "")], "ord long, line string")
    lines = top.unionByName(raw.select("ord", F.concat_ws(" ", "u", "v", F.col("w").cast("string")).alias("line")))
    # several files of uneven sizes: the head alone, then all the others
    lines.repartitionByRange(3, F.least("ord", F.lit(1).cast("long"))).sortWithinPartitions("ord").select("line").write.text(source)
    TX.edge_list_to_matrix_market(spark, source, target)
    return MM.read_matrix(spark, target)[0]


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS i, s_acctbal AS value FROM supplier")
def vector_line(spark, d):
    return TX.read_vector(spark, _one_line(spark, d, F.col("s_acctbal").cast("string")))


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS i, s_acctbal > 0 AS value FROM supplier")
def flag_line(spark, d):
    return TX.read_flags(spark, _one_line(spark, d, (F.col("s_acctbal") > 0).cast("string")))


@query(_ESTIMATED + "SELECT row_number() OVER (ORDER BY u, v) - 1 AS ordinal, u, v, w, round(d, 5) AS d, round(p, 5) AS p, round(coin, 9) AS coin, kept FROM dec")
def stage_files(spark, d):
    """The decisions read back from the files of all stages."""
    folder = _scratch(spark)
    ST.write_stages(T.supplier_graph(spark, d), n_suppliers(spark, d), SOLVED, folder)
    e = ST.read_stages(spark, folder)["edges"]
    return e.withColumns({"d": F.round("d", 5), "p": F.round("p", 5), "coin": F.round("coin", 9)})


def _one_line(spark, d, value: Column) -> str:
    path = _scratch(spark)
    items = T.read(spark, d, "supplier").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", value.alias("x")))).alias("a"))  # such a file is one line
    items.select(F.array_join(F.transform("a", lambda t: t["x"]), ",")).coalesce(1).write.text(path)
    return path


@query(f"WITH {T.G} SELECT v AS row, u AS col, 1.0::DOUBLE AS value FROM g UNION ALL SELECT u, v, 1.0::DOUBLE FROM g")
def pattern_file(spark, d):
    path, n = _scratch(spark), n_suppliers(spark, d)
    g = materialize(T.supplier_graph(spark, d))
    head = spark.createDataFrame([(-2, -2, "%%MatrixMarket matrix coordinate pattern symmetric"), (-1, -1, f"{n} {n} {g.count()}")], "u long, v long, line string")
    lines = head.unionByName(g.select("u", "v", F.concat_ws(" ", F.col("v") + 1, F.col("u") + 1).alias("line")))
    lines.orderBy("u", "v").select("line").write.text(path)
    return MM.read_matrix(spark, path)[0]


@query(f"WITH {T.NATION}, n AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation) SELECT a.k AS row, CAST(b.k AS INTEGER) AS col, coalesce(w, 0.0) AS value FROM n a CROSS JOIN n b LEFT JOIN nn ON u = a.k AND v = b.k WHERE a.k IN (SELECT u FROM nn)")
def dense_file(spark, d):
    path = _scratch(spark)
    MM.write_matrix(T.nation_graph(spark, d).selectExpr("u AS row", "v AS col", "w AS value"), path, 25)
    return MM.read_dense(spark, path).select("row", F.posexplode("values").alias("col", "value"))


@query("SELECT i AS u, i + 1 AS v, 1.0::DOUBLE AS w FROM range(99) t(i) UNION ALL SELECT 10 * i, 10 * i + 9, 1.0::DOUBLE FROM range(10) t(i)")
def path_graph(spark, d):
    return GEN.path_with_shortcuts(spark)


@query()
def experiment_space(spark, d):
    return X.run_grid(spark, "supplier", T.supplier_graph(spark, d), n_suppliers(spark, d), X.space_grid())


@query()
def streaming_resparsify(spark, d):
    """Edges arrive in three files; the held graph is sparsified again above a threshold."""
    folder = _scratch(spark)
    g = T.supplier_graph(spark, d)
    g.repartition(3, F.xxhash64("v", "u")).write.parquet(f"{folder}/in")
    n = n_suppliers(spark, d)
    state = EdgeStream(spark, f"{folder}/state", n, library_defaults(epsilon=0.75, beta_constant=1.0, jl_factor=4.0, reweight="inverse"), threshold=n * 10)
    stream = spark.readStream.schema("u long, v long, w double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    state.start(stream, f"{folder}/progress").awaitTermination()
    return state.finish()


@query()
def experiment_basic(spark, d):
    return X.run_grid(spark, "supplier", T.supplier_graph(spark, d), n_suppliers(spark, d), X.basic_grid())


@query()
def experiment_jl_dim(spark, d):
    n = n_suppliers(spark, d)
    return X.run_grid(spark, "supplier", T.packed_supplier_graph(spark, d), n, X.jl_dim_grid(n))


@query()
def experiment_jl_scaling(spark, d):
    n = n_suppliers(spark, d)
    return X.run_grid(spark, "supplier", T.packed_supplier_graph(spark, d), n, X.jl_scaling_grid(n))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparsify_default(spark, sf_dir)

