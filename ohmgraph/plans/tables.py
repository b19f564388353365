"""Graphs made from the sample tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import graph as G_

#: Lines for which there is a task; lines and pairs that a task works on at once.
LINES, AT_ONCE = 400_000, 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share orders; w counts the orders."""
    return G_.rows(packed_supplier_graph(spark, sf_dir))


def packed_supplier_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier graph, packed (see graph.is_packed).

    Lines are dealt to tasks by order, and pairs of suppliers by both of them, as arrays of many: what is shuffled are a
    few packed rows a task. Lines of an order meet in one task, pairs are counted as they come in."""
    lines = read(spark, sf_dir, "lineitem")
    tasks = max(1, -(-lines.count() // LINES))
    items = lines.where("l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL").select(*[F.col(c).cast("long").alias(c) for c in ("l_orderkey", "l_suppkey")])
    packed = "part int, a binary, b binary"

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.chunks(batches, AT_ONCE):
            order, supplier = A.column(t, "l_orderkey"), A.column(t, "l_suppkey")
            yield from A.dealt(_task(tasks, order), ("a", "b"), (order, supplier), "part")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in _pairs(*_unpacked(batches)):
            yield from A.dealt(_task(tasks, u, v), ("a", "b"), (u, v), "part")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from A.packed("uvw", _counts(batches))

    met = items.mapInArrow(orders, packed).repartitionById(tasks, F.col("part")).mapInArrow(paired, packed)
    return met.repartitionById(tasks, F.col("part")).mapInArrow(counted, "u binary, v binary, w binary")


def _task(tasks: int, *keys: np.ndarray) -> np.ndarray:
    """A task for each row of keys, by their hash."""
    h = np.zeros(len(keys[0]), dtype=np.uint64)
    for x in keys:
        h = (h ^ x.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(tasks)).astype(np.int32)


def _unpacked(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    rows = [[np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()] for t in batches for c in ("a", "b")]
    return tuple(np.concatenate([np.empty(0, dtype=np.int64), *[x for some in rows[i::2] for x in some]]) for i in (0, 1))


def _distinct(a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) sorted, each once, with the sum of w or the number of its rows."""
    if len(a) and min(a.min(), b.min()) >= 0 and max(a.max(), b.max()) < 1 << 31:
        key = a << 32 | b
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    else:
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(a) else order
    total = np.diff(np.append(first, len(a))).astype(float) if w is None else np.add.reduceat(w[order], first) if len(a) else w
    return a[order[first]], b[order[first]], total


def _pairs(order: np.ndarray, supplier: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each two different suppliers of an order, the lesser first, about AT_ONCE pairs at a time."""
    order, supplier, _ = _distinct(order, supplier)
    at, gap, held, n = np.arange(len(order)), 1, [], 0
    while True:
        at = at[at + gap < len(order)]
        at = at[order[at] == order[at + gap]]
        if len(at):
            held.append((supplier[at], supplier[at + gap]))
            n += len(at)
        if held and (n >= AT_ONCE or not len(at)):
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
        if not len(at):
            return
        gap += 1


def _counts(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w) of packed pairs, counted whenever AT_ONCE of them, or as many as are held, have come."""
    u = v = np.empty(0, dtype=np.int64)
    w, held, n = np.empty(0), [], 0
    for t in batches:
        for row in range(t.num_rows):
            held.append(_unpacked([t.slice(row, 1)]))
            n += len(held[-1][0])
            if n >= max(AT_ONCE, len(u)):
                u, v, w = _added(u, v, w, held)
                held, n = [], 0
    return _added(u, v, w, held)


def _added(u: np.ndarray, v: np.ndarray, w: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = (np.concatenate((x, *[h[i] for h in held])) for i, x in enumerate((u, v)))
    return _distinct(a, b, np.concatenate((w, np.ones(len(a) - len(w)))))


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines: (u supplier, v nation of the customer, w quantity, ord), with loops, both orders and parallels."""
    items, orders, customer = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    both = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return both.select(
        F.col("l_suppkey").alias("u"), F.col("c_nationkey").cast("long").alias("v"), (F.col("l_quantity") - F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).otherwise(0)).alias("w"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")).alias("ord"),
    )


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between nations; w counts lines; loops and both directions."""
    items, orders, customer, supplier = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    both = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return both.groupBy(F.col("c_nationkey").cast("long").alias("u"), F.col("s_nationkey").cast("long").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w"))


G = """g AS (SELECT a.l_suppkey AS u, b.l_suppkey AS v, CAST(count(*) AS DOUBLE) AS w
  FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b
  ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2)"""
RAW = """raw AS (SELECT l_suppkey AS u, CAST(c_nationkey AS BIGINT) AS v,
  l_quantity - CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END AS w, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
NATION = """nn AS (SELECT CAST(c_nationkey AS BIGINT) AS u, CAST(s_nationkey AS BIGINT) AS v, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
LAP = """lap AS (SELECT row, col, sum(value) AS value FROM (
  SELECT u AS row, v AS col, -w AS value FROM g UNION ALL SELECT v, u, -w FROM g UNION ALL SELECT u, u, w FROM g UNION ALL SELECT v, v, w FROM g)
  GROUP BY 1, 2 HAVING sum(value) <> 0)"""


def bits(role: str, *keys: str, seed: int) -> str:
    """hashing.bits32 of the md5 flavour in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws(',', '{role}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}, '{seed}')), 1, 8) AS BIGINT)"


def uniform(role: str, *keys: str, seed: int) -> str:
    return f"(({bits(role, *keys, seed=seed)} + 0.5::DOUBLE) * {2 / float(1 << 32)!r}::DOUBLE - 1.0)"


def coin(role: str, *keys: str, seed: int) -> str:
    return f"(({bits(role, *keys, seed=seed)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
