"""Edges and matrices as DataFrames: edges (u, v, w) with u < v, matrices in coordinates (row, col, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import arrays as A
from .components import materialize


def is_packed(edges: DataFrame) -> bool:
    """Whether a row of edges holds many of them, as binary arrays (see arrays.packed): Spark then passes few rows."""
    return isinstance(edges.schema["u"].dataType, BinaryType)


def packed(edges: DataFrame) -> DataFrame:
    """Edges (u, v, w) packed."""
    if is_packed(edges):
        return edges

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.chunks(batches, 1 << 18):
            yield from A.packed("uvw", [A.column(t, c) for c in "uvw"])

    cast = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))
    return cast.mapInArrow(work, "u binary, v binary, w binary")


def rows(edges: DataFrame) -> DataFrame:
    """Edges (u, v, w), a row each."""
    return edges.select("u", "v", "w").mapInArrow(A.plain, "u long, v long, w double") if is_packed(edges) else edges


def count(edges: DataFrame) -> int:
    return int(edges.agg(F.sum(F.octet_length("u"))).first()[0] or 0) // 8 if is_packed(edges) else edges.count()


def upper_triangle(matrix: DataFrame) -> DataFrame:
    """Edges stored above the diagonal; entries below it and on it are not read."""
    return matrix.where("row < col").select(F.col("row").cast("long").alias("u"), F.col("col").cast("long").alias("v"), F.col("value").cast("double").alias("w"))


def canonical(pairs: DataFrame) -> DataFrame:
    """Endpoints as (lesser, greater); loops and zero weights go."""
    return pairs.where("u <> v and w <> 0").withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})


def coalesced(edges: DataFrame) -> DataFrame:
    """Parallel edges added up; what cancels to 0 goes."""
    return edges.groupBy("u", "v").agg(F.sum("w").alias("w")).where("w <> 0")


def first_wins(pairs: DataFrame, order: str) -> DataFrame:
    """Of parallel edges the one that comes first by `order`."""
    return canonical(pairs).groupBy("u", "v").agg(F.min_by("w", order).alias("w"))


def check_weights(edges: DataFrame, negative: str) -> DataFrame:
    """Negative weights raise an error when read, become positive, or go."""
    if negative == "abs":
        return edges.withColumn("w", F.abs("w"))
    if negative == "drop":
        return edges.where("w > 0")
    return edges.withColumn("w", F.when(F.col("w") < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(F.col("w")))


def check_bounds(edges: DataFrame, n: int) -> DataFrame:
    """Raises an error, when read, at a node outside 0 to n - 1."""
    fine = (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < n) & (F.col("v") < n)
    return edges.withColumn("u", F.when(fine, F.col("u")).otherwise(F.raise_error(F.lit("node out of bounds")).cast("long")))


def out_of_bounds(edges: DataFrame, n: int) -> DataFrame:
    return edges.where((F.col("u") < 0) | (F.col("v") < 0) | (F.col("u") >= n) | (F.col("v") >= n))


def endpoints(edges: DataFrame, *values: tuple[Column, Column]) -> DataFrame:
    """A row for each endpoint: node, and for each pair of values the first at v, the second at u."""
    at = lambda i, node: F.struct(node.alias("node"), *[x[i].alias(f"x{k}") for k, x in enumerate(values)])
    return edges.select(F.explode(F.array(at(0, F.col("v")), at(1, F.col("u")))).alias("end")).select("end.*")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): the diagonal of the Laplacian."""
    if is_packed(edges):
        return edges.select("u", "v", "w").mapInArrow(_degrees, "node long, degree double").groupBy("node").agg(F.sum("degree").alias("degree"))
    w = F.col("w")
    return endpoints(edges, (w, w)).groupBy("node").agg(F.sum("x0").alias("degree"))


def _degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in A.chunks(batches, 1 << 20):
        nodes, flat = np.unique(np.concatenate((A.column(t, "u"), A.column(t, "v"))), return_inverse=True)
        w = A.column(t, "w")
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.bincount(flat, np.concatenate((w, w)), len(nodes)))], ["node", "degree"])


def adjacency(edges: DataFrame) -> DataFrame:
    entry = lambda r, c: F.struct(F.col(r).alias("row"), F.col(c).alias("col"), F.col("w").alias("value"))
    return edges.select(F.explode(F.array(entry("u", "v"), entry("v", "u"))).alias("e")).select("e.*")


def laplacian(edges: DataFrame) -> DataFrame:
    """D - A in coordinates, one pass: each edge gives four entries, summed by place."""
    w = F.col("w")
    entry = lambda r, c, x: F.struct(F.col(r).alias("row"), F.col(c).alias("col"), x.alias("value"))
    four = F.array(entry("u", "v", -w), entry("v", "u", -w), entry("u", "u", w), entry("v", "v", w))
    return edges.select(F.explode(four).alias("e")).select("e.*").groupBy("row", "col").agg(F.sum("value").alias("value")).where("value <> 0")


def edges_of_laplacian(matrix: DataFrame) -> DataFrame:
    return upper_triangle(matrix).withColumn("w", -F.col("w"))


def incidence(edges: DataFrame) -> DataFrame:
    """Signed edge-vertex incidence: (u, v, node, value), sqrt(w) at v and -sqrt(w) at u."""
    root = F.sqrt("w")
    at = lambda node, x: F.struct(F.col(node).alias("node"), x.alias("value"))
    return edges.select("u", "v", F.explode(F.array(at("v", root), at("u", -root))).alias("e")).select("u", "v", "e.*")


def ordinals(edges: DataFrame) -> DataFrame:
    """(u, v, w, ordinal): the place of each edge, from 0, in the order of (u, v).

    The table is range-sorted and written once; a partition's edges start where those of the partitions before it end,
    so no task sorts or numbers more than its own range. One row a partition is broadcast."""
    placed = materialize(edges.select("u", "v", "w").orderBy("u", "v").withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumns({"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select("u", "v", "w", (F.col("start") + F.col("place")).alias("ordinal"))


def incidence_by_ordinal(numbered: DataFrame) -> DataFrame:
    """(edge, node, value): the incidence with edges known by their ordinal; numbered: see ordinals."""
    ends = endpoints(numbered, (F.col("ordinal"), F.col("ordinal")), (F.sqrt("w"), -F.sqrt("w")))
    return ends.select(F.col("x0").alias("edge"), "node", F.col("x1").alias("value"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two matrices; what cancels goes."""
    return a.unionByName(b).groupBy("row", "col").agg(F.sum("value").alias("value")).where("value <> 0")


def column_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("col").agg(F.sum("value").alias("total"))


def asymmetric(matrix: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Places whose value differs from their mirror's."""
    mirror = matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), (-F.col("value")).alias("value"))
    both = matrix.select("row", "col", "value").unionByName(mirror)
    return both.groupBy("row", "col").agg(F.sum("value").alias("gap")).where(F.abs("gap") > tolerance)


def num_edges(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("num_edges"))


def size_of(buffered: DataFrame, current: DataFrame) -> DataFrame:
    """Entries held: two a buffered edge, and all of the current Laplacian with its diagonal."""
    return buffered.agg((2 * F.count(F.lit(1))).alias("n")).unionByName(laplacian(current).agg(F.count(F.lit(1)).alias("n"))).agg(F.sum("n").alias("entries"))


def frobenius(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def without_diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.where("row <> col")


def strict_lower_abs(matrix: DataFrame) -> DataFrame:
    return matrix.where("row > col").withColumn("value", F.abs("value"))


def symmetrised(matrix: DataFrame) -> DataFrame:
    """The lower triangle and its mirror, absolute, without diagonal."""
    low = strict_lower_abs(matrix)
    return low.unionByName(low.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))


def sign_normalised(matrix: DataFrame) -> DataFrame:
    """Off-diagonal values negative, diagonal ones positive."""
    return matrix.withColumn("value", F.when(F.col("row") == F.col("col"), F.abs("value")).otherwise(-F.abs("value")))


def grounded(matrix: DataFrame, n: int) -> DataFrame:
    """Without the last row and column."""
    return matrix.where((F.col("row") < n - 1) & (F.col("col") < n - 1))


def pattern(matrix: DataFrame, tolerance: float = 5e-5) -> DataFrame:
    return matrix.withColumn("value", F.when(F.abs("value") <= tolerance, F.lit(0.0)).otherwise(F.lit(1.0)))


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def to_rows(matrix: DataFrame) -> DataFrame:
    """Dense rows of coordinates: (row, values), ordered by col."""
    return matrix.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("values"))


def from_rows(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.posexplode("values").alias("col", "value"))


def quadratic_form(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(probe, value): x' L x for each vector; vectors: (probe, node, x). Missing entries count as 0."""
    x = lambda side: vectors.select("probe", F.col("node").alias(side), F.col("x").alias(f"x{side}"))
    d = F.col("xu") - F.col("xv")
    return edges.join(x("u"), "u").join(x("v"), ["v", "probe"]).groupBy("probe").agg(F.sum(F.col("w") * d * d).alias("value"))
