"""Matrix Market coordinate files. Loaded indices start at 0, stored ones at 1.

A stored matrix is a folder of text parts in order (their concatenation is one valid file), or one file where it is
small; both are read, by Spark's own reader only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import materialize

BANNER = "%%MatrixMarket matrix coordinate"


def read_matrix(spark: SparkSession, path: str, index_base: int = 1) -> tuple[DataFrame, int, str]:
    """(row, col, value) with symmetric storage expanded, the number of rows, and the field and symmetry line."""
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")
    )
    top = lines.where(F.lower("line").startswith("%%matrixmarket")).select("file", "line").first()
    if top is None:
        raise ValueError(f"{path} has no Matrix Market banner")
    kind = top["line"].lower().split()
    if kind[2] != "coordinate":
        raise ValueError("only coordinate matrices are read here; see read_dense")
    body = (~F.col("line").startswith("%")) & (F.col("line") != "")
    head = lines.where((F.col("file") == top["file"]) & (F.col("start") == 0) & body).agg(F.min(F.struct("id", "line")).alias("h")).first()["h"]
    n, m, _ = map(int, head["line"].split())
    parts = F.split("line", r"\s+")
    value = F.lit(1.0) if kind[3] == "pattern" else F.get(parts, F.lit(2)).cast("double")
    is_head = (F.col("file") == top["file"]) & (F.col("start") == 0) & (F.col("id") == head["id"])
    rows = lines.where(body & ~is_head).select((F.get(parts, F.lit(0)).cast("long") - index_base).alias("row"), (F.get(parts, F.lit(1)).cast("long") - index_base).alias("col"), value.alias("value"))
    if kind[4] in ("symmetric", "skew-symmetric"):
        other = F.col("value") if kind[4] == "symmetric" else -F.col("value")
        entry = lambda r, c, x: F.struct(F.col(r).alias("row"), F.col(c).alias("col"), x.alias("value"))
        both = F.when(F.col("row") == F.col("col"), F.array(entry("row", "col", F.col("value")))).otherwise(F.array(entry("row", "col", F.col("value")), entry("col", "row", other)))
        rows = rows.select(F.explode(both).alias("e")).select("e.*")
    return rows, max(n, m), " ".join(kind[3:5])


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """(row, values): a coordinate matrix as dense rows, absent entries 0."""
    matrix, _, _ = read_matrix(spark, path)
    width = matrix.agg(F.max("col")).first()[0]
    by_col = F.map_from_entries(F.collect_list(F.struct("col", "value")))
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(width)), lambda j: F.coalesce(F.element_at(m, j), F.lit(0.0)))
    return matrix.groupBy("row").agg(by_col.alias("m")).select("row", dense(F.col("m")).alias("values"))


def write_matrix(matrix: DataFrame, path: str, n: int, symmetric: bool = False, single: bool = False, columns: int | None = None) -> None:
    """Sorted by column and row; n rows and as many columns, or those given. symmetric stores the lower triangle only.
    Errors are raised."""
    if symmetric:
        matrix = matrix.where("row >= col")
    matrix = materialize(matrix.select("row", "col", "value"))  # counted, sampled for its order and written
    m = matrix.count()
    head = [(0, 0, f"{BANNER} real {'symmetric' if symmetric else 'general'}"), (0, 1, f"{n} {n if columns is None else columns} {m}")]
    top = matrix.sparkSession.createDataFrame([(-2 + b, -1, t) for _, b, t in head], "c long, r long, line string")
    body = matrix.select(F.col("col").alias("c"), F.col("row").alias("r"), F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, F.col("value").cast("string")).alias("line"))
    lines = top.unionByName(body)
    lines = lines.coalesce(1).sortWithinPartitions("c", "r") if single else lines.orderBy("c", "r")
    lines.select("line").write.mode("overwrite").text(path)
