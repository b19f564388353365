"""Edge lists and comma-separated numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from . import matrix_market as MM


def read_edge_list(spark: SparkSession, path: str, default_weight: float = 1.0, index_base: int = 0) -> tuple[DataFrame, int]:
    """(u, v, w) and n. First line: n m (m is not used); blank lines are skipped; of parallel edges the first wins.

    A folder's files are read on in the order of their names, whatever their sizes."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).select(F.trim("value").alias("line"), place.alias("at")).where("line <> ''")
    head = lines.agg(F.min(F.struct("at", "line")).alias("h")).first()["h"]
    if head is None:
        raise ValueError(f"{path} is empty")
    parts = F.split("line", r"\s+")
    here = head["at"]
    is_head = (F.col("at.file") == here["file"]) & (F.col("at.start") == here["start"]) & (F.col("at.id") == here["id"])
    rows = lines.where(~is_head).select(
        (F.get(parts, F.lit(0)).cast("long") - index_base).alias("u"), (F.get(parts, F.lit(1)).cast("long") - index_base).alias("v"),
        F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(default_weight)).alias("w"), "at",
    )
    n = int(head["line"].split()[0])
    return G.check_bounds(G.first_wins(rows, "at"), n), n


def edge_list_to_matrix_market(spark: SparkSession, source: str, target: str, default_weight: float = 1.0, index_base: int = 0) -> None:
    edges, n = read_edge_list(spark, source, default_weight, index_base)
    MM.write_matrix(edges.select(F.col("v").alias("row"), F.col("u").alias("col"), F.col("w").alias("value")), target, n, symmetric=True)


def read_dense_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(row, col, value) of a table without header. strict: an empty or odd field or an uneven width is an error when
    read; else such fields are NaN."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).where(F.trim("value") != "").select(place.alias("p"), F.monotonically_increasing_id().alias("id"), F.split("value", ",").alias("f"))
    width = lines.agg(F.min(F.size("f")).alias("a"), F.max(F.size("f")).alias("b")).first()
    if strict and width["a"] != width["b"]:
        raise ValueError("rows differ in width")
    # lines are counted by block of a file; a block's rows start after all lines of the blocks before it
    run, first = 0, []
    for p, n in sorted((tuple(r["p"]), r["count"]) for r in lines.groupBy("p").count().collect()):
        first.append((p, run))
        run += n
    offsets = spark.createDataFrame(first, "p struct<file:string,start:long>, offset long")
    row = F.col("offset") + F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1
    numbered = lines.join(F.broadcast(offsets), "p").withColumn("row", row)
    cells = numbered.select("row", F.posexplode("f").alias("col", "t"))
    value = F.expr("try_cast(trim(t) as double)")
    bad = F.raise_error(F.concat(F.lit("not a number: "), F.col("t"))).cast("double") if strict else F.lit(float("nan"))
    return cells.select("row", F.col("col").cast("long").alias("col"), F.coalesce(value, bad).alias("value"))


def write_dense_csv(rows: DataFrame, path: str) -> None:
    """rows: (row, values), written in order without header."""
    rows.orderBy("row").select(F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("line")).write.mode("overwrite").text(path)


def _line(spark: SparkSession, path: str) -> str:
    found = spark.read.text(path).where(F.trim("value") != "").take(2)
    if len(found) != 1:
        raise ValueError(f"{path} must have one line")
    return found[0]["value"]


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(i, value) of one line of numbers; none or more lines are an error."""
    _line(spark, path)
    cells = spark.read.text(path).where(F.trim("value") != "").select(F.posexplode(F.split("value", ",")).alias("i", "t"))
    return cells.select("i", F.trim("t").cast("double").alias("value"))


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """(i, value) of one line of true and false."""
    _line(spark, path)
    cells = spark.read.text(path).where(F.trim("value") != "").select(F.posexplode(F.split("value", ",")).alias("i", "t"))
    return cells.select("i", F.trim("t").cast("boolean").alias("value"))


def append_result(row: DataFrame, path: str) -> None:
    """One more row of an experiment's table."""
    row.coalesce(1).write.mode("append").option("header", True).csv(path)
