"""Keeping edges by hashed coins, and giving the kept ones new weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H


def coins(edges: DataFrame, seed: int, flavour: str = "xx") -> DataFrame:
    return edges.withColumn("coin", H.coin("co", F.col("u"), F.col("v"), seed=seed, flavour=flavour))


def decide_packed(found: DataFrame, shares: list[tuple[int, float, float, float, str]], seed: int, flavour: str) -> DataFrame:
    """(u, v, w, n0, n1 ..), packed: for each share (k, scale, beta, columns, reweight) the new weights of found, whose
    distances are d{k} times scale; 0 where an edge is not kept. The numbers of decide."""
    names = ["u", "v", "w", *[f"n{i}" for i in range(len(shares))]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.plain(batches):
            u, v, w = (t.column(c).to_numpy() for c in "uvw")
            coin, out = A.coin(A.bits32("co", [], [u, v], [None], seed, flavour)[0]), []
            for k, scale, beta, width, reweight in shares:
                d = t.column(f"d{k}").to_numpy() * scale
                p = np.minimum(1.0, beta * w * d * d / width)
                kept = coin < p
                out.append(np.divide(w, np.sqrt(p) if reweight == "sqrt" else p, out=np.zeros(len(w)), where=kept))
            yield from A.packed(names, [u, v, w, *out])

    return found.mapInArrow(work, ", ".join(f"{c} binary" for c in names))


def share(chosen: DataFrame, i: int) -> DataFrame:
    """Kept edges of share i of decide_packed, packed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.plain(batches):
            w = t.column(f"n{i}").to_numpy()
            kept = w != 0
            yield from A.packed("uvw", [t.column("u").to_numpy()[kept], t.column("v").to_numpy()[kept], w[kept]])

    return chosen.select("u", "v", f"n{i}").mapInArrow(work, "u binary, v binary, w binary")


def new_weight(reweight: str) -> Column:
    return F.col("w") / (F.sqrt("p") if reweight == "sqrt" else F.col("p"))


def decide(edges: DataFrame, seed: int, reweight: str = "sqrt", flavour: str = "xx") -> DataFrame:
    """edges (with p) with coin, kept (coin < p, strictly) and new_w (null where not kept)."""
    out = coins(edges, seed, flavour).withColumn("kept", F.col("coin") < F.col("p"))
    return out.withColumn("new_w", F.when(F.col("kept"), new_weight(reweight)))


def kept(decided: DataFrame) -> DataFrame:
    return decided.where("kept").select("u", "v", F.col("new_w").alias("w"))


def delta(decided: DataFrame) -> DataFrame:
    """(u, v, change): what has to be added to each weight; unchanged ones are left out."""
    return decided.select("u", "v", (F.coalesce("new_w", F.lit(0.0)) - F.col("w")).alias("change")).where("change <> 0")


def stats(decided: DataFrame) -> DataFrame:
    """One row: original_num_edges, final_num_edges, sparsification_rate."""
    n, m = F.count(F.lit(1)), F.count_if("kept")
    return decided.agg(n.alias("original_num_edges"), m.alias("final_num_edges"), (m / n).alias("sparsification_rate"))


def uniform_half(edges: DataFrame, seed: int, flavour: str = "xx") -> DataFrame:
    """The baseline: each edge with probability one half, at twice the weight."""
    return coins(edges, seed, flavour).where("coin <= 0.5").select("u", "v", (F.col("w") / 0.5).alias("w"))
