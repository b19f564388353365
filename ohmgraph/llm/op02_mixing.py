"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets. Sources, by code point with null last, have cyclic weights and share `SHARE` of all words; a source's target
stops at `MOST` times its size, and what is above is shared among the others by weight until none is above.

Blocks. A source's documents fall into `BLOCKS` blocks by a hash of the key, so blocks are random samples. A pass over
a source takes its blocks in an order of its own, an affine permutation; the first pass, and then the second, go on
until the target is reached, inside the last block by a hash threshold. Each taken block is a draw; the draws of a
source are numbered in that order, none overlaps another.

Splitting tree. The exact numbers of draws of all sources are split among the output shards: each inner node halves
its shards and draws the left half's quotas from the multivariate hypergeometric distribution, so every shard gets
a whole number of draws, as in one global shuffle of all draws, without one. A shard takes the next of each source's
draws and shuffles its documents by a hash.

The driver holds counts for sources x blocks and sources x shards, which documents don't grow; a source's words are
summed in Spark in partial sums, so a hot source is many blocks and no single group.

Defined results: a null text has no words and is never taken unless its block is; a null source is a source, the
last; rows that repeat a doc_id are taken together; a null doc_id is a key like any other; sources without words have
target 0; an empty table gives an empty table; further columns are kept out of the way.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCKS, SHARDS, SEED = 4096, 8, 20
_RANGE = 1 << 40


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source, in the order of sizes."""
    total = share * sum(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n > 0}
    left = total
    while open_:
        unit = left / sum(weight[i] for i in open_)
        over = {i for i in open_ if unit * weight[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def permutation(source: int, turn: int, seed: int) -> tuple[int, int]:
    """(a, b) of the order in which a pass takes blocks: block x comes at (a x + b) mod BLOCKS."""
    rng = np.random.Generator(np.random.PCG64([seed, source, turn]))
    return int(rng.integers(BLOCKS // 2)) * 2 + 1, int(rng.integers(BLOCKS))


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: exact quotas of each shard. A node of the tree covers shards [lo, hi)."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if take else np.zeros_like(have)
        node(lo, mid, left)
        node(mid, hi, have - left)

    node(0, shards, np.asarray(quotas, np.int64))
    return out


def _hash(key: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"mix{seed}"), key), F.lit(BLOCKS * _RANGE))


def plan(sized: DataFrame, seed: int = SEED, shards: int = SHARDS) -> list[dict]:
    """Per source: its size, target, the full draws of each pass, the last draw's threshold, and the shards' ranges.

    sized: (source, size, spot), spot being _hash of the key."""
    block = F.floor(F.col("spot") / _RANGE).cast("int")
    found = sized.groupBy("source", block.alias("block")).agg(F.sum("size").alias("words")).collect()  # sources x BLOCKS at most
    names = sorted({r["source"] for r in found}, key=lambda x: (x is None, x or ""))
    words = {s: np.zeros(BLOCKS, np.int64) for s in names}
    for r in found:
        words[r["source"]][r["block"]] = r["words"]
    sizes = [int(words[s].sum()) for s in names]
    wanted = targets(sizes)
    out = []
    for i, s in enumerate(names):
        p = {"source": s, "source_size": sizes[i], "target": wanted[i], "draws": 0, "turns": []}
        left = wanted[i]
        for turn in range(math.ceil(MOST)):
            a, b = permutation(i, turn, seed)
            order = (np.arange(BLOCKS) - b) * pow(a, -1, BLOCKS) % BLOCKS  # the block at each place
            reach = np.cumsum(words[s][order])
            full = int(np.searchsorted(reach, left + 1e-6, "right")) if left > 0 else 0
            rest = left - (reach[full - 1] if full else 0)
            p["turns"].append({"a": a, "b": b, "full": full, "last": int(order[full]) if 0 < full < BLOCKS or left > 0 and full == 0 else None, "rest": float(rest), "first_draw": p["draws"], "cut": -1})
            if full < BLOCKS and left > 0:
                p["draws"] += full + 1
                left = 0
            else:
                p["draws"] += full
                left = max(0.0, left - reach[-1])
        out.append(p)
    ends = np.cumsum(split(np.array([p["draws"] for p in out], np.int64), shards, seed), axis=0) if out else np.zeros((shards, 0), np.int64)
    for i, p in enumerate(out):
        p["ends"] = [int(x) for x in ends[:, i]]
    return out


def _thresholds(sized: DataFrame, made: list[dict]) -> None:
    """Sets how far into its last block each pass goes: the hash up to which the words come nearest to the rest."""
    open_ = [(i, k, t["last"], t["rest"]) for i, p in enumerate(made) for k, t in enumerate(p["turns"]) if t["last"] is not None]
    if not open_:
        return
    spark = sized.sparkSession
    names = spark.createDataFrame([(i, p["source"]) for i, p in enumerate(made)], "i int, s string")
    cuts = spark.createDataFrame(open_, "i int, k int, block int, rest double")
    want = cuts.join(names, "i")
    block = F.floor(F.col("spot") / _RANGE).cast("int").alias("block")
    rows = sized.select("source", "size", "spot", block).join(F.broadcast(want), "block").where(F.col("source").eqNullSafe(F.col("s")))
    of = Window.partitionBy("i", "k")
    reach = rows.groupBy("i", "k", "rest", "spot").agg(F.sum("size").alias("size")).withColumn("reach", F.sum("size").over(of.orderBy("spot")))
    near = reach.where(F.col("reach") - F.col("size") / 2 <= F.col("rest"))  # nearer with the row than without
    for r in near.groupBy("i", "k").agg(F.max("spot").alias("spot")).collect():  # a row a pass
        made[r["i"]]["turns"][r["k"]]["cut"] = r["spot"]


def mix(rows: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", seed: int = SEED, shards: int = SHARDS, prefix: str = "") -> DataFrame:
    """rows plus (each name with prefix) source_size, target, taken, shards (the shard of each time taken), spot.

    Columns of rows that have one of these names are replaced."""
    sized_ = C.materialize(rows.select(F.col(source).alias("source"), F.col(size).cast("long").alias("size"), _hash(key, seed).alias("spot")))
    made = plan(sized_, seed, shards)
    _thresholds(sized_, made)
    own, turns, ends_ = (C.free_name(rows.columns, stem=x) for x in ("source", "turns", "ends"))
    turn = "array<struct<a:long,b:long,full:long,first:long,cut:long,last:long>>"
    table = rows.sparkSession.createDataFrame(
        [(p["source"], p["source_size"], float(p["target"]), [(t["a"], t["b"], t["full"], t["first_draw"], t["cut"], -1 if t["last"] is None else t["last"]) for t in p["turns"]], p["ends"]) for p in made],
        f"{own} string, {prefix}source_size long, {prefix}target double, {turns} {turn}, {ends_} array<long>",
    )
    spot = F.col(f"{prefix}spot")
    block = F.floor(spot / _RANGE)
    at = lambda t: F.pmod(t["a"] * block + t["b"], F.lit(BLOCKS))
    hit = lambda t: (at(t) < t["full"]) | ((block == t["last"]) & (spot <= t["cut"]))
    draws = F.transform(F.filter(turns, hit), lambda t: t["first"] + at(t))
    shard = F.transform(draws, lambda d: F.size(F.filter(ends_, lambda e: e <= d)))
    # one small row a source, as many as plan() has counted: a broadcast of bounded size
    given = rows.drop(*(f"{prefix}{x}" for x in ("source_size", "target", "taken", "shards", "spot")))
    joined = given.withColumn(f"{prefix}spot", _hash(key, seed)).join(F.broadcast(table), F.col(source).eqNullSafe(F.col(own)), "left")
    joined = joined.withColumn(f"{prefix}shards", shard)
    return joined.withColumn(f"{prefix}taken", (F.col(size) * F.size(f"{prefix}shards")).cast("long")).drop(own, turns, ends_)


def dealt(mixed: DataFrame, prefix: str = "", partitions_per_shard: int | None = None) -> DataFrame:
    """A row for each time a row is taken, with its shard; each shard is dealt to several tasks and shuffled there.

    Unless told, a shard has parts as the shuffle has partitions, four times over for all shards together."""
    if partitions_per_shard is None:
        partitions_per_shard = max(16, 4 * int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    rows = mixed.withColumn(f"{prefix}shard", F.explode(f"{prefix}shards"))
    part = F.pmod(F.xxhash64(f"{prefix}spot", f"{prefix}shard"), F.lit(partitions_per_shard))
    return rows.repartition(f"{prefix}shard", part).sortWithinPartitions(f"{prefix}shard", F.xxhash64(F.lit("order"), f"{prefix}spot", f"{prefix}shard"))


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def op2_hypergeometric_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.materialize(C.read_table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("size")))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken", "shards")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, shuffled within its shards, with all its columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # out of the way of all other names
    return dealt(mix(docs.select("doc_id", "source", words().alias("size"), row))).select("row.*")
