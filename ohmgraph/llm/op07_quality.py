"""Quality rules with risk-controlled thresholds.

Each feature of a text has a fixed grid of cutoffs. Over all labelled documents, the good ones of a stratum are a
holdout for the question how often the rules would reject a good document. What is tested is always the union of the
rules: a cutoff is valid when the exact binomial (Clopper-Pearson) upper bound of the false rejection rate of "this
feature above the cutoff, or rejected by the features before it" lies below the whole risk `ALPHA`. Features come in
the order of GRID; within a feature the cutoffs are tested in a fixed order, from the one that rejects least, until
one isn't valid, which needs no further division. The last valid cutoff is used; where none is valid, and in strata
without labels, the feature rejects nothing.

The error budget `DELTA` is divided by the number of strata; of a stratum's share the first feature has a half, the
next a quarter, and so on. A feature's part is divided by the number of selections that the features before it can
end in (one for the first), as its unions depend on which was made. So with probability 1 - DELTA all chosen rules
together reject at most ALPHA of the good documents of each stratum, and a feature that rejects none of them costs the
others nothing. `labels_needed` has the good labels without which a feature gets no cutoff.

Features come from vectorised scans of the UTF-8 bytes; counts for the thresholds are summed in Spark over every
labelled document, and only the counts of strata x selections reach the driver, however many documents there are.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged row by row;
a label table with repeated doc_ids counts each document once, as good only if all its labels say so; null labels
and null doc_ids are not labelled; a null stratum is a stratum; empty tables give empty tables or no rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ALPHA, DELTA = 0.05, 0.05
REPEAT = 5
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Cutoffs tried for each feature; a document is rejected above a cutoff.
GRID = {
    "symbols_per_word": [0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0, 2.0],
    "repeat_share": [0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18],
    "dup_lines_per_word": [0.005, 0.01, 0.02, 0.05, 0.1],
    "word_length": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
    "short_words": [-4.0, -3.5, -3.0, -2.5, -2.0],
    "few_words": [-200.0, -100.0, -50.0, -30.0, -20.0],
}


def features(column: dict[str, Column] | None = None) -> dict[str, Column]:
    """The judged ratios, from the counts."""
    c = column or {x: F.col(x).cast("double") for x in _COUNTS}
    words = F.greatest(c["n_words"], F.lit(1.0))
    return {
        "symbols_per_word": c["n_symbols"] / words,
        "repeat_share": c["n_repeat_words"] / words,
        "dup_lines_per_word": c["n_dup_lines"] / words,
        "word_length": c["word_chars"] / words,
        "short_words": -c["word_chars"] / words,
        "few_words": -c["n_words"],
    }


def _same_before(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: whether an equal (row, value) stands before it, and whether there is another at all."""
    o = np.argsort(value)
    group = np.empty(len(o), np.int64)
    group[o] = np.cumsum(np.diff(value[o], prepend=value[o][:1]) != 0)
    o = C.order_by(group, np.arange(len(o)))  # equal values by place, and so by row
    same = (row[o][1:] == row[o][:-1]) & (value[o][1:] == value[o][:-1])
    before, any_ = np.zeros(len(o), bool), np.zeros(len(o), bool)
    before[o[1:]] = same
    any_[o[1:]] = same
    any_[o[:-1]] |= same
    return before, any_


def count_block(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The counts of _COUNTS for each text of a block."""
    n = len(offs) - 1
    starts, ends, first = C.word_bounds(data, offs)
    n_words = np.diff(first)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    in_words = np.concatenate(([0], np.cumsum(chars[ends] - chars[starts])))
    word_chars = in_words[first[1:]] - in_words[first[:-1]]
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    n_symbols = symbols[offs[1:]] - symbols[offs[:-1]]
    # lines: each text's bytes, cut at newlines
    breaks = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(offs) > 0)
    begin = np.sort(np.concatenate((breaks + 1, offs[:-1][full])))
    end = np.sort(np.concatenate((breaks, offs[1:][full])))
    row = np.searchsorted(offs, end, "right") - 1
    row = np.where(end == offs[np.minimum(row, n)], np.searchsorted(offs, end, "left") - 1, row)
    has_word = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, row = begin[has_word], end[has_word], row[has_word]
    by_byte = C.Rolling(C.BYTE[data])
    hashes = by_byte.at(begin, end) + (end - begin).astype(np.uint64)
    before, _ = _same_before(row, hashes)
    n_dup_lines = np.bincount(row[before], minlength=n)
    # five-word windows that the text has twice or more
    word_row = np.repeat(np.arange(n), n_words)
    at = np.flatnonzero(first[1:][word_row] - np.arange(len(starts)) >= REPEAT)
    roll = C.Rolling(C.word_hashes(by_byte, starts, ends))
    _, twice = _same_before(word_row[at], roll.at(at, at + REPEAT))
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT, -1)
    n_repeat = np.bincount(word_row[np.cumsum(cover)[:-1] > 0], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb, data, offs in C.blocks(batches):
        rest = [rb.column(i) for i in range(rb.num_columns)]
        names = rb.schema.names
        counts = [pa.array(x.astype(np.int64)) for x in count_block(data, offs)]
        keep = [i for i, x in enumerate(names) if x != "text"]
        yield pa.RecordBatch.from_arrays([rest[i] for i in keep] + counts, names=[names[i] for i in keep] + _COUNTS)


def counts(documents: DataFrame) -> DataFrame:
    """(doc_id, stratum, tag) and the counts of each row of documents (doc_id, text, lang)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("stratum"), F.xxhash64("text").alias("tag"), "text")
    return rows.mapInArrow(_count, "doc_id long, stratum string, tag long, " + ", ".join(f"{x} long" for x in _COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= x), by exact terms in logarithms."""
    if x >= n:
        return 1.0
    term = lambda k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p)
    if x <= n * p:  # the lower tail: terms grow up to x
        total, k = 0.0, x
        while k >= 0 and (t := exp(term(k) - term(x))) > 1e-17:
            total, k = total + t, k - 1
        return min(1.0, total * exp(term(x)))
    total, k = 0.0, x + 1
    while k <= n and (t := exp(term(k) - term(x + 1))) > 1e-17:
        total, k = total + t, k + 1
    return max(0.0, 1.0 - total * exp(term(x + 1)))


def valid(rejected: int, good: int, alpha: float, delta: float) -> bool:
    """Whether the Clopper-Pearson bound, at confidence 1 - delta, on the false rejection rate lies below alpha."""
    return good > 0 and binomial_cdf(rejected, good, alpha) <= delta


def shares(strata: int, delta: float = DELTA) -> list[float]:
    """Error budget of each feature in each of its chains of cutoffs, in one of so many strata."""
    out, before = [], 1
    for i, grid in enumerate(GRID.values()):
        out.append(delta / strata / 2 ** (i + 1) / before)
        before *= len(grid) + 1
    return out


def labels_needed(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, int]:
    """Good labels of a stratum from which on a feature gets a cutoff, if the rules reject none of them."""
    return {f: ceil(log(share) / log1p(-alpha)) for f, share in zip(GRID, shares(strata, delta))}


def select_rules(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """stratum -> feature -> cutoff, from labelled rows. labels: (doc_id, quality)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ratio = features()
    above = [sum((ratio[f] > cut).cast("int") for cut in grid).alias(f) for f, grid in GRID.items()]  # cutoffs that a row exceeds
    held = counted.where(~base_failed()).join(known.where("quality = 1"), "doc_id", "left_semi")
    rows = held.groupBy("stratum", *above).agg(F.count(F.lit(1)).alias("good")).collect()
    strata: dict[str | None, list] = {}
    for r in rows:
        strata.setdefault(r["stratum"], []).append(r)
    rules: dict[str | None, dict[str, float]] = {}
    for stratum, own in strata.items():
        rules[stratum] = {}
        good = np.array([r["good"] for r in own])
        hit = np.zeros(len(own), bool)
        for (f, grid), share in zip(GRID.items(), shares(len(strata), delta)):
            exceeds, chosen = np.array([r[f] for r in own]), hit
            for i, cut in reversed([*enumerate(grid)]):  # fixed sequence: the highest cutoff rejects least
                union = hit | (exceeds > i)
                if not valid(int(good[union].sum()), int(good.sum()), alpha, share):
                    break
                rules[stratum][f], chosen = cut, union
            hit = chosen
    return rules


def rejected(rules: dict[str | None, dict[str, float]]) -> Column:
    ratio = features()
    out = F.lit(False)
    for stratum, cuts in rules.items():
        hit = F.lit(False)
        for f, cut in cuts.items():
            hit = hit | (ratio[f] > cut)
        out = out | (F.col("stratum").eqNullSafe(stratum) & hit)
    return out


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, stratum, tag, the counts, base_failed and kept, a row for each row of documents."""
    counted = C.materialize(counts(documents))
    rules = select_rules(counted, labels)
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(rules))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "labels")).drop("tag", "stratum")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    key, tag = C.free_name(docs.columns, stem="key"), C.free_name(docs.columns, stem="tag")
    kept = judge(docs, C.read_table(spark, sf_dir, "labels")).where("kept").select(F.col("doc_id").alias(key), F.col("tag").alias(tag)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(tag))
    return docs.join(kept.hint("shuffle_hash"), same, "left_semi")
