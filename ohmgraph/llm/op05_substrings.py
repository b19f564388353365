"""Substring dedup over words: repeated windows of fixed length, by Rabin-Karp hashes counted in Spark.

Every window of `length` words has a Rabin-Karp hash. Windows whose anchor (see `repeats`) occurs in one place
only cannot repeat and are not sent. The hashes of all others are counted in Spark, a window being known by the 64-bit
hash of its anchor and its own 64-bit hash (modulo 2**64 and modulo a prime); a block sends only the least document of
a window that it has several times. Windows that a smaller doc_id has too merge into maximal removal intervals.

Defined results: a null or empty text has no words and nothing removed; texts shorter than the window keep all;
copies within one document do not count (`across=True`); of equal doc_ids none comes before the other; a null
doc_id has no place in the order, so such rows keep all their words; an empty table gives an empty table; further
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

WINDOW, GRAM = 50, 12


def _repeated(w: np.ndarray, h: np.ndarray, rank: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each window is also in a smaller doc of the block."""
    o, head = R.first_of(w, h, rank, at)
    out = np.zeros(len(o), bool)
    out[o] = doc[o] > doc[o][head]
    return out


def _decide(length: int):
    """For repeats.runs: windows counted by their hashes."""

    def decide(data, roll, first, d, s, n, h, doc, rank):
        at, d, h = C.spread(s, n), np.repeat(d, n), np.repeat(h, n)
        return _repeated(roll.at(at, at + length), h, rank[d], doc[d], at)

    return decide


_HASHES = pa.schema([("k", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("hashes", pa.list_(pa.int64()))])


def _windows(length: int):
    """mapInArrow function: (doc, t, text, todo) to (k, doc, t, s, e, hashes): the hashes of the windows from s on, or,
    without hashes, spans that are repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, data, offs in C.blocks(batches):
            doc, t = C.ints(rb, "doc"), C.ints(rb, "t")
            u, first = R.units_of(data, offs, True)
            d, s, n, k, hot = R.expanded(rb, first)
            roll = C.Rolling(u)
            rank = R.order_of(doc, t)
            back = np.empty(len(doc), np.int64)
            back[rank] = np.arange(len(doc))
            span = [np.empty(0, np.int64)] * 4
            if hot.any():  # one window at a time, each under its own key; a block sends only the least doc of equal ones
                hn = n[hot]
                at, hd = C.spread(s[hot], hn), np.repeat(d[hot], hn)
                w = roll.at(at, at + length)
                x = _repeated(w, np.zeros(len(w), np.int64), rank[hd], doc[hd], at)
                span = R._spans(rank, back, doc, t, hd[x], (at - first[hd])[x], (at - first[hd])[x] + length)
                at, hd, w = at[~x], hd[~x], w[~x]
                d, s, n, k = (np.concatenate(p) for p in ((d[~hot], hd), (s[~hot], at), (n[~hot], np.ones(len(at), np.int64)), (k[~hot], w.view(np.int64))))
            at = C.spread(s, n)
            hashes = roll.at(at, at + length)
            sk, _, sd, st, ss, sn, _ = R._span_part(*span)
            cols = [np.concatenate(p) for p in ((sk, k), (sd, doc[d]), (st, t[d]), (ss, s - first[d]), (ss + sn, np.zeros(len(d))))]
            arrays = [pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(cols, _HASHES)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(len(sk)), [0], np.cumsum(n))).astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*arrays, lists], schema=_HASHES)

    return work


def repeated_spans(docs: DataFrame, length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, t, s, e): word ranges covered by windows that a smaller doc also has. docs: (doc, t, text), no null."""
    seen = C.materialize(R.judged(docs, length, gram, words=True, across=True, decide=_decide(length)))
    todo = R.with_text(docs, seen.where("n is not null").select("doc", "t", "s", "n", "k", "hot"), "todo", "inner")
    runs = todo.mapInArrow(_windows(length), "k long, doc long, t long, s int, e int, hashes array<long>").repartition("k")
    # the windows of a run are dealt by its key, so counting them needs no further exchange
    each = runs.where("e = 0").select("k", "doc", "t", "s", F.posexplode("hashes").alias("i", "w"))
    counted = each.withColumn("least", F.min("doc").over(Window.partitionBy("k", "w"))).where("doc > least")
    more = counted.select("doc", "t", (F.col("s") + F.col("i")).alias("s"), (F.col("s") + F.col("i") + length).alias("e"))
    spans = runs.where("e > 0").select("doc", "t", "s", "e")
    return seen.where("n is null").select("doc", "t", "s", "e").unionByName(spans).unionByName(more)


def _cut(with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rb, _, _ in C.blocks([batch]):
                out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
                for text, gone in zip(rb.column("text"), rb.column("gone")):
                    words = (text.as_py() or "").encode().split()
                    n, keep = len(words), words
                    if gone.is_valid:
                        mask = np.zeros(n + 1, np.int64)
                        np.add.at(mask, gone.values.field("s").to_numpy(), 1)
                        np.add.at(mask, gone.values.field("e").to_numpy(), -1)
                        mask = np.cumsum(mask)[:n] > 0
                        keep = [w for w, m in zip(words, mask.tolist()) if not m]
                    kept = b" ".join(keep)
                    out["n_words"].append(n)
                    out["n_removed"].append(n - len(keep))
                    out["kept_sha256"].append(C.sha(kept))
                    out["kept"].append(kept.decode() if with_text else None)
                yield pa.RecordBatch.from_pydict({"doc_id": rb.column("doc_id"), **out}, schema=_OUT)

    return work


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def remove_repeats(documents: DataFrame, length: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text, a row for each row of documents."""
    rows = C.keyed(documents)
    docs = rows.where("doc is not null")
    spans = repeated_spans(docs, length, gram)
    joined = R.with_text(docs, spans, "gone", "left").withColumnRenamed("doc", "doc_id")
    none = rows.where("doc is null").select("text", F.col("doc").alias("doc_id"), F.lit(None).cast(joined.schema["gone"].dataType).alias("gone"))
    return joined.select("doc_id", "text", "gone").unionByName(none).mapInArrow(_cut(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.read_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM win JOIN least USING (h) WHERE doc_id > m), range(0, 50) r(j)),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
