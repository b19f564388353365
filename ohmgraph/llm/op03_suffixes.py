"""Suffix-array dedup over bytes: a suffix array by two-stage sorting, then adjacent common prefixes.

Which 100-byte strings occur twice is found on suffix arrays of the stretches of text around repeated anchors (see
`repeats`): stretches that share an anchor come to one task, which joins them with sentinels, sorts the suffixes
that are smaller than their successors, induces all others by scanning the buckets of first symbols, and compares
adjacent suffixes. In each run of suffixes with a common prefix of `length` the earliest stays, the others go.
Stretches of the same bytes are one string of the array, whose places stand for each of them. Blocks of text are
reduced in the same way before anything is sent. No removal rests on a hash.

Defined results: a null or empty text has no bytes and nothing removed; texts shorter than `length` keep all; matches
never cross texts; "earlier" is the smaller doc_id, then the earlier start (rows that repeat a doc_id follow in the
order of a 64-bit tag of their text, and identical rows count as one); rows with a null doc_id have no place in the order
and keep all; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

LENGTH, GRAM = 100, 20
#: Bytes of stretches that one suffix array holds (more only where one anchor has more).
CHUNK = 1 << 20
#: Symbols packed in one sort key (9 bits each).
_PACK = 7
_TODO = "k long, doc long, t long, s int, n int, kind byte, stretch binary"
_TODO_BATCH = pa.schema([("k", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("kind", pa.int8()), ("stretch", pa.binary())])


def _packed(s: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next symbols of every suffix in one integer; zeros from its sentinel on."""
    key = np.zeros(len(s), np.int64)
    padded = np.concatenate((s, np.zeros(_PACK, s.dtype))).astype(np.int64)
    for j in range(_PACK):
        key = (key << 9) | np.where(left >= j, padded[j : j + len(s)], 0)
    return key


def suffix_array(s: np.ndarray, left: np.ndarray, key: np.ndarray, depth_needed: int = 1 << 62) -> np.ndarray:
    """Order of all suffixes of s. Symbol 0 ends each string; left: symbols before that end; key: see _packed.

    Suffixes compare up to their sentinel; those that are equal, or agree in their first depth_needed symbols, come in
    any order.
    """
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int16) - s[:-1])
    step[-1] = 1
    # an equal neighbour decides as the next place that differs
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = step[at] > 0  # smaller than its successor: sorted directly
    direct = np.flatnonzero(small)
    order = direct[np.argsort(key[direct])]
    k = key[order]
    tied = np.zeros(len(order), bool)
    tied[1:] = k[1:] == k[:-1]
    depth = _PACK
    group = np.cumsum(~tied)
    live = np.arange(len(order))
    while depth < depth_needed:  # suffixes that agree so far are sorted by their next symbols
        same = np.zeros(len(live), bool)
        same[1:] = group[1:] == group[:-1]
        keep = same.copy()
        keep[:-1] |= same[1:]
        keep &= left[order[live]] >= depth
        live, group = live[keep], group[keep]
        if not len(live):
            break
        sub = order[live]
        nxt = key[np.minimum(sub + depth, n - 1)]
        o = C.order_by(group, nxt)
        order[live] = sub[o]
        nxt = nxt[o]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        group = np.cumsum(fresh)
        depth += _PACK
    sizes = np.bincount(s, minlength=257)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    fill = heads.copy()
    direct_sizes = np.bincount(s[direct], minlength=257)
    sa = np.empty(n, np.int64)
    place = np.repeat(ends - direct_sizes - np.concatenate(([0], np.cumsum(direct_sizes)[:-1])), direct_sizes) + np.arange(len(order))
    sa[place] = order
    induced = ~small
    for c in np.flatnonzero(sizes):  # what stands before a sorted suffix is sorted with it
        front = sa[heads[c] : fill[c]]
        while len(front):
            before = front[front > 0] - 1
            before = before[(s[before] == c) & induced[before]]
            sa[fill[c] : fill[c] + len(before)] = before
            fill[c] += len(before)
            front = before
        before = sa[heads[c] : ends[c]]
        before = before[before > 0] - 1
        before = before[induced[before] & (s[before] > c)]
        symbols = s[before]
        o = np.argsort(symbols, kind="stable")
        before, symbols = before[o], symbols[o]
        cut = np.flatnonzero(np.diff(symbols)) + 1
        for part in np.split(before, cut) if len(before) else ():
            d = s[part[0]]
            sa[fill[d] : fill[d] + len(part)] = part
            fill[d] += len(part)
    return sa


def common_prefix_at_least(sa: np.ndarray, left: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix of the array shares its first `length` symbols with the one before it."""
    x, y = sa[:-1], sa[1:]
    i = np.flatnonzero((left[x] >= length) & (left[y] >= length))
    for at in [*range(0, length - _PACK, _PACK), max(0, length - _PACK)]:
        i = i[key[x[i] + at] == key[y[i] + at]]
    out = np.zeros(len(sa), bool)
    out[i + 1] = True
    return out


def repeated_windows(stretches: list[bytes], order: np.ndarray, length: int) -> np.ndarray:
    """Per place in the joined stretches (each ended by a sentinel): whether a window starts there that also starts
    at a place of smaller order."""
    strings: dict[bytes, int] = {}
    which = np.fromiter((strings.setdefault(x, len(strings)) for x in stretches), np.int64, len(stretches))
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    ends = np.cumsum(lens + 1) - 1
    s = raw.astype(np.int16) + 1
    s[ends] = 0
    left = np.repeat(ends, lens + 1) - np.arange(len(s))
    key = _packed(s, left)
    sa = suffix_array(s, left, key, length)
    run = np.empty(len(s), np.int64)
    run[sa] = np.cumsum(~common_prefix_at_least(sa, left, key, length))
    if len(strings) < len(stretches):  # a string's places stand for all its stretches
        places = C.spread((ends - lens)[which], lens[which] + 1)
        run, left = run[places], left[places]
    least = np.full(int(run.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run, order)
    return (order > least[run]) & (left >= length)


def judge_stretches(texts: list[bytes], rank: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, its place in it) of every window that starts earlier too; rank: of the text, start: in it."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    at = C.spread(start, lens)
    stretch = np.repeat(np.arange(len(texts)), lens)
    hit = np.flatnonzero(repeated_windows(texts, (rank[stretch] << 34) | at, length))
    return stretch[hit], at[hit] - start[stretch[hit]]


def _decide(length: int):
    """For repeats.runs: a suffix array over the runs that look alike, neighbours joined; if they are too long for one,
    several, which part no anchor."""

    def decide(data, roll, offs, d, s, n, h, doc, rank):
        out = np.zeros(int(n.sum()), bool)
        where = np.concatenate(([0], np.cumsum(n)))  # windows before each run
        o = np.argsort(s)
        joined = np.flatnonzero(np.diff(s[o], prepend=-1) != np.concatenate(([0], n[o][:-1])))
        start, windows, of = s[o][joined], np.add.reduceat(n[o], joined), d[o][joined]
        if int((windows + length - 1).sum()) <= 2 * CHUNK:
            texts = [data[a : a + m + length - 1].tobytes() for a, m in zip(start.tolist(), windows.tolist())]
            i, p = judge_stretches(texts, rank[of], start - offs[of], length)
            hit = np.zeros(len(out), bool)  # windows by their place
            hit[(np.cumsum(windows) - windows)[i] + p] = True
            out[C.spread(where[:-1][o], n[o])] = hit
            return out
        o = np.argsort(h, kind="stable")
        lens = n[o] + length - 1
        chunk = np.cumsum(lens) // CHUNK
        chunk = chunk[np.searchsorted(h[o], h[o])]  # that of the anchor's first run
        for part in np.split(o, np.flatnonzero(np.diff(chunk)) + 1):
            texts = [data[a : a + m + length - 1].tobytes() for a, m in zip(s[part].tolist(), n[part].tolist())]
            i, p = judge_stretches(texts, rank[d[part]], (s - offs[d])[part], length)
            out[where[part[i]] + p] = True
        return out

    return decide


def _stretches(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, data, offs in C.blocks(batches):
            doc, t = C.ints(rb, "doc"), C.ints(rb, "t")
            d, s, n, k, hot = R.expanded(rb, offs)
            rank = R.order_of(doc, t)
            back = np.empty(len(doc), np.int64)
            back[rank] = np.arange(len(doc))
            span = [np.empty(0, np.int64)] * 4
            kinds = np.full(len(d), R.RUN)
            if hot.any():  # one window at a time, each under its own key; a block sends the first of equal ones
                hs, hn, hd = s[hot], n[hot], d[hot]
                again = _decide(length)(data, None, offs, hd, hs, hn, k[hot], doc, rank)
                at, hd = C.spread(hs, hn), np.repeat(hd, hn)
                span = R._spans(rank, back, doc, t, hd[again], (at - offs[hd])[again], (at - offs[hd])[again] + length)
                at, hd = at[~again], hd[~again]
                w = C.Rolling(C.BYTE[data]).quick(at, at + length)
                d, s, n = (np.concatenate(p) for p in ((d[~hot], hd), (s[~hot], at), (n[~hot], np.ones(len(at), np.int64))))
                kinds = np.repeat([R.RUN, R.HOT], [int((~hot).sum()), len(at)])
                k = np.concatenate((k[~hot], R._signed(w)))
            lens = n + length - 1
            offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
            body = pa.BinaryArray.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[C.spread(s, lens)].tobytes())])
            sk, _, sd, st, ss, sn, _ = R._span_part(*span)
            cols = [np.concatenate(p) for p in ((sk, k), (sd, doc[d]), (st, t[d]), (ss, s - offs[d]), (sn, n), (np.zeros(len(sk)), kinds))]
            arrays = [pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(cols, _TODO_BATCH)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.concat_arrays([pa.nulls(len(sk), pa.binary()), body])], schema=_TODO_BATCH)

    return work


def _compare(length: int):
    """mapInArrow function over rows sorted by k: the spans of repeated windows."""

    def judge(tb: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, t, s, n, kind = (tb.column(c).to_numpy() for c in ("doc", "t", "s", "n", "kind"))
        i = np.flatnonzero(kind != R.SPAN)
        spans = [(doc[j], t[j], s[j], s[j] + n[j]) for j in [np.flatnonzero(kind == R.SPAN)]]
        if len(i):
            doc, t, s = doc[i], t[i], s[i].astype(np.int64)
            rank = R.order_of(doc, t)
            back = np.empty(len(doc), np.int64)
            back[rank] = np.arange(len(doc))
            texts = tb.column("stretch").take(pa.array(i)).to_pylist()
            r, p = judge_stretches(texts, rank, s, length)
            r, x, e = R.merged(rank[r], s[r] + p, s[r] + p + length)
            spans.append((doc[back[r]], t[back[r]], x, e))
        cols = [np.concatenate([p[j] for p in spans]) for j in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(cols, R._SPANS)], schema=R._SPANS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for rb in batches:
            held.append(rb)
            size += rb.nbytes
            if size < CHUNK:
                continue
            tb = pa.Table.from_batches(held)
            k = tb.column("k").to_numpy()
            cut = int(np.searchsorted(k, k[-1]))  # the last anchor's rows may go on
            if cut:
                yield from judge(tb.slice(0, cut))
            rest = tb.slice(cut).combine_chunks()
            held = rest.to_batches()
            size = rest.nbytes if cut else 0  # an anchor that fills a chunk alone waits for as much again
        if held:
            yield from judge(pa.Table.from_batches(held))

    return work


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, t, s, e): byte ranges covered by strings of this length that start earlier too. docs: (doc, t, text)."""
    seen = C.written(R.judged(docs, length, gram, words=False, across=False, decide=_decide(length)))
    todo = R.with_text(docs, seen.where("n is not null").select("doc", "t", "s", "n", "k", "hot"), "todo", "inner")
    sent = todo.mapInArrow(_stretches(length), _TODO)
    # single windows of hot anchors: those that meet no other can't repeat, the others are judged in lots, with the first
    of, hot = Window.partitionBy("k"), F.col("kind") == R.HOT
    placed = sent.withColumn("met", F.count(F.lit(1)).over(of)).withColumn("nth", F.row_number().over(of.orderBy("doc", "t", "s")) - 1).where(~hot | (F.col("met") > 1))
    lots = F.sequence(F.lit(0), F.floor((F.col("met") - 1) / R.MEMBERS))
    lot = F.when(~hot, F.array(F.lit(0).cast("long"))).when(F.col("nth") == 0, lots).otherwise(F.array(F.floor(F.col("nth") / R.MEMBERS)))
    met = placed.withColumn("lot", F.explode(lot)).withColumn("k", F.when(F.col("lot") > 0, F.xxhash64("k", "lot")).otherwise(F.col("k")))
    more = met.drop("met", "nth", "lot").sortWithinPartitions("k").mapInArrow(_compare(length), "doc long, t long, s int, e int")
    return seen.where("n is null").select("doc", "t", "s", "e").unionByName(more)


def _cut(with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rb, _, _ in C.blocks([batch]):
                out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
                for text, gone in zip(rb.column("text"), rb.column("gone")):
                    raw = (text.as_py() or "").encode()
                    parts, end, spans = [], 0, 0
                    if gone.is_valid:
                        s, e = gone.values.field("s").to_numpy(), gone.values.field("e").to_numpy()
                        _, s, e = R.merged(np.zeros(len(s), np.int64), s, e)
                        for a, b in zip(s.tolist(), e.tolist()):
                            parts.append(raw[end:a])
                            end, spans = b, spans + 1
                    parts.append(raw[end:])
                    kept = b"".join(parts)
                    out["n_bytes"].append(len(raw))
                    out["n_removed"].append(len(raw) - len(kept))
                    out["n_spans"].append(spans)
                    out["kept_sha256"].append(C.sha(kept))
                    out["kept"].append(kept if with_text else None)
                yield pa.RecordBatch.from_pydict({"doc_id": rb.column("doc_id"), **out}, schema=_OUT)

    return work


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes, a row for each row."""
    rows = C.keyed(documents)
    docs = rows.where("doc is not null")
    spans = repeated_spans(docs, length, gram)
    joined = R.with_text(docs, spans, "gone", "left").withColumnRenamed("doc", "doc_id")
    none = rows.where("doc is null").select("text", F.col("doc").alias("doc_id"), F.lit(None).cast(joined.schema["gone"].dataType).alias("gone"))
    return joined.select("doc_id", "text", "gone").unionByName(none).mapInArrow(
        _cut(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.read_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g
        FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM dup)),
span AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM run GROUP BY doc_id, g),
gap AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM span),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last, string_agg(substr(h, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) AS k
        FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
