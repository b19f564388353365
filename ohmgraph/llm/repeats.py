"""Where windows of fixed length can occur twice, without a row per window.

A window is `length` consecutive units (bytes or words) of one text. Every window is given the anchor it
contains: the leftmost gram of `gram` units whose hash is least. Neighbouring windows share their anchor, so a
text of n units makes about 2n / (length - gram + 2) runs of windows. Equal windows have equal anchors, hence a
run whose anchor occurs nowhere else holds no repeated window and is not sent. Hashes only route: which windows of the
other runs are repeats is decided by the operator, in two places.

* In a block of texts, runs that look alike (same anchor, same hash of the units) are judged at once; runs of which
  every window is a repeat there go no further. So a block sends one run of a group of copies.
* Over all blocks, the runs of an anchor meet under its key. Runs that look alike form a class; of a class the first
  `MEMBERS` go under the key, the others, which only the first can make repeats, in lots of that many with it.

An anchor with more than `FEW` different runs in one block (the others travel under keys of their own), or with more
than `MANY` classes, is hot: the first runs of its classes are compared one window at a time, each window under a key of
its own. So no key gathers the rows of a common line or of a large group of copies, and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Different runs of one anchor that a block sends under the anchor itself.
FEW = 64
#: Runs of a class in one lot; classes of an anchor that meet under its key.
MEMBERS, MANY = 16, 4096
SPAN, RUN, HOT, HOTTER = 0, 1, 2, 3
_RUNS = "k long, c long, doc long, t long, s int, n int, kind byte"
_BATCH = pa.schema([("k", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("kind", pa.int8())])
_SPANS = pa.schema([("doc", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def slide_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """For every range of width values: the index of its least value, the leftmost on ties."""
    if len(v) < width:
        return np.empty(0, np.int64)
    pos, span = np.arange(len(v)), 1
    while span < width:
        step = min(span, width - span)
        a, b = pos[:-step], pos[step:]
        pos = np.where(v[b] < v[a], b, a)
        span += step
    return pos


def units_of(data: np.ndarray, offs: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Unit values, and the first unit of each row (n + 1 values)."""
    if not words:
        return C.BYTE[data], offs
    starts, ends, first = C.word_bounds(data, offs)
    return C.word_hashes(C.Rolling(C.BYTE[data]), starts, ends), first


def order_of(doc: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Dense rank of each row by (doc, t)."""
    o = np.lexsort((t, doc))
    new = np.ones(len(o), np.int64)
    new[1:] = (doc[o][1:] != doc[o][:-1]) | (t[o][1:] != t[o][:-1])
    rank = np.empty(len(o), np.int64)
    rank[o] = np.cumsum(new) - 1
    return rank


def merged(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals [s, e) of each d."""
    if not len(d):
        return d, s, e
    o = np.argsort((d.astype(np.int64) - d.min()) * (int(s.max()) + 1) + s)
    d, s, e = d[o], s[o], e[o]
    # ends can fall behind an earlier, longer interval: take the running maximum within d
    base = d.astype(np.int64) - d.min()
    top = int(e.max()) + 1
    reach = np.maximum.accumulate(base * top + e) - base * top
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > reach[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(d)) - 1
    return d[at], s[at], reach[last]


def first_of(key: np.ndarray, other: np.ndarray, rank: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (key, other) together, each by (rank, s), and for each place in it that of its first."""
    n = len(s)
    when = np.empty(n, np.int64)
    when[C.order_by(rank, s)] = np.arange(n)
    both = C.mix(key.view(np.uint64)) + other.view(np.uint64)
    o = np.argsort(both)
    group = np.empty(n, np.int64)
    group[o] = np.cumsum(np.diff(both[o], prepend=both[o][:1]) != 0)
    o = np.argsort(group * n + when)
    k, c = key[o], other[o]
    new = np.ones(len(o), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    return o, np.repeat(at, np.diff(np.append(at, len(o))))


def _spans(rank, row_of_rank, doc, t, d, s, e):
    r, s, e = merged(rank[d], s, e)
    d = row_of_rank[r]
    return doc[d], t[d], s, e


def spans_of(span: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(span, _SPANS)], schema=_SPANS)


def _rows(*parts: tuple) -> pa.RecordBatch:
    cols = [np.concatenate([np.asarray(p[i]).astype(f.type.to_pandas_dtype(), copy=False) for p in parts]) for i, f in enumerate(_BATCH)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BATCH)], schema=_BATCH)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def _span_part(doc, t, s, e):
    k = _signed(C.mix(doc.astype(np.uint64)))
    return k, np.zeros_like(k), doc, t, s, e - s, np.zeros(len(k), np.int8)


#: decide(data, units, bounds of the rows in units, row, start, number of windows and anchor hash of runs, doc and rank
#: of rows) -> for every window of these runs, whether it is a repeat among them
Decide = Callable[[np.ndarray, C.Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def runs(length: int, gram: int, words: bool, decide: Decide) -> Callable:
    """mapInArrow function: (doc, t, text) to the runs of each block, and to the spans repeated within it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, data, offs in C.blocks(batches):
            doc, t = C.ints(rb, "doc"), C.ints(rb, "t")
            u, first = units_of(data, offs, words)
            count = np.diff(first)
            row = np.repeat(np.arange(len(count)), count)
            if len(u) < length:
                continue
            roll = C.Rolling(u)
            grams = roll.every(gram)
            anchor = slide_argmin(grams, length - gram + 1)
            left = first[1:][row] - np.arange(len(u))
            at = np.flatnonzero(left >= length)
            if not len(at):
                continue
            a = anchor[at]
            new = np.ones(len(at), bool)
            new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
            i = np.flatnonzero(new)
            s, n, a = at[i], np.diff(np.append(i, len(at))), a[i]
            d, h = row[s], grams[a]
            c = roll.quick(s, s + n - 1 + length) ^ C.mix(((a - s) * 4096 + n).astype(np.uint64))
            rank = order_of(doc, t)
            row_of_rank = np.empty(len(doc), np.int64)
            row_of_rank[rank] = np.arange(len(doc))
            o, head = first_of(h, c, rank[d], s)
            size = np.bincount(head, minlength=len(o))[head]
            x = o[size > 1]  # runs that look alike
            span = [np.empty(0, np.int64)] * 4
            whole = np.zeros(len(s), bool)
            if len(x):
                again = decide(data, roll, first, d[x], s[x], n[x], h[x], doc, rank)
                places, of = C.spread(s[x], n[x]), np.repeat(d[x], n[x])
                span = _spans(rank, row_of_rank, doc, t, of[again], (places - first[of])[again], (places - first[of])[again] + length)
                whole[x] = np.bincount(np.repeat(np.arange(len(x)), n[x])[again], minlength=len(x)) == n[x]
            s = s - first[d]
            keep = ~whole[o]
            o, head = o[keep], head[keep]
            # how many different runs of its anchor come before each
            hk = h[o]
            fresh = np.ones(len(o), bool)
            fresh[1:] = head[1:] != head[:-1]
            nth = np.cumsum(fresh)
            top = np.ones(len(o), bool)
            top[1:] = hk[1:] != hk[:-1]
            group = np.cumsum(top) - 1
            g0 = np.flatnonzero(top)
            nth -= nth[g0][group]
            most = np.maximum.reduceat(nth, g0)[group] if len(o) else nth
            kind = np.where(nth >= FEW, HOTTER, np.where(most >= FEW, HOT, RUN)).astype(np.int8)
            key = np.where(kind == HOTTER, C.mix(hk ^ C.mix(c[o])), hk)
            yield _rows(_span_part(*span), (_signed(key), _signed(c[o]), doc[d[o]], t[d[o]], s[o], n[o], kind))

    return work


def judged(docs: DataFrame, length: int, gram: int, words: bool, across: bool, decide: Decide) -> DataFrame:
    """(doc, t, s, e, k, n, hot): spans [s, e) of units that are repeats (n null), and runs to compare: n windows from s
    on, under the key k or, if hot, each under a key of its own. across: only texts of a smaller doc make a repeat."""
    found = docs.mapInArrow(runs(length, gram, words, decide), _RUNS).repartition("k")  # one exchange for all windows
    of_key, of_class = Window.partitionBy("k"), Window.partitionBy("k", "c")
    is_span = F.col("kind") == SPAN
    seen = (
        found.withColumn("nth", F.row_number().over(of_class.orderBy("doc", "t", "s")) - 1)
        .withColumn("last", F.count(F.lit(1)).over(of_class) - 1)
        .withColumn("runs", F.sum((~is_span).cast("int")).over(of_key))
        .withColumn("hot", (F.max("kind").over(of_key) >= HOT) | (F.sum(((F.col("nth") == 0) & ~is_span).cast("int")).over(of_key) > MANY))
    )
    lot = lambda n: F.xxhash64("k", "c", n)
    place = lambda k, hot: F.struct(k.alias("k"), hot.alias("hot"))
    n_lot, no = F.floor(F.col("nth") / MEMBERS), F.lit(False)
    # the first run of a class goes under the key and along with every further lot
    lots = F.transform(F.sequence(F.lit(0), F.floor(F.col("last") / MEMBERS)), lambda i: place(F.when(i > 0, lot(i)).otherwise(F.when(F.col("hot"), lot(i)).otherwise(F.col("k"))), no))
    firsts = F.when(~F.col("hot"), lots).otherwise(F.concat(F.array(place(F.col("k"), F.lit(True))), F.when(F.col("last") > 0, lots).otherwise(F.slice(lots, 1, 0))))
    member = F.array(place(F.when((n_lot > 0) | F.col("hot"), lot(n_lot)).otherwise(F.col("k")), no))
    none = F.array(F.struct(F.lit(None).cast("long").alias("k"), F.lit(None).cast("boolean").alias("hot")))
    # a run of the same doc as its class's first may be a repeat of what the first is a repeat of, so it goes along
    along = (F.col("doc") == F.min("doc").over(of_class)) if across else F.lit(False)
    seen = seen.withColumn("along", along)
    to = F.when(is_span, none).when(F.col("nth") == 0, firsts).when(F.col("along"), F.array(place(F.col("k"), F.col("hot")))).otherwise(member)
    return (
        seen.where(is_span | (F.col("runs") > 1) | F.col("hot"))
        .select("doc", "t", "s", F.when(is_span, F.col("s") + F.col("n")).alias("e"), F.when(~is_span, F.col("n")).alias("n"), F.explode(to).alias("to"))
        .select("doc", "t", "s", "e", "n", "to.k", "to.hot")
    )


def with_text(docs: DataFrame, rows: DataFrame, name: str, how: str) -> DataFrame:
    """docs with their rows as one array; the texts are the streamed side, dealt by (doc, t) and never sorted."""
    own = [c for c in rows.columns if c not in ("doc", "t")]
    lists = rows.groupBy("doc", "t").agg(F.collect_list(F.struct(*own)).alias(name))
    return docs.join(lists.hint("shuffle_hash"), ["doc", "t"], how)


def expanded(rb: pa.RecordBatch, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs to compare in a block: row, absolute start, number of windows, key, hot."""
    lists = rb.column("todo")
    items = lists.flatten()
    d = np.repeat(np.arange(rb.num_rows), np.diff(lists.offsets.to_numpy()))
    get = lambda f: items.field(f).to_numpy(zero_copy_only=False)
    return d, first[d] + get("s"), get("n").astype(np.int64), get("k"), get("hot").astype(bool)
