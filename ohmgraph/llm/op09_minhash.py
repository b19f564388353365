"""MinHash near-dedup with fast similarity sketching, banding and exact verification.

Sketch: k bins are filled in 2k rounds. In round i < k every element is hashed to one bin with value i + h; in round
k + j every element goes to bin j, so no bin stays empty. A bin keeps its least value. The rounds stop once all bins
are full, after which later rounds, with greater values, can't change any; sets of k ln k elements or more so need
about one round. Two sets agree in a bin with probability J, with the concentration of k independent bins.

Banding: `BANDS` bands of `ROWS` bins; a pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**32,
about 3e-6. Verification counts the shingles of both whole texts.

Documents with equal sets form a class first; only its smallest doc_id goes on. A bucket's members are compared with
its smallest member and with the next in a random order of each band, which joins nearly all of a large group at two
pairs a member and band at most. In buckets where more than one component is left, every member outside the largest
is then held against all members of other components, in tiles of a bounded number of members. Two sketches screen
the pairs there, the one that has the bands (`NEAR` bins must agree) and a wider one of `WIDE` bins (`WIDE_NEAR`), each
more than 6 deviations below 0.8, so that a pair of 0.8 is lost with probability under 1e-8, far less than banding
loses; `screened=False` does without. What is left is verified, in the first band that the pair shares, and only links
leave the task. Pairs inside a component, which can't change the result, are never made.

The pairs of a document that has more than `FAN` of them are dealt by salt, each lot with its own copy of the text.

Defined results: null and empty texts have no set and link with nothing; rows that repeat a doc_id are one node; a
null doc_id has no component and is kept; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components
from . import common as C

SHINGLE, NUM, DEN = 4, 80, 100
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Bins of a pair's sketches that agree at least before its texts are compared; members of a tile; pairs of a lot.
NEAR, WIDE, WIDE_NEAR, TILE, FAN = 96, 1024, 736, 800, 1000
_SEED = 0x5851F42D4C957F2D


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, by row; a text of fewer words has one, of all its words."""
    if lower:
        data = C.LOWER[data]
    starts, ends, first = C.word_bounds(data, offs)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(first[1:][row] - np.arange(len(row)) >= width)
    short = np.flatnonzero((n > 0) & (n < width))
    roll = C.Rolling(C.word_hashes(C.Rolling(C.BYTE[data]), starts, ends))
    h = np.concatenate((roll.at(at, at + width), C.mix(roll.at(first[short], first[short + 1]) + n[short].astype(np.uint64))))
    row = np.concatenate((row[at], short))
    o = C.order_by(row, h)
    row, h = row[o], h[o]
    new = np.ones(len(o), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def sketches(row: np.ndarray, h: np.ndarray, rows: int, bins: int = BINS) -> np.ndarray:
    """rows x bins least values of the sets (row, h); rows without an element stay at the top value."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((rows, bins), top, np.uint64)
    flat = out.reshape(-1)
    bits = (2 * bins).bit_length()  # of the round's number, in front of the value
    for i in range(2 * bins):
        if not len(h):
            break
        x = C.mix(h + np.uint64(_SEED * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        spot = ((x >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, row * bins + spot, (C.mix(x) >> np.uint64(bits)) | np.uint64(i << (64 - bits)))
        if i < 16 or i % (i // 8) == 0:  # more rounds than needed change nothing
            keep = (out == top).any(axis=1)[row]
            row, h = row[keep], h[keep]
    return out


_PROFILE = pa.schema([("doc", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _profile(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, data, offs in C.blocks(batches, max_bytes=1 << 21):
            row, h = shingle_sets(data, offs, width)
            n = np.bincount(row, minlength=rb.num_rows)
            full = np.flatnonzero(n)
            at = np.cumsum(n[full]) - n[full]
            a, b = np.zeros(rb.num_rows, np.uint64), np.zeros(rb.num_rows, np.uint64)
            bands = np.zeros((rb.num_rows, BANDS), np.uint64)
            short = np.zeros((rb.num_rows, BINS), np.uint16)
            if len(full):
                a[full] = np.add.reduceat(C.mix(h), at)
                b[full] = np.add.reduceat(C.mix(h ^ np.uint64(_SEED)), at)
                sketch = sketches(np.repeat(np.arange(len(full)), n[full]), h, len(full)).reshape(len(full), BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(full), BANDS)).copy()
                for j in range(ROWS):
                    key = C.mix(key * np.uint64(3) + sketch[:, :, j])
                bands[full] = key
                short[full] = (C.mix(sketch) >> np.uint64(48)).astype(np.uint16).reshape(len(full), BINS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([rb.column("doc"), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists, pa.array([x.tobytes() for x in short], pa.binary())], schema=_PROFILE)

    return work


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    out: list[np.ndarray] = []
    for rb, data, offs in C.blocks([pa.RecordBatch.from_arrays([texts], names=["text"])]):
        row, h = shingle_sets(data, offs, width)
        out += np.split(h, np.searchsorted(row, np.arange(1, rb.num_rows)))
    return out


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * common >= NUM * (len(a) + len(b) - common)


def _verify(width: int):
    """mapInArrow function over (u, v, left, right): the pairs whose sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rb, _, _ in C.blocks([batch], "left"):
                keep = [_similar(a, b) for a, b in zip(_sets(rb.column("left"), width), _sets(rb.column("right"), width))]
                yield pa.RecordBatch.from_arrays([rb.column("u"), rb.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return work


_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _wide(sets: list[np.ndarray]) -> np.ndarray:
    """A byte for each of WIDE bins of the sets' sketches."""
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    return (C.mix(sketches(np.repeat(np.arange(len(sets)), lens), np.concatenate(sets), len(sets), WIDE)) >> np.uint64(56)).astype(np.uint8)


def _held_against(width: int, screened: bool):
    """mapInArrow function over (key, i, j, band, apart, doc, comp, sketch, text), sorted by (key, i, j): rows that are
    apart against the others of their tile; the links between different components."""

    def judge(tb: pa.Table) -> pa.RecordBatch:
        get = lambda c: tb.column(c).to_numpy()
        doc, comp, apart, band = get("doc"), get("comp"), get("apart").astype(bool), int(get("band")[0])
        sketch = np.frombuffer(b"".join(tb.column("sketch").to_pylist()), np.uint16).reshape(len(doc), BINS)
        every, out, sets, wide = np.flatnonzero(~apart), [], None, None
        own = sketch[every]
        for i in np.flatnonzero(apart):
            same = own == sketch[i]
            k = np.flatnonzero(((same.sum(axis=1) >= NEAR) | (not screened)) & (comp[every] != comp[i]))
            if len(k):  # told in the first band that both share
                k = every[k[same[k].reshape(len(k), BANDS, ROWS).all(axis=2).argmax(axis=1) == band]]
            if len(k):
                if sets is None:
                    sets = _sets(tb.column("text").combine_chunks(), width)
                    wide = _wide(sets) if screened else None
                if screened:
                    k = k[(wide[k] == wide[i]).sum(axis=1) >= WIDE_NEAR]
                out += [sorted((int(doc[i]), int(doc[x]))) for x in k if _similar(sets[i], sets[x])]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], schema=_PAIR)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for rb in batches:
            if not rb.num_rows:
                continue
            name = np.stack([rb.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = np.flatnonzero((name[:, 1:] != name[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, rb.num_rows]):
                if last is not None and tuple(name[:, lo]) != last:
                    yield judge(pa.Table.from_batches(held))
                    held = []
                held.append(rb.slice(lo, hi - lo))
                last = tuple(name[:, lo])
        if held:
            yield judge(pa.Table.from_batches(held))

    return work


def _left_over(met: DataFrame, known: DataFrame, heads: DataFrame, texts: DataFrame, width: int, screened: bool) -> DataFrame:
    """Links between different components that share a bucket, as a table."""
    of = Window.partitionBy("key")
    placed = met.join(known.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc"))
    mixed = placed.withColumn("lo", F.min("comp").over(of)).withColumn("hi", F.max("comp").over(of)).where("lo <> hi and size > 2")
    mixed = C.materialize(mixed.select("key", "band", "doc", "comp", "size"))
    sizes = mixed.groupBy("key", "comp").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"), F.col("m.count").alias("most"))
    rows = mixed.join(main, "key").join(heads.select("doc", "sketch").join(texts, "doc"), "doc")
    tiles = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    spot = F.xxhash64(F.lit("tile"), "doc")
    t, ta = tiles(F.col("size")), tiles(F.col("size") - F.col("most"))
    all_tiles = lambda n: F.sequence(F.lit(0), n - 1)
    cols = ["key", "band", "doc", "comp", "sketch", "text"]
    members = rows.select(*cols, F.lit(0).alias("apart"), F.pmod(spot, t).cast("int").alias("i"), F.explode(all_tiles(ta)).alias("j"))
    apart = rows.where("comp <> main").select(*cols, F.lit(1).alias("apart"), F.explode(all_tiles(t)).alias("i"), F.pmod(spot, ta).cast("int").alias("j"))
    both = members.unionByName(apart).select("key", "i", "j", "band", "apart", "doc", "comp", "sketch", "text")
    return C.materialize(both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_held_against(width, screened), "u long, v long"))


def _links(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (u, v) that are similar, as a table."""
    lots = F.ceil(F.col("n") / FAN).cast("int")
    dealt = pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("u"))).select("u", "v", F.pmod(F.xxhash64("v"), lots).cast("int").alias("lot"))
    copies = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select("u", F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot"))
    left = texts.select(F.col("doc").alias("u"), F.col("text").alias("left")).join(copies.hint("shuffle_hash"), "u")
    right = texts.select(F.col("doc").alias("v"), F.col("text").alias("right"))
    both = left.join(dealt.hint("shuffle_hash"), ["u", "lot"]).join(right, "v").select("u", "v", "left", "right")
    return C.materialize(both.mapInArrow(_verify(width), "u long, v long"))


def near_duplicates(documents: DataFrame, width: int = SHINGLE, screened: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of documents (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    profile = C.materialize(docs.mapInArrow(_profile(width), "doc long, n_shingles long, a long, b long, bands array<long>, sketch binary"))
    sets = profile.where("n_shingles > 0 and doc is not null")
    classes = sets.groupBy("a", "b").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("members"))
    heads = sets.join(classes.select(F.col("head").alias("doc"), "a", "b"), ["doc", "a", "b"], "left_semi").dropDuplicates(["doc", "a", "b"])
    # bucket rows of the classes' heads, only those that meet another
    of = Window.partitionBy("key")
    rows = heads.select("doc", F.posexplode("bands").alias("band", "key")).withColumn("before", F.lag("doc").over(of.orderBy(F.xxhash64("doc", "key"), "doc")))
    rows = rows.withColumn("least", F.min("doc").over(of)).withColumn("size", F.count(F.lit(1)).over(of))
    met = C.materialize(rows.where("size > 1"))
    some = met.select("doc").distinct()
    texts = C.materialize(docs.join(some.hint("shuffle_hash"), "doc", "left_semi").dropDuplicates(["doc"]))
    other = F.explode(F.array_distinct(F.array_compact(F.array("least", "before"))))
    pairs = met.select("doc", other.alias("other")).where("doc <> other").select(F.least("doc", "other").alias("u"), F.greatest("doc", "other").alias("v")).distinct()
    links = _links(pairs, texts, width)
    known = components(links)
    more = _left_over(met, known, heads, texts, width, screened)
    if more.limit(1).count():
        known = components(links.unionByName(more))
    heads_in = classes.join(known.withColumnRenamed("node", "head"), "head", "left").select("a", "b", F.coalesce("component", "head").alias("component_id"))
    linked = profile.join(heads_in, ["a", "b"], "left")
    return linked.select(
        F.col("doc").alias("doc_id"),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with all its columns."""
    own = C.free_name(docs.columns)
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_semi")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS head FROM (SELECT doc_id, md5(string_agg(h, ',' ORDER BY h)) AS k FROM sh GROUP BY doc_id)),
hs AS (SELECT sh.* FROM sh JOIN cls USING (doc_id) WHERE doc_id = head),
both_ AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM hs x JOIN hs y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT DISTINCT u AS a, u AS b FROM edge UNION SELECT r.a, e.v FROM reach r JOIN edge e ON e.u = r.b),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m, head, w.doc_id) AS component_id,
       w.doc_id = coalesce(m, head, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON a = head
"""
