"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Each window of four bytes gives three triplets (0 1 2, 0 1 3, 0 2 3), each hashed to one of `BUCKETS` counters. The
counters' quartiles turn each counter into two bits, so the digest holds the shape of the distribution and not its
scale; a logarithmic length and the ratios of the quartiles come first. The difference of two digests adds a bounded
penalty for length and ratios to the distances of all bucket codes, a code and its opposite counting double;
likeness is 1 minus its share of the greatest difference.

Texts are dealt once, in ranges of doc_id, so that a document and the next one meet in one sorted stream; the first
document of each range is also sent to the range before it.

Defined results: a null or empty text has the digest of no bytes; texts of under three bytes count nothing and differ
by length only; equal texts have equal digests; documents follow each other by doc_id, null first, rows that repeat
a doc_id by text; after the last comes the first, and a single document is its own next; an empty table gives an
empty table; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 128
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_TABLE = (C.BYTE >> np.uint64(8)).astype(np.uint32)
#: Penalties: a step of length, the most for length, a step of a ratio; codes differ by 0 to 3, 3 counts as 6.
_LEN_STEP, _LEN_MOST, _RATIO_STEP = 4, 60, 3
_CODE = np.array([0, 1, 2, 6])
_WORST = _LEN_MOST + 2 * 15 * _RATIO_STEP + 6 * BUCKETS


def fingerprints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """rows x (4 + BUCKETS / 4) bytes: length, ratios, then two bits a bucket."""
    n = len(offs) - 1
    size = np.diff(offs)
    counts = np.zeros(n * BUCKETS, np.int64)
    if len(data) >= 3:
        row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, size)
        left = np.repeat(offs[1:], size) - np.arange(len(data))
        mixed = [_TABLE[data] * np.uint32(m) for m in (1, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
        for salt, places in enumerate(_TRIPLETS):
            reach = max(places) + 1
            m = len(data) - reach + 1
            if m <= 0:
                continue
            h = mixed[0][:m] ^ mixed[places[1]][places[1] : places[1] + m] ^ mixed[places[2]][places[2] : places[2] + m]
            h = (h ^ np.uint32(salt * 0x27D4EB2F)) * np.uint32(0x165667B1)
            spot = row[:m] + (h >> np.uint32(25))
            counts += np.bincount(spot[left[:m] >= reach], minlength=len(counts))
    counts = counts.reshape(n, BUCKETS)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * i // 4 - 1][:, None] for i in (1, 2, 3))
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (code[:, 0::4] << 6 | code[:, 1::4] << 4 | code[:, 2::4] << 2 | code[:, 3::4]).astype(np.uint8)
    length = np.round(np.log1p(size) * 8).astype(np.int64)
    ratio = lambda q: (q[:, 0] * 15 // np.maximum(q3[:, 0], 1)).astype(np.int64)
    head = np.stack([length >> 8, length & 255, ratio(q1), ratio(q2)], axis=1).astype(np.uint8)
    return np.concatenate((head, packed), axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, down to 0 for the greatest difference; a and b: rows of fingerprints."""
    x, y = a.astype(np.int64), b.astype(np.int64)
    length = np.abs((x[:, 0] * 256 + x[:, 1]) - (y[:, 0] * 256 + y[:, 1]))
    total = np.minimum(length * _LEN_STEP, _LEN_MOST) + (np.abs(x[:, 2] - y[:, 2]) + np.abs(x[:, 3] - y[:, 3])) * _RATIO_STEP
    for shift in (0, 2, 4, 6):
        total = total + _CODE[np.abs((x[:, 4:] >> shift & 3) - (y[:, 4:] >> shift & 3))].sum(axis=1)
    return 1.0 - total / _WORST


def _digests(texts: list[bytes], block: int = 1 << 20) -> np.ndarray:
    out, lo = [np.empty((0, 4 + BUCKETS // 4), np.uint8)], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= block):
            size, hi = size + len(texts[hi]), hi + 1
        offs = np.cumsum([0, *map(len, texts[lo:hi])])
        out.append(fingerprints(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), offs))
        lo = hi
    return np.concatenate(out)


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_OUT = pa.schema(_FIELDS)
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text, text of the next document)."""
    edited = []
    for _, text, following in rows:
        q = len(text) // 4
        edited.append((text[: len(text) - q] + following[:q]).encode())
    own = _digests([r[1].encode() for r in rows])
    other = _digests(edited)
    # the next row's digest is mostly at hand
    at_hand = [i + 1 < len(rows) and rows[i + 1][1] is rows[i][2] for i in range(len(rows))]
    rest = [i for i, x in enumerate(at_hand) if not x]
    after = np.empty_like(own)
    after[[i for i, x in enumerate(at_hand) if x]] = own[[i + 1 for i, x in enumerate(at_hand) if x]]
    after[rest] = _digests([rows[i][2].encode() for i in rest])
    cols = [
        [r[0] for r in rows], [len(r[1]) for r in rows], [C.sha(x) for x in edited], [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in other],
        likeness(own, other), likeness(own, after),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, doc_id, text), the head of the next range last in each part."""
    part = text = doc = None
    held, size = [], 0
    for rb in batches:
        for p, d, x, extra in zip(*(rb.column(c).to_pylist() for c in ("part", "doc", "text", "extra"))):
            if part is not None and p == part:
                held.append((doc, text, x))
                size += len(text)
                if size > 1 << 20:
                    yield _compare(held)
                    held, size = [], 0
            part, doc, text = (None, None, None) if extra else (p, d, x)
    if held:
        yield _compare(held)


def compare_with_next(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """Digests of each document and of its edited text, and their likeness; see the module for the order."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    # several ranges for each partition, so that partitions come out even
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.approxQuantile("doc", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    cut = F.lit([int(x) for x in cuts]) if cuts else F.expr("cast(array() as array<long>)")
    part = F.when(F.col("doc").isNull(), 0).otherwise(F.size(F.filter(cut, lambda c: c <= F.col("doc"))))
    rows = docs.withColumn("part", part)
    # a row a part: the first document of each, by (doc, text)
    heads = rows.groupBy("part").agg(F.min(F.struct(F.col("doc").isNotNull().alias("known"), "doc")).alias("head")).select("part", F.col("head.doc").alias("doc")).collect()
    first = {r["part"]: r["doc"] for r in heads}
    order = sorted(first)
    if not order:
        return spark.createDataFrame([], _DDL)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    pairs = spark.createDataFrame([(p, first[p], before[p]) for p in order], "p int, d long, to int")
    hit = (F.col("part") == F.col("p")) & F.col("doc").eqNullSafe(F.col("d"))
    # of rows that share the first doc_id the least text is the head; parts are bounded in number, so is this table
    head = rows.join(F.broadcast(pairs), hit).groupBy("p", "to", "doc").agg(F.min("text").alias("text"))
    extra = head.select("doc", "text", F.col("to").alias("part"), F.lit(1).alias("extra"))
    both = rows.withColumn("extra", F.lit(0)).unionByName(extra)
    return both.repartition("part").sortWithinPartitions("part", "extra", F.col("doc").asc_nulls_first(), "text").mapInArrow(_stream, _DDL)


def op8_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(C.read_table(spark, sf_dir, "documents"))
