"""Shared parts of the text operators: shared-folder tables, Arrow blocks, words and rolling hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import materialize, shared_dir  # noqa: F401

#: One word: anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(documents: DataFrame) -> DataFrame:
    """(doc, t, text): the key, a 64-bit tag of the text that tells apart rows that share a doc_id, the text or "".

    Where no doc_id is repeated, which is counted first, the tag is 0 throughout and costs no room."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    again = rows.where("doc is not null").groupBy("doc").count().where("count > 1").limit(1).count()
    return rows.select("doc", (F.xxhash64("text") if again else F.lit(0).cast("long")).alias("t"), "text")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """materialize(df), whose shuffle files are removed then; else they stay until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return materialize(df)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def free_name(*taken: list[str], stem: str = "own") -> str:
    """A column name that none of the lists has, whatever their case."""
    used = {x.lower() for names in taken for x in names}
    return next(x for i in range(len(used) + 1) if (x := f"_{stem}{i or ''}") not in used)


# --- Arrow blocks -----------------------------------------------------------

def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (int64, from 0) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if len(arr) == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most max_bytes of text each (one row at least), with their bytes and offsets."""
    for rb in batches:
        data, offs = text_buffers(rb.column(column))
        lo, n = 0, rb.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
            yield rb.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def ints(rb: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    col = rb.column(name)
    return (pc.fill_null(col, null) if col.null_count else col).to_numpy(zero_copy_only=False)


# --- rolling hashes, modulo 2**64 and modulo a prime --------------------------
# Modulo 2**64 alone some sequences collide for every base (Thue-Morse and its complement), modulo a prime they don't.

_BASE = 0x9E3779B97F4A7C15 | 1
PRIME, _PRIME_BASE = (1 << 31) - 1, 742_938_285
_pw = {"n": 0}
BYTE = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), np.uint64)
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pw["n"] < n:
        m = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _pw[key] = np.cumprod(x)
        for key, base in (("prime_up", _PRIME_BASE), ("prime_down", pow(_PRIME_BASE, -1, PRIME))):
            x = np.ones(m, np.uint64)
            done = 1
            while done < m:  # powers from `done` on are those from 0 on, times base ** done
                step = min(done, m - done)
                x[done : done + step] = modulo(x[:step] * np.uint64(pow(base, done, PRIME)))
                done += step
            _pw[key] = x
        _pw["n"] = m
    return _pw["up"], _pw["down"]


def modulo(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    return x - x // np.uint64(PRIME) * np.uint64(PRIME)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = np.bitwise_xor(x, x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Rabin-Karp hash of any range of a sequence of 64-bit unit values, by prefix sums."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        up, self.down = powers(n + 1)
        self.p = np.zeros(n + 1, np.uint64)
        np.cumsum(units * up[:n], out=self.p[1:])
        self.units, self.q = units, None

    def at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.q is None:  # sums of values under 2**31: their differences are exact
            self.q = np.zeros(len(self.p), np.uint64)
            np.cumsum(modulo((self.units >> np.uint64(34)) * _pw["prime_up"][: len(self.units)]), out=self.q[1:])
        x = modulo(modulo(self.q[b] - self.q[a]) * _pw["prime_down"][a])
        return mix((self.p[b] - self.p[a]) * self.down[a] + x * np.uint64(0xD6E8FEB86659FD93))

    def quick(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Modulo 2**64 only: to bring ranges together, not to tell them apart."""
        return mix((self.p[b] - self.p[a]) * self.down[a])

    def every(self, length: int) -> np.ndarray:
        """Of every range of this length, modulo 2**64 only: to pick ranges by, not to tell them apart."""
        m = len(self.p) - length
        if m <= 0:
            return np.empty(0, np.uint64)
        return mix((self.p[length:] - self.p[:m]) * self.down[:m])


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the first word of each row (n + 1 values)."""
    w = ~_SEP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty_like(w)
    after = np.empty_like(w)
    if len(w):
        before[0], before[1:] = False, w[:-1]
        after[-1], after[:-1] = False, w[1:]
    starts = np.flatnonzero(w & (~before | edge[:-1]))
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(by_byte: Rolling, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return by_byte.at(starts, ends) + (ends - starts).astype(np.uint64)


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(total)


def order_by(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Order by (major, minor); major: small integers from 0. Two plain sorts, much faster than a lexical one."""
    n = len(major)
    place = np.empty(n, np.int64)
    place[np.argsort(minor)] = np.arange(n)
    return np.argsort(major.astype(np.int64) * n + place)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
