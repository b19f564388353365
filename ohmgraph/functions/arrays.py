"""The bits of `hashing` over numpy arrays, many columns at a time, for tasks that work on arrays of edges.

`bits32` gives the same numbers as `hashing.bits32` does for keys that are ints (before and after), longs (the arrays).
Text is made once an edge, not once a column.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Elements that a step works on at once, so that its arrays stay in a core's cache.
BLOCK = 1 << 14

_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_M64 = (1 << 64) - 1
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def bits32(role: str, before: Sequence[int], arrays: Sequence[np.ndarray], after: Sequence[int | None], seed: int, flavour: str) -> np.ndarray:
    """(len(after), n) of 32 random bits: a row for each key that comes after the arrays (None: no such key)."""
    arrays = [np.ascontiguousarray(x, dtype=np.int64) for x in arrays]
    out = np.empty((len(after), len(arrays[0])), dtype=np.uint32)
    if flavour == "md5":
        head = "".join(f"{x}," for x in (role, *before)).encode()
        _md5(head, arrays, [b"," + (f"{j}," if j is not None else "").encode() + str(seed).encode() for j in after], out)
    else:
        _xx(role, before, arrays, after, seed, out)
    return out


# --- xxhash64, chained over the columns as Spark does ---------------------------------------------

def _u(x: int) -> np.uint64:
    return np.uint64(x & _M64)


def _turn(x, r: int):
    out = x << np.uint64(r)
    out |= x >> np.uint64(64 - r)
    return out


def _mixed(h):
    t = h >> np.uint64(33)
    t ^= h
    t *= _u(_P2)
    t ^= t >> np.uint64(29)
    t *= _u(_P3)
    t ^= t >> np.uint64(32)
    return t


def _word8(h, x):
    return _turn(h ^ (_turn(x * _u(_P2), 31) * _u(_P1)), 27) * _u(_P1) + _u(_P4)


def _word4(h, x):
    out = _turn(h ^ (x * _u(_P1)), 23)
    out *= _u(_P2)
    out += _u(_P3)
    return out


def _int(h, x: int):
    """A Python number is an int column where it fits, else a long one."""
    if -(1 << 31) <= x < 1 << 31:
        return _mixed(_word4(h + _u(_P5 + 4), _u(x & 0xFFFFFFFF)))
    return _mixed(_word8(h + _u(_P5 + 8), _u(x)))


def _text(h, x: bytes):
    if len(x) >= 32:
        raise ValueError("roles are short")
    h = h + _u(_P5 + len(x))
    while len(x) >= 8:
        h, x = _word8(h, _u(int.from_bytes(x[:8], "little"))), x[8:]
    if len(x) >= 4:
        h, x = _word4(h, _u(int.from_bytes(x[:4], "little"))), x[4:]
    for c in x:
        h = _turn(h ^ (_u(c) * _u(_P5)), 11) * _u(_P1)
    return _mixed(h)


def _xx(role: str, before: Sequence[int], arrays: list[np.ndarray], after: Sequence[int | None], seed: int, out: np.ndarray) -> None:
    with np.errstate(over="ignore"):
        lead = _text(np.full(1, 42, dtype=np.uint64), role.encode())
        for x in before:
            lead = _int(lead, x)
        for a in range(0, out.shape[1], BLOCK):
            h = lead
            for x in arrays:
                h = _mixed(_word8(h + _u(_P5 + 8), x[a : a + BLOCK].view(np.uint64)))
            if any(j is not None and not -(1 << 31) <= j < 1 << 31 for j in (*after, seed)):
                for i, j in enumerate(after):
                    out[i, a : a + BLOCK] = _int(h if j is None else _int(h, j), seed)
                continue
            t, s = np.empty_like(h), np.empty_like(h)  # as _int does, in place
            for i, j in enumerate(after):
                t[:] = h
                for x in (seed,) if j is None else (j, seed):
                    t += _u(_P5 + 4)
                    t ^= _u((x & 0xFFFFFFFF) * _P1)
                    np.left_shift(t, np.uint64(23), out=s)
                    t >>= np.uint64(41)
                    t |= s
                    t *= _u(_P2)
                    t += _u(_P3)
                    for r, m in ((33, _P2), (29, _P3), (32, 1)):
                        np.right_shift(t, np.uint64(r), out=s)
                        t ^= s
                        if m != 1:
                            t *= _u(m)
                out[i, a : a + BLOCK] = t


# --- MD5 of texts of one block -----------------------------------------------------------------

def _digits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the decimal text by row, its length)."""
    values, at = np.unique(x, return_inverse=True)
    text = values.astype("S20")
    return text.view(np.uint8).reshape(len(values), 20)[at], np.char.str_len(text).astype(np.int64)[at]


def _md5(head: bytes, arrays: list[np.ndarray], tails: list[bytes], out: np.ndarray) -> None:
    if not out.size:
        return
    parts = [_digits(x) for x in arrays]
    kind = np.zeros(out.shape[1], dtype=np.int64)
    for _, n in parts:
        kind = kind * 32 + n
    order = np.argsort(kind, kind="stable")
    edges = np.flatnonzero(np.diff(kind[order])) + 1
    for group in np.split(order, edges):
        for a in range(0, len(group), BLOCK):
            rows = group[a : a + BLOCK]
            text = np.zeros((len(rows), 128), dtype=np.uint8)
            text[:, : len(head)] = np.frombuffer(head, dtype=np.uint8)
            at = len(head)
            for i, (chars, n) in enumerate(parts):
                if i:
                    text[:, at] = ord(",")
                    at += 1
                size = int(n[rows[0]])
                text[:, at : at + size] = chars[rows, :size]
                at += size
            words = np.ascontiguousarray(text[:, :56].view("<u4").T) if at < 56 else None
            for i, tail in enumerate(tails):
                if at + len(tail) > 55:  # more than one block; rare, so plainly
                    out[i, rows] = [int.from_bytes(hashlib.md5(t[:at].tobytes() + tail).digest()[:4], "big") for t in text]
                else:
                    out[i, rows] = _md5_block(words, at, tail)


def _md5_block(words: np.ndarray, at: int, tail: bytes) -> np.ndarray:
    """First 32 bits of the digest of texts of at bytes (their words by row) with tail behind them."""
    fixed = np.zeros(64, dtype=np.uint8)
    fixed[at : at + len(tail)] = np.frombuffer(tail, dtype=np.uint8)
    fixed[at + len(tail)] = 0x80
    fixed[56:] = np.frombuffer(((at + len(tail)) * 8).to_bytes(8, "little"), dtype=np.uint8)
    fixed = fixed.view("<u4")
    varied = {i: words[i] if not fixed[i] else words[i] | fixed[i] for i in range(-(-at // 4))}
    n = words.shape[1]
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in start)
    f = np.empty(n, dtype=np.uint32)
    for i in range(61):  # the first word is not changed after
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        g = _WORDS[i]
        np.add(f, a, out=f)
        if g in varied:
            np.add(f, varied[g], out=f)
            np.add(f, np.uint32(_SINES[i]), out=f)
        else:
            np.add(f, np.uint32((_SINES[i] + int(fixed[g])) & 0xFFFFFFFF), out=f)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=a)  # a is free from here on
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
        np.bitwise_or(a, f, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    np.add(b, np.uint32(start[0]), out=b)
    return b.byteswap()


# --- numbers from bits, rows from batches ---------------------------------------------------------

def uniform(bits: np.ndarray) -> np.ndarray:
    return (bits + 0.5) * (2 / 4294967296.0) - 1.0


def sign(bits: np.ndarray) -> np.ndarray:
    return np.where(bits >= 1 << 31, 1.0, -1.0)


def coin(bits: np.ndarray) -> np.ndarray:
    return (bits + 0.5) / 4294967296.0


def chunks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches of a task, put together to tables of about so many rows; empty ones are passed over."""
    held, n = [], 0
    for b in plain(batches):
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed(names: Sequence[str], columns: Sequence[np.ndarray], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Arrays of 64-bit numbers as rows of binary values, each of so many numbers: integers of u and v, else doubles."""
    cast = [np.ascontiguousarray(x, dtype=np.int64 if c in "uv" else float) for c, x in zip(names, columns, strict=True)]
    for a in range(0, len(cast[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array([x[a : a + rows].tobytes()], pa.binary()) for x in cast], list(names))


def dealt(part: np.ndarray, names: Sequence[str], columns: Sequence[np.ndarray], by: str) -> Iterator[pa.RecordBatch]:
    """Columns of 64-bit numbers by the task that part gives: packed to a row a task."""
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    ends = [*first[1:], len(part)]
    if len(parts):
        cut = [[x[i:j].tobytes() for i, j in zip(first, ends, strict=True)] for x in (c[order] for c in columns)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *[pa.array(x, pa.binary()) for x in cut]], [by, *names])


def plain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as they are; of packed ones a batch a row, its binary columns as the numbers that they hold."""
    for b in batches:
        if not pa.types.is_binary(b.schema.field("u").type if "u" in b.schema.names else pa.null()):
            yield b
            continue
        for row in range(b.num_rows):
            cells = [(c, b.column(c)[row].as_buffer()) for c in b.schema.names if pa.types.is_binary(b.schema.field(c).type)]
            kinds = [pa.int64() if c in "uv" else pa.float64() for c, _ in cells]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(t, x.size // 8, [None, x]) for t, (_, x) in zip(kinds, cells, strict=True)], [c for c, _ in cells])


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False) if table.num_rows else np.empty(0)


def lists(x: np.ndarray) -> pa.Array:
    """The rows of x as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.array(np.ascontiguousarray(x, dtype=float).reshape(-1)))


def unlisted(table: pa.Table, name: str, k: int) -> np.ndarray:
    """A column of lists of k numbers as an array of k columns."""
    flat = table.column(name).combine_chunks()
    flat = pa.concat_arrays([c.flatten() for c in flat.chunks]) if isinstance(flat, pa.ChunkedArray) else flat.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, k)
