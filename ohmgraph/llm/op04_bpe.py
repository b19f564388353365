"""Byte-level BPE encoding and decoding with a rank queue of hierarchical bitmaps.

All pre-tokens to merge stand in one linked list of byte positions, with a sentinel after each. Each mergeable pair
waits in the bucket of its rank; two levels of bitmaps over the ranks give the lowest occupied bucket by
find-first-set; entries that a neighbour's merge has made stale are skipped when they come up. A bucket is taken as a
whole, its merges made in one go by vectors, which leaves out every second of overlapping entries ("aaaa"). That gives
the same ids as one merge at a time where no merge can bring up a pair of lower rank. This holds for a token that the
ranks rebuild from its bytes with ascending ranks; ranks at which it may not hold are found when the ranks are read
(`slow`; none in usual vocabularies), and of such a bucket only the first entry of each pre-token is taken at a time.
The list so takes a few steps a byte, however long a pre-token is.

Texts are cut at single spaces between other characters, where a match of the pattern must begin (so it is for
patterns that let a match begin with one space and otherwise keep white space apart); each different piece, and below
it each different pre-token, is encoded once for the texts of a chunk. Results serve further chunks of the task until
they take more than `REMEMBERED` bytes, and end with the task. There is no shuffle; each row is encoded where it is
read.

Defined results: a null or empty text gives no ids; special tokens are ordinary text; repeated rows and any doc_id
are encoded row by row; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Bytes that a task's earlier results may take, by a rough count; bytes of text in a chunk.
REMEMBERED, CHUNK = 48 << 20, 8 << 20
#: Characters of a long text that are cut at once.
_PART = 1 << 20
#: Strings whose ids are looked up at once.
_STEP = 1 << 16
_SPOT = re.compile(r"(?<=\S) (?=\S)")
_NONE = (1 << 31) - 1


class Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Results:
    """The ids of different strings, one after the other; strings are numbered."""

    def __init__(self) -> None:
        self.number = Numbers()
        self.ids = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)  # string i has ids[ends[i] : ends[i + 1]]
        self.bytes = 0

    def fresh(self) -> list[str]:
        """Strings that have a number and no ids yet."""
        return list(islice(self.number, len(self.ends) - 1, None))

    def add(self, ids: np.ndarray, lens: np.ndarray, size: int) -> None:
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lens)))
        self.bytes += size + 150 * len(lens) + 4 * len(ids)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these strings in turn, and how many each has."""
        starts = self.ends[numbers]
        lens = self.ends[numbers + 1] - starts
        ends = np.cumsum(lens)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for lo in range(0, len(lens), _STEP):
            hi = min(lo + _STEP, len(lens))
            ids[ends[lo] - lens[lo] : ends[hi - 1]] = self.ids[C.spread(starts[lo:hi], lens[lo:hi])]
        return ids, lens


class Queue:
    """Buckets of positions by rank: leaf[high] has a bit for each occupied rank of 256, top one for each occupied leaf."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.leaf: dict[int, int] = {}
        self.top = 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        o = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[o], positions[o]
        lo = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for r, i, j in zip(ranks[lo].tolist(), lo, [*lo[1:], len(ranks)]):
            if r in self.buckets:
                self.buckets[r].append(positions[i:j])
            else:
                self.buckets[r] = [positions[i:j]]
                high = r >> 8
                self.leaf[high] = self.leaf.get(high, 0) | 1 << (r & 255)
                self.top |= 1 << high

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank with its positions, in order, each once."""
        high = (self.top & -self.top).bit_length() - 1
        bits = self.leaf[high]
        first = bits & -bits
        rank = (high << 8) + first.bit_length() - 1
        if bits == first:
            del self.leaf[high]
            self.top ^= 1 << high
        else:
            self.leaf[high] = bits ^ first
        parts = self.buckets.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Bpe:
    """Encoder and decoder for the ranks of a .tiktoken file; pattern cuts text into pre-tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        self.pattern = pattern
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.vocab = {b: a for a, b in self.ranks.items()}
        if any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError("the ranks need every single byte")
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.end = max(self.vocab) + 1
        couples, slow = {}, set()
        for token, rank in self.ranks.items():
            halves = [(self.ranks[a], self.ranks[b]) for a, b in ((token[:i], token[i:]) for i in range(1, len(token))) if a in self.ranks and b in self.ranks]
            couples.update(dict.fromkeys(halves, rank))
            if any(max(x) > rank for x in halves) and not self._ascending(token):
                slow.update(y for x in halves for y in x if y > rank)
        keys = sorted(couples)
        self.couples = np.array([a * (self.end + 1) + b for a, b in keys] + [1 << 62], np.int64)
        self.made = np.array([couples[x] for x in keys] + [_NONE], np.int32)
        self.slow = slow

    def _ascending(self, token: bytes) -> bool:
        """Whether merges of ascending rank, lowest first, rebuild the token from its bytes."""
        parts, last = [token[i : i + 1] for i in range(len(token))], -1
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank < last or rank == _NONE:
                return False
            parts[at : at + 2], last = [parts[at] + parts[at + 1]], rank
        return True

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each couple of ids, _NONE where they don't merge."""
        key = a.astype(np.int64) * (self.end + 1) + b
        at = np.searchsorted(self.couples, key)
        at[at == len(self.couples)] = 0
        return np.where(self.couples[at] == key, self.made[at], _NONE)

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all tokens in turn, and how many each has."""
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        raw = np.frombuffer(b"\0".join(tokens) + b"\0", np.uint8)
        ends = np.cumsum(lens + 1) - 1
        n = len(raw)
        place = np.int32 if n < 1 << 31 else np.int64
        ids = np.full(n + 1, self.end, np.int32)
        ids[:n] = self.single[raw]
        ids[ends] = self.end  # merges with nothing
        after, before = np.arange(1, n + 2, dtype=place), np.arange(-1, n, dtype=place)
        rank = np.full(n + 1, _NONE, np.int32)
        for lo in range(0, n, _PART):
            hi = min(lo + _PART, n)
            rank[lo:hi] = self._rank(ids[lo:hi], ids[lo + 1 : hi + 1])
        gone = np.zeros(n + 1, bool)
        queue = Queue()
        at = np.flatnonzero(rank < _NONE).astype(place)
        queue.push(rank[at], at)
        while queue.top:
            r, p = queue.pop()
            p = p[rank[p] == r]  # the others are stale
            if not len(p):
                continue
            if r in self.slow:
                token = np.searchsorted(ends, p)
                first = np.diff(token, prepend=-1) > 0
                if not first.all():
                    queue.push(np.full(len(p) - int(first.sum()), r), p[~first])
                p = p[first]
            j = after[p]
            if len(p) > 1 and (over := j[:-1] == p[1:]).any():  # of entries in a chain every second is made stale by the one before
                i = np.arange(len(p))
                head = np.maximum.accumulate(np.where(np.append(True, ~over), i, 0))
                p = p[(i - head) % 2 == 0]
                j = after[p]
            e = after[j]
            ids[p] = r
            gone[j], rank[j] = True, _NONE
            after[p], before[e] = e, p
            rank[p] = self._rank(ids[p], ids[e])
            q = before[p]
            q, p_ = (q, p) if q[0] >= 0 else (q[1:], p[1:])
            rank[q] = self._rank(ids[q], ids[p_])
            at = np.concatenate((p, q))
            found = rank[at]
            at, found = at[found < _NONE], found[found < _NONE]
            if len(at):
                queue.push(found, at)
        keep = ~gone[:n]
        count = np.diff(np.concatenate(([0], np.cumsum(keep)[ends]))) - 1
        keep[ends] = False
        return ids[:n][keep], count

    def _tokens(self, known: Results) -> None:
        """Ids for the fresh pre-tokens."""
        raw = [x.encode() for x in known.fresh()]
        whole = [self.ranks.get(x, -1) for x in raw]
        ids, count = self.merge([x for x, r in zip(raw, whole) if r < 0])
        rank = np.array(whole, np.int64)
        lens = np.ones(len(raw), np.int64)
        lens[rank < 0] = count
        out = np.empty(int(lens.sum()), np.int64)
        own = np.repeat(rank >= 0, lens)
        out[own], out[~own] = rank[rank >= 0], ids
        known.add(out, lens, sum(map(len, raw)))

    def _pieces(self, known: Results, tokens: Results) -> None:
        """Ids for the fresh pieces, by their pre-tokens."""
        fresh = known.fresh()
        if not fresh:
            return
        find, number = regex.compile(self.pattern).findall, tokens.number.__getitem__
        numbers, counts = array("q"), array("q", [0])
        for piece in fresh:
            found = find(piece)
            counts.append(len(found))
            numbers.extend(map(number, found))
        self._tokens(tokens)
        ids, lens = tokens.of(np.frombuffer(numbers, np.int64))
        ends = np.cumsum(np.frombuffer(counts, np.int64))
        reach = np.concatenate(([0], np.cumsum(lens)))[ends]
        known.add(ids, np.diff(reach), sum(map(len, fresh)))

    def encode_all(self, texts: Iterable[str], memory: list[Results] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's begin (and end); memory: results to use and to add to."""
        memory = [] if memory is None else memory
        memory[:] = memory or [Results(), Results()]
        pieces, tokens = memory
        numbers, counts = [np.empty(0, np.int32)], [0]
        for text in texts:
            n = 0
            for part in parts(text):
                own = cut(part)
                numbers.append(np.fromiter(map(pieces.number.__getitem__, own), np.int32, len(own)))
                n += len(own)
            counts.append(n)
        self._pieces(pieces, tokens)
        ids, lens = pieces.of(np.concatenate(numbers))
        ends = np.concatenate(([0], np.cumsum(lens)))[np.cumsum(counts)]
        if pieces.bytes + tokens.bytes > REMEMBERED:
            memory[:] = [Results(), Results()]
        return ids, ends

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


def parts(text: str) -> Iterator[str]:
    """A long text in parts that are cut where cut() would."""
    lo = 0
    while len(text) - lo > _PART and (spot := _SPOT.search(text, lo + _PART)):
        yield text[lo : spot.start()]
        lo = spot.start()
    yield text[lo:] if lo else text


def cut(text: str) -> list[str]:
    """text in pieces, cut before each space that stands between two characters other than white space."""
    out: list[str] = []
    held: list[str] = []  # lines of the piece that is still open
    for line in text.split("\n"):
        words = line.split(" ")
        if not line.isprintable() or "" in words:  # other white space than single spaces inside
            words = _words(words)
        if len(words) > 1:
            held.append(words[0])
            out.append("\n".join(held))
            out.extend(map(" ".__add__, words[1:-1]))
            held = [" " + words[-1]]
        else:
            held.append(line)
    out.append("\n".join(held))
    return out if out[0] else out[1:]


def _words(words: list[str]) -> list[str]:
    """Words of a line, those joined again between which it is not to be cut."""
    out = [words[:1]]
    clean = bool(words[0]) and not words[0][-1].isspace()
    for x in words[1:]:
        if clean and x and not x[0].isspace():
            out.append([x])
        else:
            out[-1].append(x)
        clean = bool(x) and not x[-1].isspace()
    return [" ".join(x) for x in out]


def encode(documents: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids, a row for each row of documents.

    The rank file is read by the driver; its tables, whose size doesn't depend on the documents, are broadcast.
    """
    with open(ranks_path, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(Bpe(f.read(), pattern))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder: Bpe = shared.value
        digits = {i: str(i) for i in coder.vocab}
        memory: list[Results] = []
        for rb, _, _ in C.blocks(batches, max_bytes=CHUNK):
            ids, ends = coder.encode_all((x.as_py() or "" for x in rb.column("text")), memory)
            spelled, decoded = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = ids[a:b].tolist()
                spelled.append(C.sha(",".join(map(digits.__getitem__, own)).encode()))
                decoded.append(C.sha(coder.decode(own)))
            cols = [rb.column("doc_id"), pa.array(np.diff(ends)), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return documents.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(
        work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(C.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
