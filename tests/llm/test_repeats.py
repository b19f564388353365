import hashlib
import random
import time

import numpy as np
import pytest

from ohmgraph.llm import op03_suffixes as op3
from ohmgraph.llm import op05_substrings as op5
from ohmgraph.llm import repeats as R


def brute_bytes(docs, length):
    seen, out = {}, {}
    for d, text in sorted((d, t) for d, t in docs if d is not None):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if seen.setdefault(w, (d, i)) != (d, i):
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        out[d] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(docs, length):
    seen, out = {}, {}
    for d, text in sorted((d, t) for d, t in docs if d is not None):
        ws = (text or "").encode().split()
        gone = np.zeros(len(ws), bool)
        for i in range(len(ws) - length + 1):
            if seen.setdefault(tuple(ws[i : i + length]), d) < d:
                gone[i : i + length] = True
        kept = b" ".join(w for w, g in zip(ws, gone) if not g)
        out[d] = (len(ws), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" for i in range(25)]
    line = " ".join(rnd.choices(vocab, k=9))
    passage = " ".join(rnd.choices(vocab, k=30))
    docs = [(0, None), (1, ""), (2, "ab " * 80), (3, "ab " * 50 + "c"), (4, "x" * 300)]
    for i in range(5, n):
        words = rnd.choices(vocab, k=rnd.randint(1, 90))
        if i % 3 == 0:
            words.insert(rnd.randint(0, len(words)), line)
        if i % 7 == 0:
            words.insert(rnd.randint(0, len(words)), passage)
        text = " ".join(words)
        if i % 11 == 0 and i > 11:
            text = docs[i - 5][1]
        docs.append((i * 3 % 101 + 1000, text))
    return docs


#: FEW, MEMBERS, MANY: everything hot, lots of two runs, and the usual way
LIMITS = [(1, 64, 512), (8, 2, 512), (8, 64, 1), (8, 2, 1), (8, 64, 512)]


def limited(monkeypatch, limits):
    for name, value in zip(("FEW", "MEMBERS", "MANY"), limits):
        monkeypatch.setattr(R, name, value)


@pytest.mark.parametrize("limits", LIMITS, ids=str)
@pytest.mark.parametrize("length,gram", [(20, 6), (12, 3)])
def test_bytes_as_brute_force(spark, monkeypatch, length, gram, limits):
    limited(monkeypatch, limits)
    monkeypatch.setattr(op3, "CHUNK", 2000)
    docs = corpus(length)
    got = op3.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length, gram).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(docs, length)


@pytest.mark.parametrize("limits", LIMITS, ids=str)
def test_words_as_brute_force(spark, monkeypatch, limits):
    limited(monkeypatch, limits)
    docs = corpus(5)
    got = op5.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 6, 2).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(docs, 6)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, 1), (1, text, 2), (2, text, 3), (None, text, 4), (3, None, 5)], "doc_id long, text string, s int")
    for run in (op3.remove_repeats, op5.remove_repeats):
        rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in run(docs).collect())
        assert [x[2] == 0 for x in rows] == [True, True, False, True, True]
        assert run(docs.where("doc_id > 9")).count() == 0


def test_many_texts_of_one_id(spark):
    """1,500 different texts share a doc_id: the tag orders them for bytes; for words none comes before the other."""
    rnd = random.Random(2)
    line = " ".join(f"common{i}" for i in range(60))
    texts = [(5, " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(3, 70))) + (f" {line}" if i % 3 == 0 else "")) for i in range(1500)]
    docs = spark.createDataFrame([*texts, (4, line), (6, line + " tail"), (6, line + " tail")], "doc_id long, text string").repartition(5)
    tagged = [r.text for r in docs.where("doc_id = 5").selectExpr("text", "xxhash64(text) AS tag").orderBy("tag").collect()]
    seen, want = set(), {}
    for d, text in [(4, line), *((5, x) for x in tagged), (6, line + " tail")]:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        windows = [raw[i : i + 100] for i in range(len(raw) - 99)]
        for i, w in enumerate(windows):
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        want[d, text] = int(gone.sum())
    got = op3.remove_repeats(docs).collect()
    assert len(got) == 1503 and sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == sorted((d, len(x.encode()), want[d, x]) for d, x in [*texts, (4, line), (6, line + " tail"), (6, line + " tail")])
    got = op5.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == sorted((d, len(x.split()), 60 if line in x and d > 4 else 0) for d, x in [*texts, (4, line), (6, line + " tail"), (6, line + " tail")])


def test_words_that_collide_modulo_a_power_of_two(spark):
    word, other = "a", "b"
    while len(word) < 2048:
        word, other = word + other, other + word
    docs = spark.createDataFrame([(i, " ".join([x] * 60)) for i, x in enumerate((word, other))], "doc_id long, text string")
    assert [r.n_removed for r in op5.remove_repeats(docs).collect()] == [0, 0]


def test_suffix_array_order():
    rnd = np.random.default_rng(1)
    strings = [bytes(rnd.integers(97, 99, rnd.integers(0, 40)).tolist()) for _ in range(60)]
    lens = np.array([len(x) for x in strings])
    ends = np.cumsum(lens + 1) - 1
    s = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    s[ends] = 0
    left = np.repeat(ends, lens + 1) - np.arange(len(s))
    sa = op3.suffix_array(s, left, op3._packed(s, left))
    suffix = [bytes((s[i : i + left[i]] - 1).astype(np.uint8)) for i in range(len(s))]
    assert sorted(sa.tolist()) == list(range(len(s))) and [suffix[i] for i in sa] == sorted(suffix)
    for depth in (1, 9, 20):
        rough = [suffix[i][:depth] for i in op3.suffix_array(s, left, op3._packed(s, left), depth)]
        assert rough == sorted(rough)


def test_shuffle_files_of_runs_go_once_their_table_is_written(spark):
    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    passage = "".join(hashlib.md5(bytes([i])).hexdigest() for i in range(5))
    docs = spark.createDataFrame([(i, 0, f"{i * 7919} {passage} {i * 104729}") for i in range(40)], "doc long, t long, text string")
    before, was = files(), spark.conf.get(key)
    spans = op3.repeated_spans(docs)  # writes the runs
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(key) == was
    assert {r.doc for r in spans.collect()} == set(range(1, 40))
