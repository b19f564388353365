import random

import numpy as np
import pytest

from ohmgraph.llm import op09_minhash as op9


def brute(docs, width=4):
    sets = {}
    for d, text in docs:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        sets[d] = {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus():
    rnd = random.Random(8)
    docs = [(9000, None), (9001, ""), (9002, " \n "), (9003, "One two"), (9004, "one TWO"), (9005, "one two three four"), (9006, "K b c d")]
    i = 0
    for g in range(12):
        base = [f"w{rnd.randint(0, 4000)}" for _ in range(rnd.choice([5, 30, 80, 300]))]
        for _ in range(rnd.choice([1, 2, 6, 40])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
                words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 10**6)}"
            docs.append((7919 * i % 1009, " ".join(words)))
            i += 1
    return docs


@pytest.mark.parametrize("tile", [3, 1000])
def test_components_as_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(op9, "TILE", tile)
    docs = corpus()
    got = op9.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def thue_morse(n):
    word, other = "a", "b"
    while len(word) < n:
        word, other = word + other, other + word
    return word, other


def test_words_that_collide_modulo_a_power_of_two(spark):
    a, b = thue_morse(2048)
    docs = [(i, " ".join(x + str(j) for j in range(20))) for i, x in enumerate((a, b))]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op9.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == brute(docs)


@pytest.mark.parametrize("screened", [True, False])
def test_templated_pages(spark, monkeypatch, screened):
    """Pages of one template share buckets and don't link, but for pairs planted among them."""
    monkeypatch.setattr(op9, "TILE", 60)
    rnd = random.Random(4)
    head = [f"h{i}" for i in range(160)]
    docs = [(i, " ".join(head + [f"u{rnd.randint(0, 10**7)}" for _ in range(44)])) for i in range(240)]
    docs += [(1000 + i, docs[i][1].rsplit(" ", 12)[0] + " " + " ".join(f"v{rnd.randint(0, 10**7)}" for _ in range(12))) for i in range(0, 240, 7)]
    got = op9.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), screened=screened).collect()
    want = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len({c for _, c in want.values()}) == 240


def test_lots_of_a_hot_document(spark, monkeypatch):
    monkeypatch.setattr(op9, "FAN", 3)
    docs = corpus()
    got = op9.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 1), (1, "a b c d e", 2), (2, "a b c d e", 3), (None, "a b c d e", 4), (3, None, 5)], "doc_id long, text string, doc int")
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in op9.near_duplicates(docs).collect())
    assert got == [(-1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert op9.near_duplicates(docs.where("doc_id > 9")).count() == 0


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(0)
    for size, shared in ((40, 30), (3000, 1500)):
        x = rnd.integers(0, 2**63, size + size - shared).astype(np.uint64)
        a, b = x[:size], x[size - shared :]
        row = np.repeat([0, 1], size)
        s = op9.sketches(row, np.concatenate((a, b)), 2, 160)
        assert (s != np.uint64(2**64 - 1)).all()
        assert abs((s[0] == s[1]).mean() - shared / (2 * size - shared)) < 0.15
