import re
import zlib

import numpy as np

from ohmgraph.llm import op01_sharding as op1
from ohmgraph.llm import op07_quality as op7


def test_rendezvous(spark):
    docs = spark.createDataFrame([(i if i else None, "t" * (i % 7), 1) for i in range(3000)] + [(5, "again", 2)], "doc_id long, text string, shard int")
    rows = docs.selectExpr("doc_id", "cast(length(text) as long) size", "crc32(text) text_crc32")
    got = op1.assign(rows, "doc_id", dict.fromkeys(range(8), 1.0), ["size", "text_crc32"]).withColumn("grown", op1.rendezvous("doc_id", dict.fromkeys(range(9), 1.0))).collect()
    assert len(got) == 3001
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 250 < len(slots) < 500
    assert all(r.grown in (r.shard, 8) for r in got) and 200 < sum(r.grown == 8 for r in got) < 480
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    heavy = docs.select(op1.rendezvous("doc_id", {0: 3.0, 1: 1.0}).alias("s")).where("s = 0").count()
    assert 0.70 < heavy / 3001 < 0.80
    assert op1.assign(rows.where("doc_id = -1"), "doc_id", {0: 1.0}, ["size"]).count() == 0


def test_slots_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(op1, "GROUP_ROWS", 20)
    got = op1.assign(spark.range(1000).withColumnRenamed("id", "doc_id"), "doc_id", {0: 1.0, 1: 2.0}, []).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_rows_of_one_key_are_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(op1, "GROUP_ROWS", 50)
    rows = spark.range(2000).selectExpr("if(id % 3 = 0, id, null) doc_id", "id % 500 size", "id text_crc32")
    out = op1.assign(rows, "doc_id", dict.fromkeys(range(4), 1.0), ["size", "text_crc32"])
    got = out.collect()
    hot = {r.shard for r in got if r.doc_id is None}
    assert len(got) == 2000 and len(hot) == 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    slots = sorted(r.slot for r in got if r.doc_id is None)
    assert slots[-1] - slots[0] >= len(slots)  # rows of other keys lie between
    again = op1.assign(rows.repartition(7), "doc_id", dict.fromkeys(range(4), 1.0), ["size", "text_crc32"])
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_counts_as_brute_force(spark):
    texts = [None, "", "\n\n", "a\na\na b", " é# ü\n é# ü\n\n<x>", "one two three four five " * 3, "a b c d e f a b c d e", "x\n", "x\n x\nx", "日本 語 x\n日本 語 x\r\n", "a" * 50, "\x0bq\x0c q"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    got = {r.doc_id: [r[c] for c in op7._COUNTS] for r in op7.counts(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_lines_that_collide_modulo_a_power_of_two(spark):
    line, other = "a", "b"
    while len(line) < 4096:
        line, other = line + other, other + line
    texts = [f"{line}\n{other}", f"{line}\n{line}", f"{line} x\n{other} x", " ".join([line] * 5 + [other] * 5)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    assert {r.doc_id: [r[c] for c in op7._COUNTS] for r in op7.counts(docs).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_binomial_bound():
    assert abs(op7.binomial_cdf(3, 10, 0.3) - 0.6496107184) < 1e-9
    assert abs(op7.binomial_cdf(0, 1000, 0.01) - 0.99**1000) < 1e-12
    assert op7.valid(0, 1000, 0.01, 0.05) and not op7.valid(0, 100, 0.01, 0.05) and not op7.valid(0, 0, 0.5, 0.5)


def test_false_rejection_is_limited(spark):
    rnd = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(6000):
        good = i % 2 == 0
        words = [("w%d" % x) + ("###" if not good and x % 3 == 0 else "") for x in rnd.integers(0, 10**6, 30)]
        rows.append((i, " ".join(words), "en" if i % 3 else None))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op7.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    good = [r.kept for r in got if r.doc_id % 2 == 0]
    bad = [r.kept for r in got if r.doc_id % 2]
    assert np.mean(good) >= 1 - op7.ALPHA and np.mean(bad) < 0.05
    nothing = op7.judge(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert nothing.where("kept = base_failed").count() == 0
    assert op7.judge(docs.where("doc_id < 0"), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_small_strata_get_rules(spark):
    rnd = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(1200):  # 250 good documents a stratum, far below what a sixth of the risk would need
        good = i % 6 > 0
        words = [("w%d" % x) + ("" if good else "##") for x in rnd.integers(10**5, 10**6, 300)]
        rows.append((i, " ".join(words), "abcd"[i // 6 % 4]))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op7.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept == (r.doc_id % 6 > 0) for r in got)
    assert op7.labels_needed(4)["symbols_per_word"] == 99 < op7.labels_needed(4)["few_words"] < 400
    assert sum(2.0 ** -(i + 1) for i in range(len(op7.GRID))) < 1


def test_union_keeps_the_risk(spark):
    """Features that each reject 4 % of the good documents, but 8 % together, can't both be used."""
    n = {"n_words": 1000, "word_chars": 5000, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0}
    odd = {0: {"n_symbols": 5000}, 1: {"n_dup_lines": 500}}
    rows = [(i, "x", *(n | odd.get(i % 25, {})).values()) for i in range(20000)]
    counted = spark.createDataFrame(rows, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in op7._COUNTS))
    labels = counted.selectExpr("doc_id", "1 quality")
    rules = op7.select_rules(counted, labels)["x"]
    assert "symbols_per_word" in rules and "dup_lines_per_word" not in rules
