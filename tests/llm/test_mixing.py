import numpy as np

from ohmgraph.llm import op02_mixing as op2


def test_targets():
    assert op2.targets([100, 100, 100]) == [200.0, 450 / 8 * 2 + (450 / 8 * 5 - 200) * 2 / 3, 450 / 8 + (450 / 8 * 5 - 200) / 3]
    got = op2.targets([10, 1000, 1000, 0])
    assert got[0] == 20 and got[3] == 0 and abs(sum(got) - 3015) < 1e-6 and all(t <= 2 * s for t, s in zip(got, [10, 1000, 1000, 0]))
    assert op2.targets([]) == []


def test_split_keeps_quotas():
    quotas = np.array([5, 0, 1000, 17, 4096])
    out = op2.split(quotas, 7, 3)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all()
    totals = out.sum(axis=1)
    assert totals.max() - totals.min() <= 3
    assert (out == op2.split(quotas, 7, 3)).all()


def test_mix(spark):
    rnd = np.random.default_rng(2)
    rows = [(int(i), None if i % 10 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}", int(rnd.integers(0, 300)), "clash") for i in range(20000)]
    df = spark.createDataFrame([*rows, (7, "s2", 5, "again"), (None, "s2", 5, "x")], "doc_id long, source string, size long, _x string")
    got = op2.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, op2.mix(df.repartition(5)).collect()))
    by = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and len(r.shards) <= 2
        by.setdefault(r.source, [r.source_size, r.target, 0, 0])
        by[r.source][2] += r.taken
        by[r.source][3] += r.size
    assert len(got) == 20002
    for size, target, taken, total in by.values():
        assert size == total and abs(taken - target) <= 300
    order = sorted(by, key=lambda x: (x is None, x or ""))
    assert np.allclose([by[s][1] for s in order], op2.targets([by[s][0] for s in order]))
    share = np.bincount([s for r in got for s in r.shards], weights=[r.size for r in got for _ in r.shards])
    assert len(share) == 8 and share.max() / share.min() < 1.5
    deal = op2.dealt(op2.mix(df)).collect()
    assert sum(r["size"] for r in deal) == sum(r.taken for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, size long")
    assert op2.mix(df).count() == 0
    docs = spark.createDataFrame([(1, None, None, "kept"), (2, "a b  c", "s", "kept")], "doc_id long, text string, source string, shards string")
    out = op2.stage(spark, docs, "")
    assert out.columns == docs.columns and [(r.doc_id, r.shards) for r in out.collect()] == [(2, "kept")] * out.count()
