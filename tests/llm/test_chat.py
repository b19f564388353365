import random
import re

from pyspark.sql import functions as F

from ohmgraph.llm import op10_chat as op10

NODES = "conv_id long, node long, parent long, score double, role string, text string, leaf int"


def test_branches_and_ranks(spark):
    rows = [(1, 1, None, 0.0, "user", "q", 0), (1, 2, 1, 1.0, "assistant", "a1", 0), (1, 3, 1, 2.0, "assistant", "a2", 0), (1, 4, 2, 5.0, "user", "f", 0), (1, 9, 99, 0.5, "user", "lost", 0),
            (None, 1, None, 0.0, None, None, 0)]
    rows += [(2, i, i - 1 if i else None, 0.0, "user" if i % 2 == 0 else "assistant", f"t{i}", 0) for i in range(70)]
    got = op10.format_trees(spark.createDataFrame(rows, NODES).repartition(3), keep=2).collect()
    by = {(r.conv_id, r["rank"]): r for r in got}
    assert (by[1, 1].leaf, by[1, 1].score, by[1, 2].leaf) == (4, 6.0, 3)
    assert by[1, 1].formatted == "### user: q</turn>\n### assistant: a1</turn>\n### user: f</turn>\n"
    assert by[None, 1].formatted == "### : </turn>\n" and by[2, 1].formatted.count("</turn>") == 70
    m = by[1, 1].mask
    assert [by[1, 1].formatted[x.start : x.end] for x in m] == ["a1"] and len(got) == 4


def test_round_trip(spark):
    texts = [op10.TRICKY, "", None, "\\l \\b \\\\h ## << </turn>\n### assistant: x</turn>\n", "é🙂: \\", "\\"]
    rows = [(c, i, i - 1 if i else None, 0.0, role, t, 0) for c in range(2) for i, (t, role) in enumerate(zip(texts, ["user", "assistant", "a: b\\<#", "assistant", None, "assistant"]))]
    turns, under = op10.read_back()
    for r in op10.format_trees(spark.createDataFrame(rows, NODES)).select(turns.alias("t"), under.alias("u")).collect():
        assert [(x.role, x.text) for x in r.t] == [((y[4] or ""), (y[5] or "")) for y in rows[:6]]
        assert r.u == [y[5] or "" for y in rows[:6] if y[4] == "assistant"]


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (None, 1, None, None)]
    got = op10.format_trees(op10.conversations(spark.createDataFrame(rows, schema))).select("conv_id", F.length("formatted")).collect()
    assert {(r[0], r[1]) for r in got} == {(1, 3 * 14 + 4 + 4 + 6 + 3), (None, 14)}
    assert op10.format_trees(op10.conversations(spark.createDataFrame([], schema))).count() == 0


def test_repeated_nodes(spark):
    rows = [(1, 1, None, 0.0, "user", "b", 0), (1, 1, None, 0.0, "user", "a", 1), (1, 1, None, 0.0, None, "z", 2), (1, 2, 1, 1.0, "assistant", None, 3), (1, 2, 1, 1.0, "assistant", "", 4)]
    for parts in (1, 4):
        got = op10.format_trees(spark.createDataFrame(rows, NODES).repartition(parts), keep=3).collect()
        assert [(r.leaf, r["rank"], r.score, r.formatted) for r in got] == [(2, 1, 1.0, "### : z</turn>\n### assistant: </turn>\n")]


def test_ranks_as_brute_force(spark):
    rnd = random.Random(3)
    rows = [(c, i, rnd.randrange(i) if i and rnd.random() < 0.9 else None, float(rnd.randint(-3, 3)), rnd.choice(["user", "assistant"]), f"t{i}", 0) for c in range(12) for i in range(rnd.randint(1, 60))]
    want = set()
    for c in range(12):
        own = {r[1]: r for r in rows if r[0] == c}
        paths = []
        for leaf in set(own) - {r[2] for r in own.values()}:
            path = [leaf]
            while own[path[-1]][2] is not None:
                path.append(own[path[-1]][2])
            paths.append((-sum(own[i][3] for i in path), leaf, "".join(f"### {own[i][4]}: {own[i][5]}</turn>\n" for i in reversed(path))))
        want |= {(c, rank + 1, leaf, -score, text) for rank, (score, leaf, text) in enumerate(sorted(paths)[:3])}
    got = op10.format_trees(spark.createDataFrame(rows, NODES).repartition(3), keep=3).collect()
    assert {(r.conv_id, r["rank"], r.leaf, r.score, r.formatted) for r in got} == want and len(got) == len(want)


def test_no_python(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert not re.search("Python|Pandas|Arrow", op10.format_trees(op10.conversations(rows))._jdf.queryExecution().executedPlan().toString())
