import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from ohmgraph.llm import op07_quality as op7
from tests.llm.test_minhash import brute as brute_components
from tests.llm.test_secrets import ASSIGN
from tests.llm.test_sharding_quality import brute as brute_counts


def write(spark, folder):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choices("abcdeilmnorst", k=rnd.randint(2, 7))) for _ in range(500)]
    docs = []
    for i in range(120):
        text = " ".join(rnd.choices(vocab, k=rnd.randint(5, 80)))
        if i % 10 == 3:
            text = docs[-1][1]
        if i % 10 == 7:
            words = docs[-2][1].split() + ["extra"]
            text = " ".join(words)
        if i % 9 == 5:
            text += ' token = "hunter2hunter2" end'
        if i % 20 == 19:
            text = "again and again it says " * 8
        docs.append((i, text, "en" if i % 4 else None, f"s{i % 3}" if i % 5 else None, len(text)))
    docs += [(200, None, "en", "s1", 0), (201, "", None, "s2", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_as_brute_force(spark, tmp_path):
    made = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    outs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        assert i == 4 or docs.columns == columns, names[i]
        outs.append(docs.collect())
    # few labels: no cutoff is valid, so the base rules decide
    kept = {}
    for d, text, *_ in made:
        n, _, _, _, repeated = brute_counts(text)
        if n >= 10 and 100 * repeated <= 20 * n:
            kept[d] = text
    assert {r.doc_id: r.text for r in outs[0]} == kept
    heads = {d: t for d, t in kept.items() if brute_components(list(kept.items()))[d][1] == d}
    assert {r.doc_id: r.text for r in outs[1]} == heads and len(heads) < len(kept)
    clean = {d: "".join(_without(t)) for d, t in heads.items()}
    assert {r.doc_id: r.text for r in outs[2]} == clean and any("[SECRET]" in t for t in clean.values())
    assert all(r.n_chars == len(r.text) for r in outs[2])
    times = Counter(r.doc_id for r in outs[3])
    assert set(times) <= set(clean) and max(times.values()) <= 2 and all(r.text == clean[r.doc_id] for r in outs[3])
    words = lambda d: len(clean[d].split())
    assert abs(sum(words(d) * n for d, n in times.items()) / sum(map(words, clean)) - 1.5) < 0.1
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(r.doc_id for r in outs[4]) == times
    for r in outs[4]:
        assert r.ids == enc.encode_ordinary(clean[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].encode()).hexdigest()
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, outs[4]))
    assert op7.ALPHA < 1


def test_stages_with_clashing_columns(spark, tmp_path):
    """Columns named like the stages' own: kept as they are."""
    made = write(spark, tmp_path)[:60]
    extra = "_turns _source _ends _a _m _k _h _c _id _tag _key _own _spans _base _assign _mix_size _mix_spot row size clean tag stratum quality kept doc t source_size target taken shards spot shard component_id n_shingles text_ a.b".split()
    rows = [(*r, *(f"{r[0]}{x}" for x in extra)) for r in made]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in extra)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[x] == f"{r.doc_id}{x}" for r in got for x in extra), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path / "full")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def _without(text):
    end = 0
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            yield text[end : m.start()]
            yield "[SECRET]"
            end = m.end()
    yield text[end:]
