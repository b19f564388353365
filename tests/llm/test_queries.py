"""The registered queries over small tables, against brute force."""

import base64
import hashlib
import math
import random
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
import xxhash

from ohmgraph.llm import op02_mixing as op2
from ohmgraph.llm import registry
from tests.llm.test_minhash import brute as brute_components
from tests.llm.test_repeats import brute_bytes, brute_words
from tests.llm.test_secrets import brute as brute_secrets
from tests.llm.test_sharding_quality import brute as brute_counts


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choices("abcdeilmnorsté", k=rnd.randint(2, 8))) for _ in range(300)]
    passage = " ".join(rnd.choices(vocab, k=70))
    docs = [(900, None, None, None), (901, "", "en", "s0"), (902, "\n \n", "en", "s1")]
    for i in range(150):
        text = " ".join(rnd.choices(vocab, k=rnd.randint(3, 90)))
        if i % 8 == 3:
            text = docs[-1][1]
        if i % 8 == 5:
            text += "\n" + passage
        if i % 11 == 5:
            text += ' token = "hunter2hunter2" ' + "%032x" % (i * 7919)
        docs.append((i * 7 % 151, text, ["en", "de", None][i % 3], [f"s{i % 5}", None][i % 6 == 0]))
    folder = tmp_path_factory.mktemp("tables")
    rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs


def run(spark, made, start):
    name = next(x for x in registry.QUERIES if x.startswith(start))
    return {r.doc_id: r for r in registry.QUERIES[name](spark, made[0]).collect()}


def spark_hash(*parts):
    """xxhash64 of Spark over strings, longs and ints."""
    seed = 42
    for x, kind in parts:
        raw = x.encode() if kind == "s" else struct.pack("<q" if kind == "l" else "<i", x)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def best_shard(doc, shards):
    score = lambda s: -1.0 / math.log(((spark_hash(("shard", "s"), (doc, "l"), (s, "i")) >> 11) + 0.5) / 2**53)
    return max(shards, key=lambda s: (score(s), -s))


def test_op1(spark, made):
    got = run(spark, made, "op1_")
    assert len(got) == len(made[1])
    for d, text, *_ in made[1]:
        r = got[d]
        assert (r.size, r.text_crc32, r.law) == (len((text or "").encode()) + 1, None if text is None else zlib.crc32(text.encode()), "key")
        assert (r.shard, r.grown_shard) == (best_shard(d, range(8)), best_shard(d, range(9)))
    for s in range(8):
        slots = sorted(r.slot for r in got.values() if r.shard == s)
        assert slots == list(range(len(slots)))


def test_op2(spark, made):
    got = run(spark, made, "op2_")
    size = {d: len((t or "").split()) for d, t, *_ in made[1]}
    source = {d: s for d, _, _, s in made[1]}
    names = sorted(set(source.values()), key=lambda x: (x is None, x or ""))
    total = {s: sum(size[d] for d in size if source[d] == s) for s in names}
    # targets by filling up in small steps
    want, weight = dict.fromkeys(names, 0.0), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left = 1.5 * sum(total.values())
    while left > 1e-9:
        open_ = [s for s in names if want[s] < 2 * total[s] - 1e-9]
        step = min([left / sum(weight[s] for s in open_), *((2 * total[s] - want[s]) / weight[s] for s in open_)])
        for s in open_:
            want[s] += step * weight[s]
        left -= step * sum(weight[s] for s in open_)
    for i, s in enumerate(names):
        own = [d for d in size if source[d] == s]
        taken = dict.fromkeys(own, 0)
        rest = want[s]
        spot = {d: (spark_hash(("mix20", "s"), (d, "l")) - (1 << 64) * (spark_hash(("mix20", "s"), (d, "l")) >> 63)) % (op2.BLOCKS * op2._RANGE) for d in own}
        for turn in range(2):
            a, b = op2.permutation(i, turn, op2.SEED)
            order = sorted(own, key=lambda d: ((a * (spot[d] // op2._RANGE) + b) % op2.BLOCKS, spot[d]))
            reach = 0
            for d in order:  # up to the document with which the words come nearest to what is left
                reach += size[d]
                if reach - size[d] / 2 <= rest + 1e-6:
                    taken[d] += 1
            rest = max(0.0, rest - reach)
            if not rest:
                break
        mix = {d: got[d].taken for d in own}
        assert abs(sum(mix.values()) - want[s]) <= max(size.values()) and mix == {d: size[d] * n for d, n in taken.items()}
        for d in own:
            assert (got[d].size, got[d].source_size) == (size[d], total[s]) and got[d].target == pytest.approx(want[s])
            assert got[d].taken <= 2 * size[d] and len(got[d].shards) <= 2
    assert run(spark, made, "op2_") == got


def test_op3_op5_op9(spark, made):
    pairs = [(d, t) for d, t, *_ in made[1]]
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in run(spark, made, "op3_").items()} == brute_bytes(pairs, 100)
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in run(spark, made, "op5_").items()} == brute_words(pairs, 50)
    assert {d: (r.n_shingles, r.component_id) for d, r in run(spark, made, "op9_").items()} == brute_components(pairs)


def test_op4(spark, made):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = run(spark, made, "op4_")
    for d, text, *_ in made[1]:
        ids = enc.encode_ordinary(text or "")
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op6(spark, made):
    got = run(spark, made, "op6_")
    for d, text, *_ in made[1]:
        n, base = brute_secrets(text)
        assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == n and got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[d].spans.split(","))


def test_op7(spark, made):
    got = run(spark, made, "op7_")
    for d, text, *_ in made[1]:
        r, want = got[d], brute_counts(text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert (r.base_failed, r.kept) == (failed, not failed)  # too few labels for a cutoff


def test_op8(spark, made):
    got = run(spark, made, "op8_")
    order = sorted(made[1], key=lambda x: x[0])
    for (d, text, *_), (_, following, *_) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d].near_next <= 1 and (text != edited or got[d].near_edited == 1)
    by_text = {}
    for d, text, *_ in order:
        assert by_text.setdefault(text or "", got[d].fingerprint) == got[d].fingerprint
