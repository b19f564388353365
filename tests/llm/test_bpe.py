import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ohmgraph.llm import op04_bpe as op4

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    raw = open(PATH, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return op4.Bpe(raw, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "  a  b\n\n c ", "don't\t\tyou'll see", "x" * 3000, "ab" * 1500, "é" * 700, "a b 　c", "日本語のテキスト 1234567", "\n \n", " a", "a ", "a \n b", "<|endoftext|>", "1 2  3   4", "🙂🙂 ok"]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_as_tiktoken(both, text):
    own, other = both
    assert own.encode(text) == other.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_random_texts(both, monkeypatch):
    own, other = both
    monkeypatch.setattr(op4, "REMEMBERED", 50)
    rnd = random.Random(3)
    for _ in range(400):
        text = "".join(rnd.choices("ab ' \n\tsé1.,! ", k=rnd.randint(0, 120)))
        assert own.encode(text) == other.encode_ordinary(text)


@pytest.mark.parametrize("slow", [False, True])
def test_all_texts_at_once(both, monkeypatch, slow):
    own, other = both
    monkeypatch.setattr(own, "slow", set(own.vocab) if slow else own.slow)
    monkeypatch.setattr(op4, "_PART", 40)
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(["an", "na", "é", " ", " the", "\n", "  ", "aa", "'s"], k=rnd.randint(0, 300))) for _ in range(200)]
    memory = []
    for some in (texts[:90], texts[90:], texts[:10], []):
        ids, ends = own.encode_all(some, memory)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [other.encode_ordinary(x) for x in some]


def test_unusual_ranks():
    """Ranks by which a merge can bring up a pair of lower rank: as the plainest merging."""
    ranks = {bytes([i]): 1000 + i for i in range(256)} | {b"aba": 1, b"ab": 7, b"bab": 3, b"abab": 5, b"cc": 9, b"ccc": 2, b"bb": 4}
    own = op4.Bpe(b"\n".join(base64.b64encode(a) + b" %d" % b for a, b in ranks.items()), r"\S+| ")
    assert own.slow

    def plain(raw):
        if raw in ranks:
            return [ranks[raw]]
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, 10**6), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 10**6:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[x] for x in parts]

    rnd = random.Random(9)
    for _ in range(300):
        text = "".join(rnd.choices("abc", k=rnd.randint(1, 14)))
        assert own.encode(text) == plain(text.encode()), text


def test_query_rows(spark, both):
    own, other = both
    docs = spark.createDataFrame([(1, "Hello, world", "x"), (2, None, "y"), (2, "", "z"), (None, "a b", "w")], "doc_id long, text string, ids string")
    got = op4.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    for r, text in zip(got, ("Hello, world", "", "", "a b")):
        ids = other.encode_ordinary(text)
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert op4.encode(docs.where("doc_id = 9"), PATH, public_tokenizers.PATTERN).count() == 0
