import hashlib
import random

import numpy as np

from ohmgraph.llm import op08_fingerprints as op8


def brute(text):
    raw = (text or "").encode()
    counts = [0] * op8.BUCKETS
    for i in range(len(raw)):
        for salt, (_, b, c) in enumerate(op8._TRIPLETS):
            if i + c < len(raw):
                t = [int(op8._TABLE[raw[i + p]]) for p in (0, b, c)]
                h = t[0] ^ t[1] * (1, 0x9E3779B1, 0x85EBCA77)[b] ^ t[2] * (1, 0, 0x85EBCA77, 0xC2B2AE3D)[c]
                counts[((h ^ salt * 0x27D4EB2F) % 2**32 * 0x165667B1 % 2**32) >> 25] += 1
    q = [sorted(counts)[op8.BUCKETS * i // 4 - 1] for i in (1, 2, 3)]
    codes = [sum(x > y for y in q) for x in counts]
    length = int(np.round(np.log1p(len(raw)) * 8))
    out = [length >> 8, length & 255, q[0] * 15 // max(1, q[2]), q[1] * 15 // max(1, q[2])]
    out += [codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(codes), 4)]
    return bytes(out).hex()


def test_as_brute_force(spark):
    rnd = random.Random(5)
    texts = [None, "", "a", "ab", "abc", "é🙂", "the cat " * 40] + ["".join(rnd.choices("abcdeé \n", k=rnd.randint(0, 900))) for _ in range(40)]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    for parts in (1, 7):
        got = {r.doc_id: r for r in op8.compare_with_next(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), parts).collect()}
        ordered = sorted(docs)
        assert len(got) == len(docs)
        for (d, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
            t, following = t or "", following or ""
            q = len(t) // 4
            edited = t[: len(t) - q] + following[:q]
            r = got[d]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (brute(t), brute(edited))
            code = lambda x: np.frombuffer(bytes.fromhex(x), np.uint8)[None]
            assert abs(r.near_next - op8.likeness(code(brute(t)), code(brute(following)))[0]) < 1e-12
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "aaaa", 1), (2, "b" * 8, 2), (2, "a" * 8, 3)], "doc_id long, text string, part int")
    got = sorted(((r.doc_id or -1), r.edited_sha256) for r in op8.compare_with_next(docs, 4).collect())
    want = [(-1, "aaaa"), (2, "aaaaaabb"), (2, "bbbbbbaa")]
    assert got == sorted((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in want)
    one = op8.compare_with_next(docs.where("doc_id is null"), 4).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert op8.compare_with_next(docs.where("doc_id > 9"), 4).count() == 0


def test_likeness_tells_edits_from_others():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(300)]
    base = " ".join(rnd.choices(words, k=400))
    near = base[: len(base) * 9 // 10] + " ".join(rnd.choices(words, k=40))
    other = " ".join(rnd.choices(["".join(rnd.choices("klmnopqrst", k=5)) for _ in range(300)], k=400))
    a, b, c = op8._digests([base.encode(), near.encode(), other.encode()])
    assert op8.likeness(a[None], b[None])[0] > op8.likeness(a[None], c[None])[0]
