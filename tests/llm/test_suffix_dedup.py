"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.cases import awkward, frame, same, synthetic
from trackloom.llm import suffix_dedup


def brute(given, length=50):
    data = [(i, (t or "").encode()) for i, t in given]
    least = {}
    for i, b in data:
        if i is not None:
            for p in range(len(b) - length + 1):
                s = b[p : p + length]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            end = 0
            for p in range(len(b) - length + 1):
                if least[b[p : p + length]] < i:
                    for q in range(max(p, end), p + length):
                        gone[q] = 1
                    end = p + length
        spans = [p for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])]
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def made(seed):
    r = random.Random(seed)
    words = ["the", "of", "and", "é", "in", "on", "a", "reading", "table", "xyz", "\n", "中"]
    say = lambda n: " ".join(r.choice(words) + r.choice(["", "", "s", str(r.randrange(99))]) for _ in range(n))
    passages = [say(n) for n in (12, 14, 20, 40, 90)]
    out = []
    for i in range(120):
        t = say(r.randrange(30))
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            t += r.choice(["", " "]) + p[a : a + r.randrange(120)]
        out.append((20_000 + r.randrange(10**6), t))
    out += [(30_000, "ab" * 40), (30_001, "ba" * 60 + "ab" * 3), (30_002, "-" * 49), (30_003, "-" * 200), (30_003, passages[4] + "other"), (30_003, passages[4] + "more"), (29_999, passages[4] * 2)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 3000])
def test_repeated_substrings(spark, bucket_bytes):
    given = awkward() + [(1000 + i, t) for i, t in synthetic()[:120]] + made(7)
    got = suffix_dedup.repeated_substrings(frame(spark, given).repartition(7), part_bytes=bucket_bytes, bucket_bytes=bucket_bytes).collect()
    want = brute(given)
    same([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2, r.kept_sha256) for r in got], want)
    assert sum(w[2] > 0 for w in want) > 60
    assert suffix_dedup.repeated_substrings(frame(spark, [])).collect() == []


@pytest.mark.parametrize("lot", [1, 300, 1 << 20])
def test_lots_give_the_same_ranges(monkeypatch, lot):
    r = np.random.default_rng(3)
    bases = [r.integers(a, a + 2, 400).astype(np.uint8).tobytes() for a in (97, 99, 101)]  # nothing in common
    segments = sorted({bases[a % 3][a : a + 50 + int(n)] for a, n in zip(r.integers(0, 300, 60).tolist(), r.integers(0, 40, 60))})
    anchor = np.array([(s[0] - 97) // 2 for s in segments], np.uint64)
    which = r.integers(0, len(segments), 200)
    ids, zero = r.integers(0, 50, 200), np.zeros(200, np.int64)
    monkeypatch.setattr(suffix_dedup, "LOT", lot)
    got = set()
    for i, _, a, b in suffix_dedup.bucket_ranges(segments, anchor, which, ids, np.arange(200), zero):
        got |= {(int(m), p) for m, x, y in zip(_, a, b) for p in range(x, y)}
    least = {}
    for k, w in enumerate(which):
        for p in range(len(segments[w]) - 49):
            key = segments[w][p : p + 50]
            least[key] = min(least.get(key, 99), ids[k])
    want = {(k, q) for k, w in enumerate(which) for p in range(len(segments[w]) - 49) if least[segments[w][p : p + 50]] < ids[k] for q in range(p, p + 50)}
    assert got == want and want


def test_anchors_of_equal_strings_are_equal(monkeypatch):
    r = np.random.default_rng(1)
    raw = r.integers(97, 100, 5000).astype(np.uint8)
    whole = suffix_dedup.anchors(raw)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 64)
    assert (suffix_dedup.anchors(raw) == whole).all()
    for p in (0, 17, 4000):
        assert suffix_dedup.anchors(raw[p : p + 50])[0] == whole[p]


def test_refined_numbers_follow_the_strings():
    r = np.random.default_rng(2)
    raw = np.tile(r.integers(97, 99, 300).astype(np.uint8), 4)
    raw[r.integers(0, len(raw), 6)] = 120
    at = np.arange(len(raw) - 49)
    names = suffix_dedup.refined(raw, at)
    seen = {}
    for p, n in zip(at.tolist(), names.tolist()):
        assert seen.setdefault(raw[p : p + 50].tobytes(), n) == n
    assert len(set(seen.values())) == len(seen)
