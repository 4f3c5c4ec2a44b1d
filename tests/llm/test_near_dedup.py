"""Near duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from tests.llm.cases import awkward, frame, rows, same, synthetic
from trackloom.llm import near_dedup
from trackloom.llm.common import checkpoint
from trackloom.llm.graph import components

LOW = {c: c + 32 for c in range(65, 91)}


def brute(given, words, percent=80):
    sets = []
    for _, t in given:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(given)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(given):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return [(d, len(sets[i]), c := best.get(root(i), d) if sets[i] else d, d == c) for i, (d, _) in enumerate(given)]


def edited(r, words, edits):
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 16)  # several blocks to a group
    r = random.Random(words)
    given = [(i, t) for i, t in awkward() if i != 12] + [(1000 + i, t) for i, t in synthetic()]
    at = 5000
    for size in (5, 6, 7, 9, 12, 40, 41, 45, 60, 200):
        base = [f"v{r.randrange(5000)}" for _ in range(size)]
        for _ in range(12):
            given.append((at := at + 1, edited(r, base, r.randrange(1 + max(1, size // 12)))))
    passage = [f"p{r.randrange(9000)}" for _ in range(70)]
    for _ in range(60):  # share much, but not enough to be linked
        given.append((at := at + 1, " ".join(passage + [f"o{r.randrange(10**6)}" for _ in range(30)])))
    base = [f"c{r.randrange(5000)}" for _ in range(150)]
    for _ in range(60):
        given.append((at := at + 1, edited(r, base, r.randrange(14))))
    r.shuffle(given)
    got = rows(near_dedup.near_duplicates(frame(spark, given), words=words), "doc_id", "n_shingles", "component_id", "kept")
    want = brute(given, words)
    same(got, want)
    assert sum(d != c for d, _, c, _ in want) > 80


def test_awkward_ids(spark):
    base = " ".join(f"w{i}" for i in range(30))
    given = [(5, base), (5, base), (None, base), (None, "a b c d e f g"), (None, ""), (None, None)]
    same(rows(near_dedup.near_duplicates(frame(spark, given)), "doc_id", "component_id", "kept"), [(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True), (None, None, True), (None, None, True)])
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_components_of_chains(spark):
    r = random.Random(9)
    names = list(range(300))
    r.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(299) if i % 50] + [(7, 7)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    for i in range(0, 300):
        part = names[(i - 1) // 50 * 50 + 1 : (i - 1) // 50 * 50 + 51] if i else names[:1]
        assert got.get(names[i], names[i]) == min(part)


def test_the_sketch_of_the_union_decides_small_sets_and_passes_near_ones():
    r = np.random.default_rng(1)
    least = near_dedup.least_common(80)
    for n in (5, 20, 39, 60, 200, 1000):
        for share in (0.3, 0.5, 0.85, 0.95, 1.0):
            drawn, k = r.choice(10**9, 2 * n, replace=False), int(n * share)
            a, b = (np.unique(np.concatenate([drawn[:k], drawn[at : at + n - k]])) for at in (k, n))
            union, shared = len(np.union1d(a, b)), len(np.intersect1d(a, b))
            passed = near_dedup.likely(a[: near_dedup.SKETCH], b[: near_dedup.SKETCH], 80, least)
            if union <= near_dedup.SKETCH:
                assert passed == (100 * shared >= 80 * union)
            assert passed or 100 * shared < 80 * union
            assert not passed or n < 200 or shared > 0.2 * union


def rows_between(spark, monkeypatch, given):
    """Rows of the checkpoints and cells of one run."""
    seen = []

    def counted(df):
        out = checkpoint(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "checkpoint", counted)
    kept = near_dedup.near_duplicates(frame(spark, given), words=2).filter("kept").count()
    return seen, kept


@pytest.mark.parametrize("kind", ["common passage", "edited copies"])
def test_rows_between_stages_grow_in_proportion(spark, monkeypatch, kind):
    r = random.Random(kind)
    base = [f"p{r.randrange(9000)}" for _ in range(150)]
    found = {}
    for n in (500, 2000):
        if kind == "edited copies":
            given = [(k, edited(r, base, r.randrange(1, 8))) for k in range(n)]
        else:
            given = [(k, " ".join(base[:70] + [f"o{r.randrange(10**7)}" for _ in range(30)])) for k in range(n)]
        found[n], kept = rows_between(spark, monkeypatch, given)
        assert kept == (n if kind == "common passage" else kept)
    assert sum(found[2000]) < 5 * sum(found[500]) and max(found[2000]) < 5 * max(found[500]), found
