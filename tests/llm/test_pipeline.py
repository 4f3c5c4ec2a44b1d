"""The pipeline and its stages against brute force."""

import re
from collections import defaultdict

import pytest

from tests.llm.cases import SF, awkward, frame, synthetic
from tests.llm.test_near_dedup import brute
from trackloom.llm import quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
LOW = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def contaminated(t, windows):
    w = words(t)
    return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))


def windows():
    out = set()
    for _, t in synthetic("benchmark", "item_id, text"):
        w = words(t)
        out |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    return out


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r.doc_id: r.predicted for r in quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    left = [(i, t) for i, t in synthetic() if judged[i]]
    first = {}
    for i, t in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    left = [(i, t) for i, t in left if i in first.values()]
    stay = {i for i, _, _, kept in brute(left, 5) if kept}
    w = windows()
    want = {i for i, t in left if i in stay and not contaminated(t, w)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want and 50 < len(want) < len(judged)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    assert all([p for a, n in sorted(x) for p in range(a, a + n)] == list(range(sum(n for _, n in x))) for x in places.values())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_awkward_rows(spark, name, stage):
    out = stage(spark, frame(spark, awkward()), SF)
    assert out.count() > 0
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS
        texts = {(i, t) for i, t in awkward()}
        assert all((r.doc_id, r.text) in texts for r in out.collect())
    if name == "exact_dedup":
        assert sum(r.doc_id == 3 for r in out.collect()) == 1 and not [r for r in out.collect() if r.doc_id in (12, 8)]
    assert stage(spark, frame(spark, []), SF).collect() == []


def test_rows_without_an_id_of_their_own(spark):
    stages = dict(corpus_pipeline.STAGES)
    item = next(t for _, t in synthetic("benchmark", "item_id, text") if len(words(t)) > 15)
    known = "a clean text that nothing else is like, of some words"
    base = " ".join(f"w{i}" for i in range(100))
    near = base + " tail"
    for name, rows, want in (
        ("exact_dedup", [(1, known), (None, known), (2, known), (2, "b"), (None, "c"), (None, "c"), (3, "d"), (3, "d")], [(1, known), (2, "b"), (None, "c"), (3, "d")]),
        ("near_dedup", [(1, base), (None, near), (2, near + " x"), (2, "b c d e f g"), (None, "q")], [(1, base), (2, "b c d e f g"), (None, "q")]),
        ("near_dedup", [(None, base), (None, near), (5, "x")], None),
        ("decontamination", [(1, known), (None, item), (2, item), (2, "b")], [(1, known), (2, "b")]),
    ):
        got = [(r.doc_id, r.text) for r in stages[name](spark, frame(spark, rows), SF).collect()]
        assert len(got) == 2 and (5, "x") in got if want is None else sorted(got, key=str) == sorted(want, key=str), (name, got)


def test_quality_stage_judges_each_row(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = {r.doc_id: r.predicted for r in quality.quality(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    texts = dict(synthetic())
    bad, good = ([i for i in sorted(judged) if judged[i] == k and texts[i]][:8] for k in (0, 1))
    docs = frame(spark, [*synthetic(), *((10**6 + k, texts[i]) for pair in (bad, good) for k, i in enumerate(pair))])
    again = {(r.doc_id, r.key): r.predicted for r in quality.quality(docs.withColumn("key", docs.text), labels, carried=("key",)).collect()}
    stage = dict(corpus_pipeline.STAGES)["quality"]
    got = {(r.doc_id, r.text) for r in stage(spark, docs, SF).collect()}
    assert got == {row for row, predicted in again.items() if predicted}
    pairs = [{again[10**6 + k, texts[i]] for i in (bad[k], good[k])} for k in range(8)]
    assert {0, 1} in pairs  # of one id, a row goes and a row stays
