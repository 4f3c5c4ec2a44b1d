"""Positive-unlabelled classifiers by held-out accuracy."""

import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import awkward, frame, rows
from trackloom.llm import common, pu_learning, quality, queries, toxicity

BIG = "/root/testdata/sf0.1"


def held_out_rates(spark, query, label, mod, rest, threshold):
    got = rows(query(spark, BIG), "doc_id", "held_out", "score", "predicted")
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM read_parquet('{BIG}/labels.parquet')").fetchall())
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM read_parquet('{BIG}/documents.parquet')").fetchall()[0][0]
    assert all(h == (zlib.crc32(str(i).encode()) % mod == rest) and 0 <= s <= 1 and p == (s >= threshold) for i, h, s, p in got)
    held = [(truth[i], p) for i, h, _, p in got if h and i in truth]
    return tuple(sum(p == y for t, p in held if t == y) / sum(t == y for t, _ in held) for y in (0, 1))


def test_toxicity_on_held_out_rows(spark):
    clean, toxic = held_out_rates(spark, queries.op3_toxicity, "toxic", 3, 1, 0.7)
    assert clean > 0.99 and toxic > 0.85


def test_quality_on_held_out_rows(spark):
    junk, good = held_out_rates(spark, queries.op7_quality, "quality", 5, 0, 0.3)
    assert junk > 0.9 and good > 0.99


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_awkward_rows(spark, operator):
    labels = spark.createDataFrame([(7, 1, 1, "x"), (8, 0, 0, "x"), (3, 1, 1, "x"), (3, 0, 0, "x"), (None, 1, 1, "x"), (12, None, None, "x"), (14, 0, 0, "x")], "doc_id long, toxic int, quality int, text string")
    got = operator(frame(spark, awkward()), labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id in (7, 8, 9)}) == 1
    assert not [r for r in got if r.doc_id is None and r.held_out]
    assert {r.score for r in operator(frame(spark, awkward()), labels.limit(0)).collect()} == {0.5}
    assert operator(frame(spark, []), labels).collect() == []


def test_labels_of_other_rows_are_not_read(spark):
    docs = frame(spark, [(k, f"some words {'bad' * (k % 3 == 0)} number {k}") for k in range(300)])
    ones = [(k, 1) for k in range(0, 300, 6)]
    plain, more = (sorted(rows(toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")), "doc_id", "score")) for x in (ones, ones + [(k, 0) for k in range(1, 300, 3)]))
    assert plain == more


def plain_risk(pos, unl, prior):
    """From the definition, value by value."""
    sig = lambda z: 1 / (1 + math.exp(-z))
    up = sum(sig(-g) for g in pos) / len(pos)
    as_other = sum(sig(g) for g in pos) / len(pos)
    return prior * up, sum(sig(g) for g in unl) / len(unl) - prior * as_other


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.9])
def test_risk_and_slopes_against_the_definition(prior):
    r = np.random.default_rng(3)
    for shift in (-2.0, 0.0, 2.0):
        pos, unl = r.normal(shift, 1, 7), r.normal(0, 1, 9)
        parts = pu_learning.risk(pos, unl, prior)
        assert np.allclose(parts, plain_risk(pos.tolist(), unl.tolist(), prior))
        rp, ru = pu_learning.slopes(pos, unl, prior)
        # the descent follows the whole risk, or climbs the second part where that is below zero
        value = (lambda a, b: sum(plain_risk(a, b, prior))) if parts[1] >= 0 else (lambda a, b: -plain_risk(a, b, prior)[1])
        for k in range(len(pos)):
            up, down = pos.copy(), pos.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            assert abs((value(up, unl) - value(down, unl)) / 2e-5 - rp[k]) < 1e-7
        for k in range(len(unl)):
            up, down = unl.copy(), unl.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            assert abs((value(pos, up) - value(pos, down)) / 2e-5 - ru[k]) < 1e-7
    assert pu_learning.risk(np.full(5, 3.0), np.full(5, -3.0), 0.9)[1] < 0


@pytest.mark.parametrize("prior", [0.1, 0.4, 0.85])
def test_prior_is_found_from_both_samples(prior):
    r = np.random.default_rng(int(prior * 100))
    pos, other = r.normal(2, 1, 2000), r.normal(-2, 1, 6000)
    unl = np.concatenate([r.normal(2, 1, int(6000 * prior)), other[: 6000 - int(6000 * prior)]])
    assert abs(pu_learning.estimated_prior(pos, unl, pu_learning.Settings()) - prior) < 0.04
    assert pu_learning.estimated_prior(pos[:3], unl, pu_learning.Settings()) == 0.5


def test_words_are_counted_in_every_document(spark):
    docs = spark.createDataFrame([(k, "bad one" if k % 10 == 0 else f"good {k}") for k in range(500)], "doc_id long, text string")
    sample = docs.selectExpr("doc_id", "text", "explode(if(doc_id % 10 = 0, array(1, 0), array(0))) as role")
    counts = {(x.word, x.role): x.n for x in pu_learning.level_counts(sample, lambda: pu_learning.features).collect()}
    bad = 4 * pu_learning.features("bad")[0]
    assert counts[bad, 1] == counts[bad, 0] == 50
    assert bad in pu_learning.chosen_words(sample, docs, 500, pu_learning.Settings())


def test_risk_never_rewards_memorised_positives():
    """Where unlabelled text equals the positives, the score can't fall far from the prior's side for either."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 13)).tolist()
    role = np.repeat([1, 0], 300)
    model = pu_learning.fit_rows(x, [[]] * 600, [], role, 0.5, pu_learning.Settings(words=0))
    assert all(np.isfinite(b).all() for b in model.bins)


class Captured:
    """Stands for a DataFrame and keeps the function that is given to its workers."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def __getattr__(self, name):
        return lambda *a, **b: self


def test_workers_forget_the_tables_of_other_operators(spark):
    """In a pipeline one worker serves all stages: the encoder of packing must not stand beside the classifier's tables."""
    df = Captured()
    pu_learning.level_counts(df, lambda: pu_learning.features)
    common.REMEMBERED[("encoder",)] = "tables"
    rows = [b.to_pylist() for b in df.run(iter([pa.RecordBatch.from_pydict({"role": [1, 0], "text": ["one word", "word"]})]))]
    assert not common.REMEMBERED and sum(map(len, rows)) == len(pu_learning.levels("one word")) + len(pu_learning.levels("word"))
