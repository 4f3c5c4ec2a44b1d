"""The license scan against brute force."""

import random
import re
import textwrap

from tests.llm.cases import awkward, frame, rows, same, synthetic
from trackloom.llm import license_scan
from trackloom.llm.license_scan import PHRASES, TEMPLATES, template_tokens

LOW = {c: c + 32 for c in range(65, 91)}


def expected(text, templates=TEMPLATES, threshold=0.8):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    words, places, base = find(text), [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if places else 0.0
    for line in text.split("\n"):
        have = set(find(line))
        for label, t in templates:
            tokens = template_tokens(t)
            if len(have & set(tokens)) >= threshold * len(tokens) - 1e-9:
                labels.add(label)
                score = max(score, len(have & set(tokens)) / len(tokens))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


def test_licenses(spark):
    r = random.Random(4)
    vocabulary = [w for _, t in TEMPLATES for w in t.split()] + ["cc", "by", "BY-NC", "all", "rights", "reserved", "General Public License", "\n", "é", "x", "CC BY cc by"]
    made = [(5000 + i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(30)))) for i in range(200)]
    for i, (_, t) in enumerate(TEMPLATES * 6):
        w = t.split()
        r.shuffle(w)
        made.append((6000 + i, "some text\n" + " ".join(w[r.randrange(3) :]) + "\nmore all rights reserved" * (i % 2)))
    given = awkward() + synthetic() + made
    got = license_scan.licenses(frame(spark, given))
    found = [(*x[:-1], round(x[-1], 9)) for x in rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    want = [(i, *expected(t or "")) for i, t in given]
    same(found, want)
    assert sum(w[2] > 0 for w in want) > 60 and sum(w[5] != w[6] for w in want) > 30
    assert license_scan.licenses(frame(spark, [])).collect() == []


def test_no_python_runs(spark):
    plan = license_scan.licenses(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def in_runs(text, templates=TEMPLATES, threshold=0.8):
    """Labels and greatest score of lines, and of all runs of as many words as a template has, divided by the threshold."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    words, labels, best = find(text), set(), 0.0
    for label, t in templates:
        tokens, span = set(template_tokens(t)), int(len(find(t)) / threshold + 1e-9)
        for have in [*map(find, text.split("\n")), *(words[i : i + span] for i in range(len(words)))]:
            score = len(tokens & set(have)) / len(tokens)
            if score >= threshold - 1e-9:
                labels.add(label)
                best = max(best, score)
    return labels, best


def wrapped(text, width, before):
    return "\n".join(before + line for line in textwrap.wrap(text, width, break_long_words=False))


def test_notices_wrapped_over_lines(spark):
    r = random.Random(8)
    given, want = [], {}
    for i, (label, t) in enumerate(TEMPLATES):
        for j, (width, before) in enumerate([(40, ""), (26, "# "), (12, " * "), (12, "// ")]):
            given.append((100 * i + j, f"first line\n\n{wrapped(t, width, before)}\n\nint main() {{}}"))
            want[100 * i + j] = label
        given.append((100 * i + 10, "\n".join(w for w in t.split() for w in (w, *["filler"] * 4))))  # its words, but in no run
        given.append((100 * i + 11, wrapped(" ".join(t.split()[: len(t.split()) // 2]), 20, "")))  # half of it
    lots = [w for _, t in TEMPLATES for w in t.split()] + ["x"] * 20
    given += [(5000 + i, " ".join(r.choice(lots) + r.choice(["", "", "\n"]) for _ in range(r.randrange(60)))) for i in range(150)]
    given += [(6000 + i, wrapped(" ".join(w for w in t.split() if r.random() < 0.9), 15, "")) for i, (_, t) in enumerate(TEMPLATES * 10)]
    given += [(7000, "a\n" + "\n".join(wrapped(t, 30, "# ") for _, t in TEMPLATES[1:8:3] * 2)), (7001, None), (7002, "\n\n")]
    got = {x.doc_id: x for x in license_scan.licenses(frame(spark, given)).collect()}
    for i, t in given:
        labels, best = in_runs(t or "")
        x, base = got[i], set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, x.labels.split(","))) == labels | base, (t, x)
        assert {b.label for b in x.blocks} == labels and abs(max((b.score for b in x.blocks), default=0.0) - best) < 1e-9, (t, x)
        assert x.score == (1.0 if x.n_base else max((b.score for b in x.blocks), default=0.0))
    for i, label in want.items():
        assert label in got[i].labels.split(",") and any(b.line == 2 and b.score == 1 for b in got[i].blocks if b.label == label), got[i]
    assert sorted(b.label for b in got[7000].blocks) == ["bsd", "bsd", "gpl", "gpl", "mit", "mit"]
    assert not any(got[100 * i + 10].blocks for i in range(len(TEMPLATES)) if len(TEMPLATES[i][1].split()) > 5)
