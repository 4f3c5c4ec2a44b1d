"""Benchmark decontamination: an Aho-Corasick automaton over the normalised windows of test items scans each text once.

Texts and items are normalised to lower-case words between single spaces; a match is mapped back to word numbers and to offsets of
the original text. The automaton is broadcast, so its size is checked: a benchmark of more than ``BLOCK_CHARS`` characters is split
into blocks, each with an automaton of its own, which follow one another over the same rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import forget, give_back, named, slices, texts_of
from trackloom.llm.secret_scan import lower_ascii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Characters of items in one automaton; at ten words a window that is about 100 MB in each worker.
BLOCK_CHARS = 250_000


def words_of(text: str) -> list[str]:
    return WORD.findall(lower_ascii(text))


def windows_of(text: str, size: int) -> list[list[str]]:
    """Every run of ``size`` words, or all the words where there are fewer; none without words."""
    words = words_of(text)
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


def blocks_of(items: DataFrame, id_col: str, text_col: str, size: int, block_chars: int) -> Iterator[dict[str, tuple[int, list[str]]]]:
    """Patterns with their number of words and the items that have them, a block of bounded size at a time."""
    block: dict[str, tuple[int, list[str]]] = {}
    chars = 0
    for row in items.select(named(id_col).cast("string").alias("item"), named(text_col).cast("string").alias("text")).filter("text is not null").toLocalIterator():
        if block and chars + len(row.text) > block_chars:
            yield block
            block, chars = {}, 0
        chars += len(row.text)
        for window in windows_of(row.text, size):
            ids = block.setdefault(f" {' '.join(window)} ", (len(window), []))[1]
            if row.item is not None and row.item not in ids[-1:]:
                ids.append(row.item)
    yield block


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, hit_words, hit_chars, items.

    ``hit_words`` and ``hit_chars`` are flat arrays of start and end (exclusive) of the maximal runs of hit words, in words and in code
    points of the original text; ``items`` are the distinct ids, as strings in order, whose windows occur. Null and empty texts and
    items have no words; an item without id still marks words. Repeated documents are scanned each, repeated items count once per id;
    empty tables give an empty result or no hits. Other columns are ignored.
    """
    found = texts_of(docs, id_col, text_col).select("doc_id", "text", F.expr("cast(null as bigint)").alias("n_words"), *(F.expr(f"cast(array() as array<{k}>)").alias(n) for n, k in (("hit_words", "int"), ("hit_chars", "int"), ("items", "string"))))
    kind = dict(found.dtypes)["doc_id"]
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks_of(items, item_col, item_text_col, size, block_chars)]
    for i, block in enumerate(blocks):
        found = scanned(found, block, kind, last=i == len(blocks) - 1)
    return found


def scanned(found: DataFrame, block, kind: str, last: bool) -> DataFrame:
    names = ["doc_id", *([] if last else ["text"]), "n_words", "hit_words", "hit_chars", "items"]
    types = {"doc_id": kind, "text": "string", "n_words": "bigint", "hit_words": "array<int>", "hit_chars": "array<int>", "items": "array<string>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        forget()
        automaton = ahocorasick.Automaton()
        for pattern, (n, ids) in block.value.items():
            automaton.add_word(pattern, (len(pattern), n, ids))
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            for part in slices(batch, 1):
                rows = [scan(t, automaton, w, c, i) for t, w, c, i in zip(*(part.column(k).to_pylist() for k in (1, 3, 4, 5)), strict=True)]
                n, *lists = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *([] if last else [part.column(1)]), pa.array(n, pa.int64()), pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.int32())), pa.array(lists[2], pa.list_(pa.string()))], names=names)
            give_back()

    return found.mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in names))


def scan(text: str, automaton, hit_words: list[int], hit_chars: list[int], items: list[str]) -> tuple[int, list[int], list[int], list[str]]:
    """Number of words; the runs and items given, with those that the automaton finds in ``text`` added."""
    low = lower_ascii(text)
    words = WORD.findall(low)
    hits = list(automaton.iter(f" {' '.join(words)} ")) if words and len(automaton) else []
    if not hits:
        return len(words), hit_words, hit_chars, items
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))  # of the space before each word
    spans = list(zip(hit_words[::2], hit_words[1::2], strict=True))
    ids = set(items)
    for end, (length, n, of) in hits:
        at = bisect_right(starts, end - length + 1) - 1
        spans.append((at, at + n))
        ids.update(of)
    runs = merged(spans)
    places = [(m.start(), m.end()) for m in WORD.finditer(low)]
    return len(words), [x for r in runs for x in r], [x for a, b in runs for x in (places[a][0], places[b - 1][1])], sorted(ids)
