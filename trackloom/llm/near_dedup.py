"""Near duplicates by word shingles: bottom-k sketches from one hash function, inverted lists, exact Jaccard on full sets.

1. Each text gives the hashes of its distinct shingles; texts of equal sets are one class, so copies are never compared. A class's
   sketch is the ``SKETCH`` least hashes.
2. Inverted lists of the retained values, three neighbours of a sketch together (sets that fit into the sketch are taken as a ring): at
   two words a shingle, four documents of five share a rare single value with another that they are not linked to. Of two sets with a
   Jaccard of 0.8 or more, each value of the union's sketch is in both with probability 0.8 or more, so they miss having a common run in 40
   values with a probability below 1e-6; sets that fit into a sketch always have one.
3. In each list the member with most neighbours is the pivot, and all members are paired with it: as edited copies lie round their
   original, that links nearly all that is to be linked, with as many pairs as list entries.
4. Pairs are confirmed: of what both sketches give of the union's sketch, enough values must be in both (a linked pair fails with a
   probability below 3e-7); those that pass are decided on full sets.
5. Members of one pivot that are in different components after that are looked up again, now in lists of all their values: two linked sets must
   share one of the rarest fifth of either's values, so texts that share a common passage and have a fifth of their own never meet.
   Only pairs of different components, whose sizes and places in the lists allow a link, are confirmed as before; no list is cut or
   sampled.
6. Links become components by large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import checkpoint, join_sized, map_groups, map_texts, only_ids, remembered, texts_of
from trackloom.llm.graph import components

#: Values of a sketch and of a run; members and values of a cell.
SKETCH, RUN, CELL, CELL_VALUES = 40, 3, 512, 4 << 20
#: Uses of one set that a task may serve.
OFTEN = 10_000
#: Greatest probability that a pair at the threshold is passed over.
MISS = 3e-7


def least_common(percent: int) -> int:
    """How many values of a union's sketch are in both sets at least, but for the probability ``MISS``."""
    p, below = percent / 100, 0.0
    for x in range(SKETCH + 1):
        below += math.comb(SKETCH, x) * p**x * (1 - p) ** (SKETCH - x)
        if below > MISS:
            return max(1, x)
    return SKETCH


class WordHashes(dict):
    """64-bit hashes of words, remembered for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < 250_000:
            self[word] = found
        return found


def shingle_set(text: str, words: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles of ``words`` words; of all words together where there are fewer."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.int64)
    a = np.fromiter(map(remembered(("word hashes",), WordHashes).__getitem__, found), np.uint64, len(found))
    k = min(words, len(found))
    h = np.full(len(found) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + a[j : len(found) - k + 1 + j]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((h ^ (h >> np.uint64(31))).view(np.int64))


def sketches(texts: DataFrame, words: int) -> DataFrame:
    def make():
        def sketch(batch: list[str]) -> dict:
            sets = [shingle_set(t, words) for t in batch]
            return {"n": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], "sketch": [s[:SKETCH].tolist() for s in sets]}

        return sketch

    return map_texts(texts, make, {"n": "bigint", "digest": "binary", "sketch": "array<bigint>"})


def full_sets(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(rep, values) of the texts with these doc_ids: the set's sorted 64-bit values as bytes."""
    return map_texts(only_ids(texts, ids), lambda: lambda batch: {"values": [shingle_set(t, words).tobytes() for t in batch]}, {"values": "binary"}).withColumnRenamed("doc_id", "rep")


#: What full sets say of a pair: linked, near (as near as two sets are that are linked with a third), or neither.
LINKED, NEAR, FAR = 2, 1, 0


def near_percent(percent: int) -> int:
    """The Jaccard distance is a metric: two sets linked with a third are at most twice the distance apart."""
    return max(0, 2 * percent - 100)


def grade(a: np.ndarray, b: np.ndarray, percent: int) -> int:
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return LINKED if 100 * both >= percent * union else NEAR if 100 * both >= near_percent(percent) * union else FAR


def pair_table(table: pa.Table, graded) -> pa.Table:
    """The members of a cell that are graded above ``FAR`` with its pivot; an id may have several texts, of which the best counts."""
    pivot, best = table["pivot"][0].as_py(), {}
    rows = [(r, np.frombuffer(v, np.int64)) for r, v in zip(table["rep"].to_pylist(), table["values"].to_pylist(), strict=True)]
    centres = [v for r, v in rows if r == pivot]
    for r, v in rows:
        if r != pivot:
            best[r] = max(best.get(r, FAR), *(graded(c, v) for c in centres))
    found = sorted((r, g) for r, g in best.items() if g > FAR)
    return pa.table({"a": pa.array([pivot] * len(found), pa.int64()), "b": pa.array([r for r, _ in found], pa.int64()), "grade": pa.array([g for _, g in found], pa.int32())})


def likely(a: np.ndarray, b: np.ndarray, percent: int, least: int) -> bool:
    """Whether two sketches' union lets a link be; it decides where the union fits into a sketch."""
    both = np.concatenate([a, b])
    both.sort()
    twice = np.flatnonzero(both[1:] == both[:-1])
    union = len(both) - len(twice)
    if union <= SKETCH:
        return 100 * len(twice) >= percent * union
    return np.count_nonzero(twice - np.arange(len(twice)) < SKETCH) >= least  # with as many values of the union before them


def by_cells(pairs: DataFrame, values: DataFrame, graded) -> DataFrame:
    """Pairs (a, b, grade) whose values are ``graded`` above ``FAR``, by cells of one a, about ``CELL`` members and ``CELL_VALUES`` values."""
    pairs = pairs.select(F.col("a").alias("pivot"), F.col("b").alias("rep"))
    sizes = values.groupBy("rep").agg(F.max(F.octet_length("values") / 8).alias("n")).withColumnRenamed("rep", "pivot")
    counted = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("size")).join(sizes, "pivot")
    cells = checkpoint(counted.select("pivot", "size", F.ceil(F.greatest(F.col("size") / CELL, F.col("size") * F.col("n") / CELL_VALUES)).alias("cells")))
    dealt = join_sized(pairs, cells, ["pivot"], "size").select("pivot", F.pmod(F.xxhash64("rep"), "cells").alias("cell"), "rep")
    centres = cells.select("pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)).alias("cell"), F.col("pivot").alias("rep"))
    uses = checkpoint(dealt.unionByName(centres))
    times = uses.groupBy("rep").agg(F.count(F.lit(1)).alias("uses"))
    often = (times.agg(F.max("uses")).first()[0] or 0) > OFTEN
    used = join_sized(uses, checkpoint(times.join(values, "rep")), ["rep"], "uses") if often else uses.join(values, "rep")
    return map_groups(used, ["pivot", "cell"], lambda t: pair_table(t, graded), "a bigint, b bigint, grade int")


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, sought: int = LINKED) -> DataFrame:
    """(a, b, grade) of those pairs (a, b) that are of the grade ``sought`` or a better one: the union's sketch filters, full sets decide."""
    border = percent if sought == LINKED else near_percent(percent)
    least = least_common(border)
    passed = checkpoint(by_cells(pairs, sketches, lambda a, b: int(likely(a, b, border, least))))
    return checkpoint(by_cells(passed, sets, lambda a, b: grade(a, b, percent)).filter(F.col("grade") >= sought))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of other than ASCII white space, A-Z lowered. Two documents are linked where ``100 * shared >= percent * union`` over
    their sets of distinct shingles of ``words`` words (all words as one where there are fewer). ``component_id`` is the smallest doc_id
    reachable by links and ``kept`` marks it. Null, empty and blank texts have no shingles and are linked with nothing. ``doc_id`` is an
    integer; rows that repeat it are compared each, and are linked where it is the smallest of their texts; a null one never names a
    component unless nothing else does. An empty table gives an empty result. Other columns are ignored.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = checkpoint(sketches(texts, words))
    classes = checkpoint(rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    members = checkpoint(pivot_members(classes, percent))
    reps = checkpoint(members.select("rep").unionByName(members.select(F.col("pivot").alias("rep"))).distinct())
    sets = checkpoint(full_sets(texts, reps.withColumnRenamed("rep", "doc_id"), words))
    heads = checkpoint(as_bytes(only_ids(classes, reps, keys=["rep"])))
    graded = confirmed(members.filter(sized("n", "pivot_n", near_percent(percent))).select(F.col("pivot").alias("a"), F.col("rep").alias("b")), heads, sets, percent, NEAR)
    links = graded.filter(F.col("grade") == LINKED)
    parts = components(links)
    apart = checkpoint(loose_members(members, graded, parts, percent))
    if not apart.isEmpty():
        more = confirmed(full_pairs(apart, sets, percent), heads, sets, percent)
        if not more.isEmpty():
            parts = components(links.unionByName(more))
    named = classes.select("digest", "rep", "copies").join(parts, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    named = named.filter("copies > 1 or component <> rep").select("digest", "component")
    out = rows.select("doc_id", "n", "digest").join(named, "digest", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def as_bytes(sketches: DataFrame) -> DataFrame:
    """(rep, values) of (rep, sketch): the values as bytes, as full sets are."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(x, np.int64).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["rep", "values"])

    return sketches.select("rep", "sketch").mapInArrow(run, "rep bigint, values binary")


def sized(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def with_lengths(entries: DataFrame) -> DataFrame:
    """Entries (value, ...) of lists of more than one, with the list's ``length``."""
    lengths = checkpoint(entries.groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("length", F.col("size")))
    return join_sized(entries, lengths, ["value"], "size")


def pivot_members(classes: DataFrame, percent: int) -> DataFrame:
    """Distinct (pivot, pivot_n, rep, n): the members of the lists of each pivot, but for itself."""
    able = classes.filter("rep is not null").filter(F.col("n") * (100 - percent) >= percent)  # smaller sets equal what they are near to
    ring = F.when(F.col("n") <= SKETCH, F.concat("sketch", F.slice("sketch", 1, RUN - 1))).otherwise(F.col("sketch"))
    runs = F.transform(F.sequence(F.lit(1), F.size("ring") - RUN + 1), lambda i: F.xxhash64(*(F.element_at("ring", i + j) for j in range(RUN))))
    entries = able.select("rep", "n", ring.alias("ring")).select("rep", "n", F.explode(F.array_distinct(runs)).alias("value"))
    lists = checkpoint(with_lengths(entries))
    weights = lists.groupBy("rep").agg(F.sum(F.col("length") - 1).alias("weight"))
    lists = lists.join(weights, "rep").select("value", "rep", "n", "weight")
    tops = lists.groupBy("value").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"), "n")).alias("top"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    tops = checkpoint(tops.select("value", (-F.col("top.minus")).alias("pivot"), F.col("top.n").alias("pivot_n"), "size"))
    return join_sized(lists, tops, ["value"], "size").filter("pivot <> rep").select("pivot", "pivot_n", "rep", "n").distinct()


def loose_members(members: DataFrame, graded: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(rep, comp) of pivots and members that may be linked with a member of the same pivot in another component.

    Of two members one at least is not linked with the pivot itself; if the other is, the first is ``NEAR`` the pivot. Sizes go by buckets,
    a set to its own and the next one, as linked sets are at most one bucket apart.
    """
    placed = checkpoint(parts.select("node", "component"))
    found = lambda df, c, to: df.join(placed.select(F.col("node").alias(c), F.col("component").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
    grades = graded.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), "grade")
    known = checkpoint(members.join(grades, ["pivot", "rep"], "left").withColumn("grade", F.coalesce("grade", F.lit(FAR))))
    left = found(found(known.filter(F.col("grade") < LINKED).select("pivot", "rep"), "rep", "comp"), "pivot", "centre")
    pivots = checkpoint(left.filter("comp <> centre").groupBy("pivot").agg(F.count(F.lit(1)).alias("size")).join(known.groupBy("pivot").agg(F.count(F.lit(1)).alias("of")), "pivot").select("pivot", F.col("of").alias("size")))
    own = known.select("pivot", F.col("pivot").alias("rep"), F.col("pivot_n").alias("n"), F.lit(LINKED).alias("grade")).distinct()
    their = join_sized(known.select("pivot", "rep", "n", "grade").unionByName(own), pivots, ["pivot"], "size")
    rows = checkpoint(found(found(their, "rep", "comp"), "pivot", "centre"))
    bucket = F.floor(F.log("n") / math.log(100 / percent) + 1e-9)
    free, near = F.col("grade") < LINKED, (F.col("grade") == NEAR) & (F.col("comp") != F.col("centre"))
    groups = rows.select("pivot", "rep", "comp", free.alias("free"), near.alias("near"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    of_free = F.when(F.col("free"), F.col("comp"))
    mixed = groups.groupBy("pivot", "bucket").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.min(of_free) != F.max(of_free), F.lit(False)).alias("apart"), F.max("near").alias("any_near"))
    wanted = join_sized(groups, checkpoint(mixed.filter("apart or any_near")), ["pivot", "bucket"], "size")
    return wanted.filter("(free and (apart or near)) or (not free and any_near)").select("rep", "comp").distinct()


def full_pairs(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share one of the rarest values of either's full set, as far as sizes and places allow."""

    def entries_of(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a set at a time
                v = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), batch.column(0)[k].as_py())), pa.array(v)], names=["mark", "value"])

    held = sets.join(apart, "rep").withColumn("mark", F.xxhash64("rep", "values"))  # names one text of an id
    entries = held.select("mark", "values").mapInArrow(entries_of, "mark bigint, value bigint")
    known = checkpoint(held.select("mark", "rep", "comp", (F.octet_length("values") / 8).cast("bigint").alias("n")).distinct())
    shared = with_lengths(entries).groupBy("mark").agg(F.sort_array(F.collect_set(F.struct("length", "value"))).alias("shared")).join(known, "mark")
    alone, kept = F.col("n") - F.size("shared"), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = shared.withColumn("alone", alone).withColumn("kept", kept).withColumn("rare", F.expr("slice(shared, 1, greatest(0, cast(kept - alone as int)))"))
    lists = checkpoint(rare.select("rep", "comp", "n", "alone", F.posexplode("rare.value").alias("at", "value")).select("value", "rep", "comp", "n", (F.col("alone") + F.col("at")).alias("place")))
    mixed = lists.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    mixed = checkpoint(mixed.select("value", "size", F.ceil(F.col("size") / CELL).alias("blocks")))
    own = F.pmod(F.xxhash64("rep"), "blocks")
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = join_sized(lists, mixed, ["value"], "size").select("value", "rep", "comp", "n", "place", own.alias("own"), F.explode(meets).alias("cell")).select("value", "cell.i", "cell.j", "own", "rep", "comp", "n", "place")
    return checkpoint(map_groups(dealt, ["value", "i", "j"], lambda t: cell_pairs(t, percent), "a bigint, b bigint").distinct())


def cell_pairs(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of a cell of a list that sizes, components and places allow. What follows a list's value in both orders bounds what they
    share, if it is their first common one; of a linked pair that one passes."""
    own, rep, comp, n, place = (table[c].to_numpy() for c in ("own", "rep", "comp", "n", "place"))
    one = table["i"][0].as_py()
    rows = np.flatnonzero(own == one)
    columns = rows if one == table["j"][0].as_py() else np.flatnonzero(own != one)
    out = []
    for r in rows.tolist():
        need = -(-percent * (n[r] + n[columns]) // (100 + percent))
        fits = (comp[columns] != comp[r]) & (100 * np.minimum(n[columns], n[r]) >= percent * np.maximum(n[columns], n[r])) & (np.minimum(n[r] - place[r], n[columns] - place[columns]) >= need)
        other = rep[columns[fits]]
        out.append(np.stack([np.minimum(other, rep[r]), np.maximum(other, rep[r])]))
    a, b = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[new], b[new]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
