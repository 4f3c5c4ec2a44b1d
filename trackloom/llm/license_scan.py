"""License scan as an exact set-similarity join of text blocks with notice templates, in DataFrame functions alone.

A block is a line of text, or a run of words over several lines, as a notice wrapped over lines is, of at most the template's words
divided by ``threshold``. A template is found in a block that holds at least ``threshold`` of its distinct words. Tokens are ordered by
how many documents hold them, rarest first, counted over the whole corpus. A block that holds ``need`` of a template's tokens must hold
one of its first ``size - need + 1`` (prefix filter), at least ``need`` tokens of any template (length filter), and enough tokens from
its first common one onwards (positional filter); what is left is verified by the full intersection. Runs are looked at where all lines
of a text together pass these filters. The templates are a parameter of bounded size and stay inside the expressions, so nothing is
shuffled but their tokens' counts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import texts_of

#: Public notices by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Phrases, in words, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Templates that the expressions may hold.
MOST_TEMPLATES = 1000


def template_tokens(text: str) -> list[str]:
    return sorted(set(re.sub(NOT_WORD, " ", text.lower()).split()))


def spaced(text: Column) -> Column:
    """Lower-case words of a text, each with one space before it. Letters outside ASCII are lowered too, which no boundary depends on."""
    return F.rtrim(F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.lower(text), NOT_WORD, " "))))


def count_words(spaced_text: Column) -> Column:
    return F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def token_order(texts: DataFrame, templates: list[tuple[str, list[str]]]) -> list[str]:
    """The templates' tokens by the number of documents that hold them, rarest first."""
    vocabulary = sorted({t for _, tokens in templates for t in tokens})
    held = texts.select(F.explode(F.array_intersect(F.split(F.ltrim(spaced(F.col("text"))), " "), strings(vocabulary))).alias("token"))
    counts = {r.token: r.n for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the vocabulary
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    ``n_base`` counts the places of the fixed phrases, ``first_word`` and ``last_word`` are their least and greatest start in words from
    0 (null without any), ``base_labels`` their labels and ``labels`` those and the matched templates', each distinct, sorted and joined
    by commas. ``blocks`` are the matches (line from 0, label, score): every line that matches, and of runs that overlap and match the
    best, with its first line, where it goes beyond that line. ``score`` is 1 with a phrase and else the greatest containment.
    Null and empty texts have no words; repeated rows are scanned each; an empty table gives an empty result. Other columns are ignored.
    """
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES} fit into the expressions")
    parts = [(label, template_tokens(text)) for label, text in templates]
    spans = [math.floor(round(len(re.sub(NOT_WORD, " ", text.lower()).split()) / threshold, 9)) for (_, text), (_, tokens) in zip(templates, parts, strict=True) if tokens]
    parts = [(label, tokens) for label, tokens in parts if tokens]
    texts = texts_of(docs, id_col, text_col)
    order = token_order(texts, parts)
    rank = {t: i for i, t in enumerate(order)}
    kept, heads = [], set()
    for (label, tokens), span in zip(parts, spans, strict=True):
        tokens = sorted(tokens, key=rank.__getitem__)
        need = max(1, math.ceil(round(threshold * len(tokens), 9)))
        prefix = tokens[: len(tokens) - need + 1]
        heads.update(prefix)
        kept.append(F.struct(F.lit(label).alias("label"), strings(tokens).alias("tokens"), strings(prefix).alias("prefix"), F.lit(need).alias("need"), F.lit(span).alias("span")))
    words = texts.withColumn("words", spaced(F.col("text"))).withColumn("n_words", count_words(F.col("words")))
    base = phrases(words)
    any_head = F.concat(F.col("words"), F.lit(" ")).rlike(" (?:" + "|".join(sorted(heads)) + ") ") if heads else F.lit(False)
    lines = F.transform(F.split("text", "\n"), lambda line: F.array_intersect(strings(order), F.split(F.ltrim(spaced(line)), " ")))
    found = base.withColumn("lines", F.when(any_head, lines).otherwise(F.expr("cast(array() as array<array<string>>)")))

    def close_to(line: Column) -> Column:
        def near(t: Column) -> Column:
            common = F.array_intersect(t["prefix"], line)  # in the order of the tokens, as the line's are
            rest = lambda tokens: F.size(tokens) - F.array_position(tokens, common[0]) + 1
            return (F.size(line) >= t["need"]) & (F.size(common) > 0) & (F.least(rest(t["tokens"]), rest(line)) >= t["need"])

        return F.filter(F.array(*kept), near)

    def matches(line: Column, number: Column) -> Column:
        close = close_to(line)
        verified = F.transform(close, lambda t: F.struct(number.cast("int").alias("line"), t["label"].alias("label"), (F.size(F.array_intersect(t["tokens"], line)) / F.size(t["tokens"])).alias("score"), t["need"].alias("need"), F.size(t["tokens"]).alias("size")))
        exact = F.filter(verified, lambda m: F.round(m["score"] * m["size"]) >= m["need"])
        return F.transform(exact, lambda m: F.struct(m["line"].alias("line"), m["label"].alias("label"), m["score"].alias("score")))

    if kept:
        found = found.withColumn("held", F.array_intersect(strings(order), F.flatten("lines")))
        found = found.withColumn("wrapped", F.when(F.size("lines") > 1, close_to(F.col("held"))))
        # the tokens' places are bound to a variable, so that they are found once a text
        over = F.flatten(F.flatten(F.transform(F.array(token_places(order)), lambda places: F.transform("wrapped", lambda t: runs(places, t)))))
        in_lines = F.flatten(F.transform("lines", matches))
        found = found.withColumn("blocks", F.when(F.size("wrapped") > 0, F.concat(in_lines, over)).otherwise(in_lines))
    else:
        found = found.withColumn("blocks", F.expr("cast(array() as array<struct<line: int, label: string, score: double>>)"))
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["score"])), F.lit(0.0))
    return found.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.transform("blocks", lambda b: b["label"]))).alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"), "blocks",
    )


def token_places(order: list[str]) -> Column:
    """(at, line, word) of each word of ``order`` in a text, by its place in words."""
    words = lambda line: F.filter(F.split(F.ltrim(spaced(line)), " "), lambda w: w != "")
    by_line = F.transform(F.split("text", "\n"), lambda line, k: F.transform(words(line), lambda w: F.struct(k.alias("line"), w.alias("word"))))
    placed = F.transform(F.flatten(by_line), lambda x, i: F.struct(i.alias("at"), x["line"].alias("line"), x["word"].alias("word")))
    return F.filter(placed, lambda x: x["word"].isin(*order))


def runs(places: Column, t: Column) -> Column:
    """Blocks of the runs of at most ``span`` words, over several lines, that hold ``need`` tokens of the template; of overlapping ones
    the best. Such a run may begin with a token, and has at most ``span`` of them."""
    empty = F.expr("cast(array() as array<struct<at: int, line: int, last: int, n: int>>)")
    own = F.filter(places, lambda x: F.array_contains(t["tokens"], x["word"]))

    def run(a: Column, held: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(held, lambda b: b["word"])))
        return F.struct(a["at"].alias("at"), a["line"].alias("line"), F.element_at(held, -1)["line"].alias("last"), distinct.alias("n"))

    def from_each(o: Column) -> Column:
        held = lambda a, i: F.filter(F.slice(o, i + 1, t["span"]), lambda b: b["at"] < a["at"] + t["span"])
        return F.flatten(F.transform(o, lambda a, i: F.transform(F.array(held(a, i)), lambda h: run(a, h))))

    def better(best: Column, c: Column) -> Column:
        last = F.get(best, F.size(best) - 1)
        apart = (F.size(best) == 0) | (c["at"] >= last["at"] + t["span"])
        return F.when(apart, F.concat(best, F.array(c))).when(c["n"] > last["n"], F.concat(F.slice(best, 1, F.size(best) - 1), F.array(c))).otherwise(best)

    good = F.filter(F.flatten(F.transform(F.array(own), from_each)), lambda c: c["n"] >= t["need"])
    over = F.filter(F.aggregate(good, empty, better), lambda c: c["last"] > c["line"])
    return F.transform(over, lambda c: F.struct(c["line"].alias("line"), t["label"].alias("label"), (c["n"] / F.size(t["tokens"])).alias("score")))


def phrases(words: DataFrame) -> DataFrame:
    """Adds n_base, first_word, last_word and the array ``base`` of labels. A text is cut at each place of a phrase; words are counted
    in the cuts."""
    out, plain = words, [c for c in words.columns]
    counts, firsts, lasts, labels = [], [], [], []
    for k, (phrase, label) in enumerate(PHRASES):
        name, size = f"cuts{k}", len(phrase.split())
        there = F.contains(F.concat(F.col("words"), F.lit(" ")), F.lit(f" {phrase} "))
        out = out.withColumn(name, F.when(there, F.split("words", f" {phrase}(?= |$)", -1)))
        places = F.coalesce(F.size(F.when(F.col(name).isNotNull(), F.col(name))) - 1, F.lit(0))
        counts.append(F.when(F.col(name).isNull(), F.lit(0)).otherwise(places))
        firsts.append(F.when(F.col(name).isNotNull(), count_words(F.col(name)[0])))
        lasts.append(F.when(F.col(name).isNotNull(), F.col("n_words") - size - count_words(F.element_at(name, -1))))
        labels.append(F.when(F.col(name).isNotNull(), F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return out.select(*plain, total.cast("bigint").alias("n_base"), F.least(*firsts).cast("bigint").alias("first_word"), F.greatest(*lasts).cast("bigint").alias("last_word"), F.array_compact(F.array(*labels)).alias("base"))
