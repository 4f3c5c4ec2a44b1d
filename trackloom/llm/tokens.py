"""Exact token ids by pieces of text that the byte-level tokenizer never joins.

The tokenizer's own splitting always begins a new piece at a space that a non-space follows. So a text is cut there with one
``str.split``, and what each piece gives is remembered. A piece may hold several of the library's own pre-tokens; the cuts are a
subset of the library's. Texts that hold an added token's string go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

from trackloom.llm.common import remembered

#: White space of Unicode and of Python; a space before any of these is no cut.
SPACES = frozenset(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Longest piece that is remembered, in characters.
LONGEST = 48
#: Pieces, and pre-tokens within them, that a worker remembers (about 200 bytes each).
PIECES, INNER = 500_000, 200_000
#: White space other than single spaces and line feeds between other characters.
ODD = re.compile("[ \n](?=[" + "".join(sorted(SPACES)) + "]|\\Z)|[" + "".join(sorted(SPACES - {" ", "\n"})) + "]")
#: The library's own pattern, with letters and digits spelled out for texts of ``PLAIN`` characters alone.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"[\n\x20-\x7EÀ-ÖØ-öø-ÿ]*")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def added_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f).get("added_tokens") or []]


def even(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters."""
    if text and text.replace("\n", "").isprintable():  # the only printable white space is the space
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n")
    return not ODD.search(text)


def cut(text: str) -> list[str]:
    """Pieces of the text: the first as it is, others without the space that leads them; one led by a line feed keeps that instead."""
    if even(text):
        return text.replace("\n", " \n").split(" ")
    parts = text.split(" ")
    out = parts[:1]
    for p in parts[1:]:
        if p and p[0] not in SPACES:
            out.append(p)
        else:
            out[-1] += " " + p
    return out


def led(piece: str) -> str:
    """What a piece other than the first stands for."""
    return piece if piece[0] == "\n" else " " + piece


class PieceEncoder:
    """Values of texts over their pieces: ``value`` makes one from the library's encoding, ``total`` one from several.

    A piece is looked up whole; one that is not known and of plain characters is looked up by its pre-tokens; only what is still not
    known goes to the library. Tables are filled until they hold ``PIECES`` and ``INNER`` entries and then stay as they are.
    """

    def __init__(self, path: str, value, total, frequent: dict | None = None):
        self.tokenizer, self.added, self.value, self.total = load(path), added_strings(path), value, total
        self.pieces, self.inner = dict(frequent or {}), {}

    def encode(self, texts: list[str]) -> list:
        return [self.value(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def learn(self, texts: list[str]) -> list:
        """The value of each text, none of which may hold an added token's string."""
        inner, total = self.inner, self.total
        word = lambda t: t[1:].isalpha() and t[0] == " " and t.isascii()  # noqa: E731  one pre-token
        split = [(t,) if word(t) else PRE_TOKEN.findall(t) if PLAIN.fullmatch(t) else (t,) for t in texts]
        alone = [t for t, x in zip(texts, split, strict=True) if len(x) == 1]
        unknown = list(set(chain.from_iterable(x for x in split if len(x) > 1)).difference(inner))
        values = self.encode(unknown + alone)
        inner.update(zip(unknown, values, strict=False))
        whole = iter(values[len(unknown) :])
        out = [next(whole) if len(x) == 1 else total(map(inner.__getitem__, x)) for x in split]
        forget(inner, unknown, INNER)
        return out

    def batch(self, texts: list[str]) -> list[list]:
        """For each text the values of its pieces, in order."""
        get, heads, out, holes, missing = self.pieces.get, [], [], [], {}
        for text in texts:
            parts = [text] if self.whole(text) else cut(text)
            heads.append(parts[0])
            parts[0] = ""
            values = list(map(get, parts))
            out.append(values)
            at = [i for i, v in enumerate(values) if v is None]
            holes.append((at, [missing.setdefault(parts[i], len(missing)) for i in at[1:]]))
        new = list(missing)
        learned = self.learn(list(map(led, new)))
        whole = [h for h in heads if self.whole(h)]
        rest = [h for h in heads if not self.whole(h)]
        first = dict(zip([*whole, *rest], [*self.encode(whole), *self.learn(rest)], strict=True))
        for head, values, (at, of) in zip(heads, out, holes, strict=True):
            values[0] = first[head]
            for i, k in zip(at[1:], of, strict=True):
                values[i] = learned[k]
        room = PIECES - len(self.pieces)
        if room > 0:
            self.pieces.update((p, v) for p, v in zip(new, learned, strict=True) if len(p) <= LONGEST)
        return out


def forget(table: dict, new: list[str], most: int) -> None:
    """Take the new entries out again where the table is full, and long ones in any case."""
    full = len(table) > most
    for p in new:
        if full or len(p) > LONGEST:
            del table[p]


def worker_encoder(path: str, name: str, value, total, frequent: dict | None = None) -> PieceEncoder:
    """The encoder of this worker process for ``name``; what it has learned serves later tasks too."""
    return remembered(("encoder", path, name), lambda: PieceEncoder(path, value, total, frequent))
