"""Secret scan: one Aho-Corasick pass finds keywords, anchored patterns run only at the hits, checksums confirm issued tokens."""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import DataFrame

from trackloom.llm.common import map_texts, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Issued tokens: a prefix, 30 characters, and the CRC-32 of those in six base-62 digits.
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Keyword (lower case) and the kind that it may begin.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
KINDS = ("assign", "access", "hex", "github", "npm")
UPPER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    """A-Z lowered and nothing else, so that offsets stay."""
    return text.lower() if text.isascii() else text.translate(UPPER)


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of ``body``."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def spans_of(text: str, keywords) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed in ``KINDS``; code points, end exclusive."""
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    for start, kind in sorted((end - n + 1, kind) for end, (n, kind) in keywords.iter(lower_ascii(text))):
        if start < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                free[kind] = m.end()
                if len(m[2]) >= 8:
                    out.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                free[kind] = m.end()
                if len(m[0]) >= 16:
                    out.append((start, m.end(), kind))
        elif (m := CHECKED.match(text, start)) and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")) and checksum(m[1]) == m[2]:
            free[kind] = m.end()
            out.append((start, m.end(), kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kinds, starts, ends (arrays in step) of every whole text.

    Null and empty texts have no spans; repeated rows are scanned each; an empty table gives an empty result. Other columns of
    ``docs`` are ignored. Matches of one kind don't overlap; those of different kinds may.
    """

    def make():
        keywords = automaton()

        def scan(texts: list[str]) -> dict:
            found = [spans_of(t, keywords) for t in texts]
            return {"kinds": [[k for _, _, k in x] for x in found], "starts": [[a for a, _, _ in x] for x in found], "ends": [[b for _, b, _ in x] for x in found]}

        return scan

    return map_texts(texts_of(docs, id_col, text_col), make, {"kinds": "array<string>", "starts": "array<int>", "ends": "array<int>"})


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def base_sha256(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(spelled([x for x in spans if x[2] in KINDS[:3]]).encode()).hexdigest()
