"""Repeated byte strings across documents by bucket-pointer refinement.

Bytes covered by a string of ``LENGTH`` bytes that also starts in a document of smaller id are removed.

1. Texts are dealt into parts of some megabytes by a hash of the text, so most copies of one text meet in one part; copies of a text
   that would fill more than a part are spread over several.
2. Every string of ``LENGTH`` bytes has an anchor: the least hash of its grams of ``GRAM`` bytes. Equal strings have equal anchors, and
   neighbouring strings mostly share one. A part sends each of its anchors once, with whether several of its documents hold it, to a
   bucket; the bucket tells the parts which anchors more than one document holds, and which of those only they do.
3. Each run of strings with such an anchor is a segment. Pieces of bytes are put into buckets and these are refined by the q-gram at
   later offsets until a bucket holds equal pieces; of a bucket the smallest document stays and the others' strings go. A part refines
   its own segments first and sends one of each bucket on, so a passage that a third of all documents hold costs one entry a part.
4. Where an anchor has different segments, their strings are refined: a bucket number is the place of its first string in the order so
   far, buckets of 8 bytes are refined by the numbers 8 bytes later, those by the refined numbers 16 bytes later, and so on up to
   ``LENGTH``; numbers once refined serve the next step, and buckets of one string are left as they are. Each final bucket's smallest
   document keeps its string.
5. The removed ranges meet their texts, which are read from the shuffle of step 1.

The first filter is a prefilter alone: what is removed is decided by refined buckets, in a part or behind the second shuffle. Buckets
are worked off as their rows stream in, so copies beyond the smallest are forgotten at once, and the parts' and buckets' numbers
follow the size of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import checkpoint, fold_groups, partitions_for, texts_of

LENGTH, GRAM = 50, 20
#: Bytes of text to a part and to a bucket, and the greatest number of texts whose copies are spread by name.
PART_BYTES, BUCKET_BYTES, HEAVY = 4 << 20, 8 << 20, 500_000
#: Positions whose anchors are computed at once, and bytes of segments that are refined at once.
AT_ONCE, LOT = 1 << 18, 1 << 20
#: Strings in a segment; longer runs of one anchor are cut.
RUN = 256
#: Entries that are held before they are sent.
HELD = 1 << 19
U64 = np.uint64


def anchors(raw: np.ndarray) -> np.ndarray:
    """For each start of a string of ``LENGTH`` bytes its anchor, in pieces of bounded memory."""
    n = len(raw) - LENGTH + 1
    out = np.empty(max(n, 0), U64)
    for at in range(0, n, AT_ONCE):
        upto = min(n, at + AT_ONCE)
        h1 = raw[at : upto + LENGTH - 1].astype(U64) + U64(1)
        h2 = h1[:-1] * U64(0x9E3779B97F4A7C15) + h1[1:]
        h4 = h2[:-2] * U64(0xC2B2AE3D27D4EB4F) + h2[2:]
        h8 = h4[:-4] * U64(0x165667B19E3779F9) + h4[4:]
        h16 = h8[:-8] * U64(0xD6E8FEB86659FD93) + h8[8:]
        h = h16[: len(h4) - 16] * U64(0xA0761D6478BD642F) + h4[16:]
        h ^= h >> U64(32)
        h *= U64(0xE7037ED1A0B428DB)
        h ^= h >> U64(29)
        for step in (1, 2, 4, 8, LENGTH - GRAM - 15):
            h = np.minimum(h[:-step], h[step:])
        out[at:upto] = h
    return out


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor * U64(0x9FB21C651E98DF25)) >> U64(20)) % U64(buckets)


class Texts:
    """The texts of a table as one array of bytes, with where each begins."""

    def __init__(self, table: pa.Table):
        column = table["text"].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        begins = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2] if len(column) else None
        self.raw = np.frombuffer(data, np.uint8)[: begins[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
        self.begins, self.ids, self.marks = begins, table["doc_id"].to_numpy(), table["mark"].to_numpy()

    def __len__(self) -> int:
        return len(self.ids)

    def slices(self) -> Iterator[tuple[int, int, int, int]]:
        """Texts from and to, and places from and to: about ``AT_ONCE`` bytes of whole texts, or as many strings of one long text."""
        at = 0
        while at < len(self):
            upto = max(at + 1, int(np.searchsorted(self.begins, self.begins[at] + AT_ONCE, "right")) - 1)
            low, high = int(self.begins[at]), int(self.begins[upto])
            for a in range(low, max(high, low + 1), AT_ONCE):
                yield at, upto, a, min(high, a + AT_ONCE + LENGTH - 1) if high - low > AT_ONCE else high
            at = upto


def runs_of(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of neighbouring strings with one anchor, some texts at a time: text, place of the first string in ``raw``, number of strings,
    48 bits of the anchor."""
    for i, j, low, high in texts.slices():
        a = anchors(texts.raw[low:high])
        if not len(a):
            continue
        begins, ends = np.maximum(texts.begins[i:j], low) - low, np.minimum(texts.begins[i + 1 : j + 1], high) - low
        able = ends - begins >= LENGTH
        inside = np.zeros(len(a), bool)
        for s, e in zip(begins[able].tolist(), ends[able].tolist(), strict=True):
            inside[s : e - LENGTH + 1] = True
        opens = np.ones(len(a), bool)
        opens[1:] = (a[1:] != a[:-1]) | ~inside[:-1]
        opens[begins[able]] = True
        first = np.flatnonzero(opens & inside)
        text = np.searchsorted(begins, first, "right") - 1  # empty texts begin where the next one does; this gives the last of them
        last = np.minimum(np.append(first[1:], len(a)), ends[text] - LENGTH + 1)  # to the next run, or to the text's last string
        yield text + i, first + low, last - first, (a[first] * U64(0xD1342543DE82EF95)) >> U64(16)


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor * U64(0x9FB21C651E98DF25)) >> U64(20)) % U64(buckets)


class Texts:
    """The texts of a table as one array of bytes, with where each begins."""

    def __init__(self, table: pa.Table):
        column = table["text"].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        begins = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2] if len(column) else None
        self.raw = np.frombuffer(data, np.uint8)[: begins[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
        self.begins, self.ids, self.marks = begins, table["doc_id"].to_numpy(), table["mark"].to_numpy()

    def __len__(self) -> int:
        return len(self.ids)

    def slices(self) -> Iterator[tuple[int, int]]:
        """Texts of about ``AT_ONCE`` bytes together, or one."""
        at = 0
        while at < len(self):
            upto = max(at + 1, int(np.searchsorted(self.begins, self.begins[at] + AT_ONCE, "right")) - 1)
            yield at, upto
            at = upto


def runs_of(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of neighbouring strings with one anchor, some texts at a time: text, place of the first string in ``raw``, number of strings,
    48 bits of the anchor."""
    for i, j in texts.slices():
        low, high = int(texts.begins[i]), int(texts.begins[j])
        a = anchors(texts.raw[low:high])
        if not len(a):
            continue
        begins, sizes = texts.begins[i:j] - low, np.diff(texts.begins[i : j + 1])
        inside = np.zeros(len(a), bool)
        for s, n in zip(begins.tolist(), sizes.tolist(), strict=True):
            if n >= LENGTH:
                inside[s : s + n - LENGTH + 1] = True
        opens = np.ones(len(a), bool)
        opens[1:] = (a[1:] != a[:-1]) | ~inside[:-1]
        opens[begins[(sizes >= LENGTH)]] = True
        opens &= inside
        first = np.flatnonzero(opens)
        # a run ends where the next begins or where its text has no further string
        text = np.searchsorted(begins, first, "right") - 1  # empty texts begin where the next one does; this gives the last of them
        last = np.minimum(np.append(first[1:], len(a)), begins[text] + sizes[text] - LENGTH + 1)
        yield text + i, first + low, last - first, (a[first] * U64(0xD1342543DE82EF95)) >> U64(16)


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor * U64(0x9FB21C651E98DF25)) >> U64(20)) % U64(buckets)


def six_bytes(values: np.ndarray) -> bytes:
    """Numbers below 2**48 in six bytes each. Anchors that collide in them only make candidates; bytes decide in the end."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(U64)


def packed(**columns) -> dict[str, bytes]:
    return {k: np.ascontiguousarray(v).tobytes() for k, v in columns.items()}


def cuts_of(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal keys."""
    if not len(sorted_keys):
        return []
    edges = np.concatenate([[0], np.flatnonzero(np.diff(sorted_keys)) + 1, [len(sorted_keys)]]).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


ANCHORS = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("anchors", pa.binary()), ("several", pa.binary())])
REPEATED = pa.schema([("part", pa.int64()), ("anchors", pa.binary()), ("own", pa.binary())])
SEGMENTS = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), *((k, pa.binary()) for k in ("ids", "marks", "at", "starts", "ends", "anchors", "bytes"))])
RANGES = pa.schema([("part", pa.int64()), *((k, pa.binary()) for k in ("ids", "marks", "starts", "ends"))])
KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<bigint>, kept_sha256 string"


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int64(): 'bigint', pa.int32(): 'int'}).get(f.type, 'binary')}" for f in schema)


def anchors_of_part(table: pa.Table, buckets: int) -> pa.Table:
    """Each anchor of a part once, to its bucket: those of one document, and those of several."""
    texts, part = Texts(table), table["part"][0].as_py()
    found, held = [], []
    for text, _, _, anchor in runs_of(texts):
        found.append(anchor), held.append(texts.ids[text])
    anchor, ids = (np.concatenate(found), np.concatenate(held)) if found else (np.empty(0, U64), np.empty(0, np.int64))
    order = np.argsort(anchor, kind="stable")
    anchor, ids = anchor[order], ids[order]
    head = np.ones(len(anchor), bool)
    head[1:] = anchor[1:] != anchor[:-1]
    at = np.flatnonzero(head)
    several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at) if len(at) else np.empty(0, bool)
    anchor = anchor[at]
    bucket = bucket_of(anchor, buckets)
    order = np.lexsort((anchor, bucket))
    bucket, anchor, several = bucket[order], anchor[order], several[order]
    rows = [{"bucket": int(bucket[a]), "part": part, "anchors": six_bytes(anchor[a:b][~several[a:b]]), "several": six_bytes(anchor[a:b][several[a:b]])} for a, b in cuts_of(bucket)]
    return pa.Table.from_pylist(rows, ANCHORS)


class AnchorFold:
    """Streams over the anchors that parts send to a bucket. Holds each anchor once: with its part until another part sends it, too."""

    def __init__(self):
        none = np.empty(0, U64)
        self.once, self.part, self.several, self.twice = none, np.empty(0, np.int64), np.empty(0, bool), none
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, table: pa.Table) -> Iterator[pa.Table]:
        for part, alone, several in zip(*(table[c].to_pylist() for c in ("part", "anchors", "several")), strict=True):
            a, s = from_six_bytes(alone), from_six_bytes(several)
            self.waiting.append((np.concatenate([a, s]), np.full(len(a) + len(s), part), np.arange(len(a) + len(s)) >= len(a)))
            self.size += len(a) + len(s)
            if self.size >= HELD:
                yield from self.merged()

    def merged(self) -> Iterator[pa.Table]:
        """What is known now to be repeated, to the parts that hold it."""
        anchor, part, several = (np.concatenate(x) for x in zip((self.once, self.part, self.several), *self.waiting, strict=True))
        self.waiting, self.size = [], 0
        known = among(anchor, self.twice)
        out = [(part[known], anchor[known])]
        order = np.argsort(anchor[~known], kind="stable")
        anchor, part, several = anchor[~known][order], part[~known][order], several[~known][order]
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        at = np.flatnonzero(new)
        again = np.diff(np.append(at, len(anchor))) > 1  # a part sends an anchor once, so this is several parts
        each = np.repeat(again, np.diff(np.append(at, len(anchor))))
        out.append((part[each], anchor[each]))
        self.twice = np.sort(np.concatenate([self.twice, anchor[at][again]]), kind="stable")
        self.once, self.part, self.several = anchor[~each], part[~each], several[~each]
        yield self.rows(np.concatenate([p for p, _ in out]), np.concatenate([a for _, a in out]), "anchors")

    def rows(self, part: np.ndarray, anchor: np.ndarray, name: str) -> pa.Table:
        order = np.argsort(part, kind="stable")
        part, anchor = part[order], anchor[order]
        return pa.Table.from_pylist([{"part": int(part[a]), "anchors": b"", "own": b"", name: six_bytes(anchor[a:b])} for a, b in cuts_of(part)], REPEATED)

    def end(self) -> Iterator[pa.Table]:
        yield from self.merged()
        yield self.rows(self.part[self.several], self.once[self.several], "own")


def grams(data: bytes) -> np.ndarray:
    """The 8 bytes from each place as a number, without a copy."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def split(number: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of members by bucket number and key; in that order the numbers of the buckets refined by ``key``, and how many members
    each has. A bucket's number is the place of its first member in the whole order; refined ones lie between it and the next bucket's,
    so other numbers stay valid. Keys are below 2**32 unless all numbers are 0."""
    both = key if not number.any() else (number.astype(U64) << U64(32)) | key.astype(U64)
    order = np.argsort(both)
    n, both = number[order], both[order]
    new = np.ones(len(order), bool)
    new[1:] = both[1:] != both[:-1]
    old = np.ones(len(order), bool)
    old[1:] = n[1:] != n[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    begins = np.flatnonzero(old)
    return order, n + np.repeat(first, size) - np.repeat(begins, np.diff(np.append(begins, len(order)))), np.repeat(size, size)


def equal_pieces(data: bytes, at: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Bucket numbers from 0 of pieces of bytes: equal for equal pieces of one anchor. Buckets of one anchor and size are refined by the
    q-gram at later offsets; a bucket whose members agree there stays as it is."""
    order, number, members = split(np.zeros(len(at), np.int64), (anchor << U64(16)) | size.astype(U64))
    gram, offset, at, size = grams(data), 0, at[order], size[order]
    open_ = np.flatnonzero(members > 1)  # places in the order, in which buckets stay together
    while len(open_):
        key, n = gram[at[open_] + np.minimum(offset, size[open_] - 8)], number[open_]
        begins = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        width = np.diff(np.append(begins, len(open_)))
        uneven = np.repeat(np.logical_or.reduceat(key != np.repeat(key[begins], width), begins), width)
        some = open_[uneven]
        if len(some):
            ranks = np.unique(key[uneven], return_inverse=True)[1]
            by, number[some], _ = split(number[some], ranks)
            order[some], at[some], size[some] = order[some][by], at[some][by], size[some][by]
        offset += 8
        n = number[open_]
        begins = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        width = np.diff(np.append(begins, len(open_)))
        open_ = open_[(np.repeat(width, width) > 1) & (size[open_] > offset)]
    out = np.empty(len(at), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(number[1:] != number[:-1])]) if len(at) else number
    return out


def refine(number: np.ndarray, room: np.ndarray, open_: np.ndarray, depth: int) -> None:
    """Refines, in place, buckets of strings of ``depth`` bytes to ``LENGTH``. ``room`` is how many bytes follow a place in its segment;
    ``open_`` are the places in buckets of several."""
    step = min(depth, LENGTH - depth)
    if not step or not len(open_):
        return
    longer = room[open_] >= depth + step
    later = np.where(longer, number[np.minimum(open_ + step, len(number) - 1)] + 1, 0)  # a place without room comes first
    order, numbers, members = split(number[open_], later)
    open_, longer = open_[order], longer[order]
    number[open_] = numbers
    refine(number, room, open_[longer & (members > 1)], depth + step)


def string_buckets(data: bytes, room: np.ndarray) -> np.ndarray:
    """For each place with room for ``LENGTH`` bytes its bucket number, equal for equal strings."""
    open_ = np.flatnonzero(room >= 8)
    number = np.full(len(room), -1, np.int64)
    order, numbers, members = split(np.zeros(len(open_), np.int64), grams(data)[open_])
    open_ = open_[order]
    number[open_] = numbers
    refine(number, room, open_[members > 1], 8)
    return number


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are in an ascending array."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def refined(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bucket numbers of the strings of ``LENGTH`` bytes that start at ``at``: equal for equal strings."""
    return string_buckets(raw.tobytes(), len(raw) - np.arange(len(raw)))[at]


class Pieces:
    """Pieces of bytes by number."""

    def __init__(self, data: bytes, at: np.ndarray, size: np.ndarray):
        self.data, self.at, self.size = data, at.tolist(), size.tolist()

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int) -> bytes:
        if i >= len(self.at):
            raise IndexError
        return self.data[self.at[i] : self.at[i] + self.size[i]]


def parted(order: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Segments in lots of about ``LOT`` bytes; those of one anchor stay together, as only they can hold equal strings."""
    at, total = 0, 0
    for i, x in enumerate(order.tolist()):
        if total >= LOT and group[x] != group[order[i - 1]]:
            yield order[at:i]
            at, total = i, 0
        total += int(sizes[x])
    if len(order) > at:
        yield order[at:]


def bucket_ranges(segments, anchor_of: np.ndarray, which: np.ndarray, ids: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(ids, marks, starts, ends) of what goes: ``which`` of the different ``segments`` each document has from where on."""
    rows, begin, end = segment_ranges(segments, anchor_of, which, ids)
    return [(ids[rows], marks[rows], starts[rows] + begin, starts[rows] + end)]


def segment_ranges(segments, anchor_of: np.ndarray, which: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The members that lose bytes, and from and to where within their segment."""
    sizes = np.array(segments.size if isinstance(segments, Pieces) else [len(s) for s in segments], np.int64)
    least = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    _, group, times = np.unique(anchor_of, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(times[group] > 1)
    low, high, firsts = least.copy(), least.copy(), {}
    for some in parted(mixed[np.argsort(group[mixed], kind="stable")], group, sizes):
        begin = np.concatenate([[0], np.cumsum(sizes[some])])
        of = np.repeat(np.arange(len(some)), sizes[some])
        room = begin[1:][of] - np.arange(begin[-1])
        number = string_buckets(b"".join(segments[i] for i in some.tolist()) + bytes(7), room)
        at = np.flatnonzero(room >= LENGTH)
        names, bucket = np.unique(number[at], return_inverse=True)
        first = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(first, bucket, least[some][of[at]])
        first = first[bucket]
        edge = np.concatenate([[0], np.cumsum(sizes[some] - LENGTH + 1)])
        low[some], high[some] = np.minimum.reduceat(first, edge[:-1]), np.maximum.reduceat(first, edge[:-1])
        for k in np.flatnonzero(low[some] != high[some]).tolist():
            firsts[int(some[k])] = first[edge[k] : edge[k + 1]].copy()
    whole = high[which] < ids
    rows, begins, ends = [np.flatnonzero(whole)], [np.zeros(int(whole.sum()), np.int64)], [sizes[which[whole]]]
    for k in np.flatnonzero(~whole & (low[which] < ids)).tolist():
        hit = np.flatnonzero(firsts[int(which[k])] < ids[k])
        cut = np.flatnonzero(np.diff(hit) > LENGTH)
        rows.append(np.full(len(cut) + 1, k)), begins.append(hit[np.concatenate([[0], cut + 1])]), ends.append(hit[np.concatenate([cut, [len(hit) - 1]])] + LENGTH)
    return np.concatenate(rows), np.concatenate(begins), np.concatenate(ends)


class Segments:
    """Segments of documents: ``data`` holds the bytes, other fields are arrays with an entry a segment."""

    def __init__(self, data: bytes, **fields):
        self.data, self.fields = data, fields

    def __getattr__(self, name: str):
        return self.fields[name]

    def only(self, keep: np.ndarray) -> Segments:
        return Segments(self.data, **{k: v[keep] for k, v in self.fields.items()})

    def moved(self) -> Segments:
        """The same with no other bytes."""
        at, size = self.at.tolist(), self.size.tolist()
        data = b"".join([self.data[a : a + n] for a, n in zip(at, size, strict=True)])
        return Segments(data, **self.fields | {"at": np.cumsum(self.size) - self.size})

    def collapsed(self) -> tuple[Segments, tuple[np.ndarray, ...], np.ndarray]:
        """Of equal segments those of the smallest document, the ranges of the others, which go, and the bucket numbers of those left."""
        number = equal_pieces(self.data + bytes(7), self.at, self.size, self.anchor)
        least = np.full(int(number.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, number, self.ids)
        gone = self.ids > least[number]
        g = self.only(gone)
        return self.only(~gone), (g.part, g.ids, g.marks, g.starts, g.starts + g.size), number[~gone]

    def ranges(self, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """What goes of collapsed segments, whose bucket numbers are ``number``."""
        _, one, which = np.unique(number, return_index=True, return_inverse=True)
        rows, begin, end = segment_ranges(Pieces(self.data, self.at[one], self.size[one]), self.anchor[one], which, self.ids)
        return self.part[rows], self.ids[rows], self.marks[rows], self.starts[rows] + begin, self.starts[rows] + end


def merged_ranges(part: np.ndarray, ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of the same row that touch as one; in order of part and row."""
    order = np.lexsort((starts, marks, ids, part))
    part, ids, marks, starts, ends = (x[order] for x in (part, ids, marks, starts, ends))
    if not len(part):
        return part, ids, marks, starts, ends
    row = np.concatenate([[0], np.cumsum((np.diff(part) != 0) | (np.diff(ids) != 0) | (np.diff(marks) != 0))])
    _, row_of = np.unique(row, return_inverse=True)
    shift = row_of.astype(np.int64) << 32  # texts are shorter than that
    reach = np.maximum.accumulate(ends + shift)
    new = np.concatenate([[True], (starts + shift)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return part[at], ids[at], marks[at], starts[at], (reach - shift)[np.append(at[1:], len(part)) - 1]


def range_rows(found: list[tuple[np.ndarray, ...]]) -> pa.Table:
    """A row for each part with the ranges of its documents."""
    part, *rest = merged_ranges(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else [np.empty(0, np.int64)]
    return pa.Table.from_pylist([{"part": int(part[a])} | packed(**{k: v[a:b] for k, v in zip(("ids", "marks", "starts", "ends"), rest, strict=True)}) for a, b in cuts_of(part)], RANGES)


def segments_of_part(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """What a part sends: to each bucket the different segments of its documents, each of the smallest of them (kind 0), and the ranges
    that its own documents remove from one another (kind 1)."""
    if not left.num_rows or not right.num_rows:
        return SEGMENTS.empty_table()
    texts, part = Texts(left), left["part"][0].as_py()
    join = lambda c: np.sort(from_six_bytes(b"".join(right[c].to_pylist())))
    known, own = join("anchors"), join("own")
    parts = []
    for text, at, n, anchor in runs_of(texts):
        keep = among(anchor, known) | among(anchor, own)
        text, at, n, anchor = text[keep], at[keep], n[keep], anchor[keep]
        more = -(-n // RUN)  # long runs are cut
        piece = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
        of = np.repeat(np.arange(len(n)), more)
        parts.append((text[of], at[of] + piece * RUN, np.minimum(n[of] - piece * RUN, RUN) + LENGTH - 1, anchor[of]))
    text, at, size, anchor = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4
    if not len(text):
        return SEGMENTS.empty_table()
    whole = Segments(texts.raw.tobytes(), row=text, part=np.full(len(text), part), ids=texts.ids[text], marks=texts.marks[text], starts=at - texts.begins[text], at=at, size=size, anchor=anchor)
    whole, gone, number = whole.collapsed()
    alone = among(whole.anchor, own)
    found = [gone, whole.only(alone).ranges(number[alone])]
    rows = [{"bucket": p % buckets, "part": p, "kind": 1} | {k: r[k] for k in ("ids", "marks", "starts", "ends")} for r in range_rows(found).to_pylist() for p in (r["part"],)]
    sent = whole.only(~alone)
    bucket = bucket_of(sent.anchor, buckets)
    order = np.argsort(bucket, kind="stable")
    for a, b in cuts_of(bucket[order]):
        s = sent.only(order[a:b])
        row, of = np.unique(s.row, return_inverse=True)
        s = s.moved()
        rows.append({"bucket": int(bucket[order[a]]), "part": part, "kind": 0, "anchors": six_bytes(s.anchor), "bytes": s.data} | packed(ids=texts.ids[row], marks=texts.marks[row], at=of.astype(np.int32), starts=s.starts.astype(np.uint32), ends=s.size.astype(np.uint16)))
    return pa.Table.from_pylist(rows, SEGMENTS)


class SegmentFold:
    """Streams over the segments that parts send to a bucket. Holds those of the smallest document of each refined bucket, so what it
    holds follows the different segments and not their copies; the end refines the strings where an anchor has different segments."""

    def __init__(self):
        self.held: Segments | None = None
        self.number: np.ndarray | None = None
        self.waiting: list[dict] = []
        self.size = 0
        self.out: list[tuple[np.ndarray, ...]] = []
        self.n_out = 0

    def add(self, table: pa.Table) -> Iterator[pa.Table]:
        for row in table.to_pylist():
            i, m = (np.frombuffer(row[k], np.int64) for k in ("ids", "marks"))
            if row["kind"] == 1:
                yield from self.gone((np.full(len(i), row["part"]), i, m, np.frombuffer(row["starts"], np.int64), np.frombuffer(row["ends"], np.int64)))
                continue
            at = np.frombuffer(row["at"], np.int32)
            self.waiting.append({"part": np.full(len(at), row["part"]), "ids": i[at], "marks": m[at], "starts": np.frombuffer(row["starts"], np.uint32).astype(np.int64), "size": np.frombuffer(row["ends"], np.uint16).astype(np.int64), "anchor": from_six_bytes(row["anchors"]), "data": row["bytes"]})
            self.size += len(row["bytes"])
            if self.size >= max(LOT, len(self.held.data) if self.held else 0):  # so that what is held is seldom refined again
                yield from self.merged()

    def gone(self, found: tuple[np.ndarray, ...]) -> Iterator[pa.Table]:
        self.out.append(found)
        self.n_out += len(found[0])
        if self.n_out >= HELD:
            yield range_rows(self.out)
            self.out, self.n_out = [], 0

    def merged(self) -> Iterator[pa.Table]:
        if not self.waiting:
            return
        held = [{"data": self.held.data} | {k: v for k, v in self.held.fields.items() if k != "at"}] if self.held else []
        data = b"".join(x["data"] for x in held + self.waiting)
        fields = {k: np.concatenate([x[k] for x in held + self.waiting]) for k in ("part", "ids", "marks", "starts", "size", "anchor")}
        self.waiting, self.size = [], 0
        left, found, self.number = Segments(data, at=np.cumsum(fields["size"]) - fields["size"], **fields).collapsed()
        self.held = left.moved()
        yield from self.gone(found)

    def end(self) -> Iterator[pa.Table]:
        yield from self.merged()
        if self.held:
            self.out.append(self.held.ranges(self.number))
        yield range_rows(self.out)


def finished_part(left: pa.Table, right: pa.Table) -> pa.Table:
    texts = Texts(left)
    found: list[list[np.ndarray]] = [[], [], [], []]
    for row in right.to_pylist():
        for k, x in zip(("ids", "marks", "starts", "ends"), found, strict=True):
            x.append(np.frombuffer(row[k], np.int64))
    ids, marks, starts, ends = (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
    _, ids, marks, starts, ends = merged_ranges(np.zeros(len(ids), np.int64), ids, marks, starts, ends)
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, m, a, b in zip(ids.tolist(), marks.tolist(), starts.tolist(), ends.tolist(), strict=True):
        spans.setdefault((i, m), []).append((a, b))
    removed, flat, digests = [], [], []
    view, begins = memoryview(texts.raw), texts.begins.tolist()
    for k, key in enumerate(zip(texts.ids.tolist(), texts.marks.tolist(), strict=True)):
        text, of, digest, at = view[begins[k] : begins[k + 1]], spans.get(key, []), hashlib.sha256(), 0
        for a, b in of:
            digest.update(text[at:a])
            at = b
        digest.update(text[at:])
        removed.append(sum(b - a for a, b in of)), flat.append([x for r in of for x in r]), digests.append(digest.hexdigest())
    return pa.table({"doc_id": pa.array(texts.ids, pa.int64()), "n_bytes": pa.array(np.diff(texts.begins), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(flat, pa.list_(pa.int64())), "kept_sha256": pa.array(digests, pa.string())})


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans, kept_sha256.

    Texts are taken as UTF-8, null as empty. ``spans`` is a flat array of start and end (exclusive) of the maximal removed byte ranges;
    strings are judged on the input, not on what is left. ``doc_id`` is of an integer type, others are refused; rows that repeat an id
    are judged each and don't remove from one another; a row without id is left as it is and removes nothing. A text is held whole by
    the worker that has its part, with arrays for ``AT_ONCE`` of its places at a time and for its segments; a text longer than a part is
    a part of its own size. An empty table gives an empty result. Other columns are ignored.
    """
    texts = texts_of(docs, id_col, text_col)
    if dict(texts.dtypes)["doc_id"] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} must be of an integer type")
    size = F.octet_length("text").cast("bigint")
    texts = texts.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    short = F.col("doc_id").isNull() | (size < LENGTH)
    own = texts.filter(~short).withColumn("mark", F.xxhash64("text"))
    held = checkpoint(own.groupBy("mark").agg(F.sum(size).alias("held")))
    total = held.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    least = partitions_for(docs) if total else 1
    parts, buckets = max(least, -(-total // part_bytes)), max(least, -(-total // bucket_bytes))
    size_of_part = max(1, total // parts)
    heavy = held.filter(F.col("held") > max(size_of_part, total // HEAVY)).select("mark", F.ceil(F.col("held") / size_of_part).alias("cells"))  # fewer than HEAVY rows
    cell = F.when(F.col("cells").isNotNull(), F.pmod(F.xxhash64("doc_id"), "cells")).otherwise(F.lit(0).cast("bigint"))
    part = F.pmod(F.xxhash64("mark", cell), F.lit(parts).cast("bigint"))
    dealt = own.join(F.broadcast(heavy), "mark", "left").select(part.alias("part"), "doc_id", "mark", "text").repartition(partitions_for(docs), "part")

    of_part = dealt.groupBy("part")
    sent = of_part.applyInArrow(lambda t: anchors_of_part(t, buckets), ddl(ANCHORS))
    repeated = fold_groups(sent, ["bucket"], AnchorFold, ddl(REPEATED))
    segments = of_part.cogroup(repeated.groupBy("part")).applyInArrow(lambda a, b: segments_of_part(a, b, buckets), ddl(SEGMENTS))
    ranges = fold_groups(segments, ["bucket"], SegmentFold, ddl(RANGES))
    kept = of_part.cogroup(ranges.groupBy("part")).applyInArrow(finished_part, KEPT)

    none = F.expr("cast(array() as array<bigint>)")
    rest = texts.filter(short).select("doc_id", size.alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), none.alias("spans"), F.sha2("text", 256).alias("kept_sha256"))
    return kept.unionByName(rest)
