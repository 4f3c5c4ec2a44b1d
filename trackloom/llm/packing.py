"""Packing of token sequences by best-fit decreasing, with a segment tree over remaining capacities.

Documents longer than a window are first cut into full windows. Pieces are dealt by hash into shards of bounded size and each shard is
packed on its own, so that no task grows with the corpus; a shard wastes a few windows at most.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import checkpoint, give_back, slices, texts_of
from trackloom.llm.tokens import worker_encoder

#: Pieces that a shard holds on average.
SHARD = 8192


class OpenWindows:
    """Open windows by remaining capacity; ``take`` gives the tightest that still holds ``need``."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.leaves)  # windows below each node
        self.stacks: list[list] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.filled[i] += n
            i >>= 1

    def put(self, room: int, window) -> None:
        self.stacks[room].append(window)
        self._add(room, 1)

    def take(self, need: int):
        """(remaining capacity, window), or None if no open window has room for ``need``."""
        filled, i = self.filled, need + self.leaves
        if not filled[i]:
            while i > 1 and (i & 1 or not filled[i + 1]):
                i >>= 1
            if i == 1:
                return None
            i += 1
            while i < self.leaves:
                i <<= 1
                if not filled[i]:
                    i += 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.stacks[room].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; ``lengths`` descend and are between 1 and ``capacity``."""
    windows, offsets, open_, n = [], [], OpenWindows(capacity), 0
    for length in lengths:
        found = open_.take(length)
        if found is None:
            found, n = (capacity, n), n + 1
        room, window = found
        windows.append(window)
        offsets.append(capacity - room)
        if room > length:
            open_.put(room - length, window)
    return windows, offsets


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the full windows of each document and what is left over."""
    texts = texts_of(docs, id_col, text_col)
    kind = dict(texts.dtypes)["doc_id"]
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, "ids", lambda x: array("I", x.ids).tobytes(), b"".join)
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[tuple[int, int, int, int, int]] = []
                for i, values in enumerate(encoder.batch(part.column(1).to_pylist())):
                    ids = b"".join(values) + end
                    total = len(ids) // 4
                    rows += [(i, s, n := min(capacity, total - s), zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)]), total) for s in range(0, total, capacity)]
                at, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                give_back()

    return texts.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Repeated rows are packed each. Pieces of one length go in the order of
    doc_id (nulls last), start and ids_crc32, so a lost task gives the same result again. ``sequence_id`` is the shard's number times
    2**32 plus the window's number there. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    pieces = checkpoint(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    shards = max(1, -(-pieces.count() // shard))
    kind = dict(pieces.dtypes)["doc_id"]

    def fill(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        table = table.take(order)
        windows, offsets = best_fit(table["length"].to_pylist(), capacity)
        base = table["shard"][0].as_py() << 32
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array([base + w for w in windows], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards).cast("bigint")))
    return dealt.groupBy("shard").applyInArrow(fill, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
