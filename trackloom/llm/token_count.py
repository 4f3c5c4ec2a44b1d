"""Token counts on the map side: a broadcast table of frequent pieces, then each worker's cache; no piece is ever shuffled."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_texts, sampled, texts_of
from trackloom.llm.tokens import LONGEST, PieceEncoder, cut, led, worker_encoder

#: Documents of at most ``SAMPLE_BYTES`` from which the frequent pieces are taken, and entries of the table that is broadcast. They
#: bound the table at about 2 MB; they change speed only, never a count.
SAMPLE_DOCS, SAMPLE_BYTES, TABLE = 2000, 32_768, 20_000


def frequent_pieces(docs: DataFrame, size: int = TABLE) -> list[str]:
    """The most frequent pieces of a bounded sample of (doc_id, text)."""
    some = sampled(docs, "doc_id", SAMPLE_DOCS).filter(F.octet_length("text") <= SAMPLE_BYTES).select("text")
    found = Counter(p for r in some.toLocalIterator() for p in cut(r.text)[1:] if len(p) <= LONGEST)
    return [p for p, n in found.most_common(size) if n > 1]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``), one row per row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE file in the tokenizers library's format, present on every machine. Null texts count
    as empty (0 tokens); texts of any length are counted whole; repeated rows are counted each; an empty table gives an empty result.
    Other columns of ``docs`` are ignored.
    """
    texts = texts_of(docs, id_col, text_col)
    pieces = frequent_pieces(texts)
    lengths = PieceEncoder(tokenizer, len, sum)
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(pieces, lengths.encode(list(map(led, pieces))), strict=True)))

    def make():
        encoder = worker_encoder(tokenizer, "lengths", len, sum, table.value)
        return lambda texts: {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": [sum(x) for x in encoder.batch(texts)]}

    return map_texts(texts, make, {"n_bytes": "bigint", "n_tokens": "bigint"}).withColumn("over_limit", F.col("n_tokens") > limit)
