"""Exact duplicates by text digest, with frequent digests taken out before the shuffle.

A Misra-Gries summary (``DataFrame.freqItems``) names at most ``ceil(1 / support)`` digests that may be frequent; their exact counts
and smallest ids are then computed, and the winners so verified are broadcast, so rows of large groups get their answer on the map
side. All other digests are shuffled once; none of their groups holds more than ``support`` of the rows. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import checkpoint, texts_of

#: Smallest share that the summary can be asked for; bounds the broadcast at 10,000 rows.
SUPPORT = 1e-4


def normalised(text: Column) -> Column:
    """Each run of space, tab, line feed, vertical tab, form feed and carriage return as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; all empty texts are one group. Of a group the smallest doc_id stays (nulls only if there is no other);
    rows that repeat that id with the same text are all marked kept. An empty table gives an empty result. Columns of ``docs`` other
    than the two named are ignored.
    """
    digests = checkpoint(texts_of(docs, id_col, text_col).select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("digest")))
    frequent = digests.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    verified = (
        digests.join(F.broadcast(frequent), "digest")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") > 1)
    )
    winners = checkpoint(verified)  # at most ceil(1 / support) rows
    heavy = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    light = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("doc_id", "digest", F.min("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"))
    return heavy.select(*light.columns).unionByName(light).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
