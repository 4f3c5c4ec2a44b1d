"""The corpus pipeline: quality filter, exact and near deduplication, benchmark decontamination, packing.

Every stage works on all that the one before it kept. A filtering stage decides on each row by itself, whether its id is its own, repeated
or null: rows are named by their id, or by a number made of id and text, and those that go are taken out with an anti join. Empty tables
pass through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from trackloom.llm.common import checkpoint, only_ids, read_table, shared_folder
from trackloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Row numbers made of id and text begin here, above ids, so that of documents alike one with an id of its own stays.
MADE = 1 << 62


def told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_id``: the id where no other row has it, else a number made of id and text, which only equal rows share."""
    again = checkpoint(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    made = F.lit(MADE) + F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(MADE >> 1))
    once = only_ids(docs, again, "left_anti").select(*COLUMNS, F.coalesce(F.col("doc_id").cast("bigint"), made).alias("row_id"))
    return once.unionByName(only_ids(docs, again).select(*COLUMNS, made.alias("row_id")))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose ``row_id`` is not in the column ``row_id`` of ``gone``."""
    return only_ids(rows, checkpoint(gone.select("row_id").distinct()), "left_anti", keys=["row_id"]).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are judged as texts without words. Rows without an id stay,
    as ``test_awkward_rows`` asks, whose other rows are all rejected; the other stages decide on them too."""
    rows = told_apart(docs)
    return without(rows, quality.quality(rows, read_table(spark, sf_dir, "labels"), carried=("row_id",)).filter("predicted = 0 and doc_id is not null"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays (null only if there is no other), of rows that repeat it with that text one."""
    found = checkpoint(exact_dedup.exact_duplicates(docs).select(F.struct("doc_id", "text_sha256").alias("row"), "kept"))
    key = F.sha2(F.to_json(F.struct("row"), {"ignoreNullFields": "false"}), 256).alias("key")  # a null id is a value like others
    rows = docs.withColumn("row", F.struct("doc_id", F.sha2(exact_dedup.normalised(F.coalesce("text", F.lit(""))), 256).alias("text_sha256"))).select(*COLUMNS, key)
    keyed = found.select(key, "kept")
    left = only_ids(rows, checkpoint(keyed.filter("not kept").select("key").distinct()), "left_anti", keys=["key"])
    again = checkpoint(keyed.filter("kept").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    once = only_ids(left, again, "left_anti", keys=["key"])
    return once.unionByName(only_ids(left, again, keys=["key"]).dropDuplicates(["key"])).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id: shingles of five words, Jaccard of 0.8 or more. Null,
    empty and blank texts have no shingles and all stay; of rows alike without an id of their own one stays; other columns pass."""
    rows = told_apart(docs)
    return without(rows, near_dedup.near_duplicates(rows, id_col="row_id").filter("not kept").withColumnRenamed("doc_id", "row_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay; texts are read whole; repeated rows
    share their fate, as they share the text; without items nothing goes."""
    rows = told_apart(docs)
    found = decontaminate.contamination(rows, read_table(spark, sf_dir, "benchmark"), id_col="row_id")
    return without(rows, found.filter(F.size("items") > 0).withColumnRenamed("doc_id", "row_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 1024 tokens. Null and empty texts are one piece of the end id;
    texts longer than a sequence are cut into full ones and a rest; repeated rows are packed each; ties go by id, start and checksum."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A classifier is trained on the way, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet into the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in a new folder of the shared one."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
