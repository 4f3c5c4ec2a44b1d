"""The thin queries over the synthetic tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontaminate, exact_dedup, license_scan, near_dedup, oracles, packing, quality, secret_scan, suffix_dedup, token_count, toxicity
from trackloom.llm.common import read_table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(documents(spark, sf_dir))
    spelled = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter(spelled, lambda x: F.split(x, ":")[0].isin(*secret_scan.KINDS[:3]))
    return found.select("doc_id", *(count(k) for k in secret_scan.KINDS[:3]), F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", spelled).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_substrings(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("bigint").alias("n_spans"), "kept_sha256")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), words=2)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(documents(spark, sf_dir)).drop("blocks")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.transform("hit_words", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x).cast("bigint")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_token_count": op10_token_count,
}

#: The others can't be expressed: they train models, need a tokenizer, or match leftmost without overlaps.
ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": oracles.EXACT,
    "op4_suffix_dedup": oracles.SUBSTRINGS,
    "op5_near_dedup": oracles.NEAR,
    "op6_license_scan": oracles.licenses(),
    "op8_decontamination": oracles.CONTAMINATION,
}
