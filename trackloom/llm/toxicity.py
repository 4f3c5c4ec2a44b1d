"""Toxicity scores by non-negative positive-unlabelled learning from confirmed toxic examples and unlabelled text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trackloom.llm.pu_learning import Settings, scored

SETTINGS = Settings()


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, settings: Settings = SETTINGS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``labels`` has doc_id and ``toxic``; rows whose crc32 of the id modulo 3 is 1 are held out, and of the others only labels of 1 are read. Null
    and empty texts get the score of a text without words; texts of any length are scored whole, but fitted only up to
    ``settings.sample_bytes``; a null id is not held out; repeated rows are scored each, and ids of one hash are drawn in order of the
    id; without toxic labels every score is 0.5; an empty table gives an empty result. Other columns are ignored.
    """
    return scored(docs, labels, "toxic", 3, 1, threshold, settings, id_col, text_col)
