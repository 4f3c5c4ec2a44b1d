"""Quality scores by non-negative positive-unlabelled learning from trusted positives, unlabelled web text and a class prior."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trackloom.llm.pu_learning import Settings, scored

#: Form and words; the same bounds as for toxicity.
SETTINGS = Settings()


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, settings: Settings = SETTINGS, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1: good text).

    ``labels`` has doc_id and ``quality``; rows whose crc32 of the id modulo 5 is 0 are held out, and of the others only labels of 1 are
    read. Null and empty texts get the score of a text without words; texts of any length are scored whole, but fitted only up to
    ``settings.sample_bytes``; a null id is not held out; repeated rows are scored each, and ids of one hash are drawn in order of the
    id; without positive labels every score is 0.5, which keeps all; an empty table gives an empty result. Other columns are ignored, but for those named in ``carried``, which are put behind.
    """
    return scored(docs, labels, "quality", 5, 0, threshold, settings, id_col, text_col, carried)
