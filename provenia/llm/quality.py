"""Quality classifier over averaged hashed subword embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm import subword


def quality_scores(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = subword.PER_CLASS) -> DataFrame:
    """All rows and columns of ``docs`` with score, the calibrated probability of label 1.

    Learned from at most ``per_class`` texts of each label (and subword.SAMPLE_BYTES in all), among rows of ``labels``
    for which ``allowed`` holds; rows with a null label or id teach nothing, an id teaches once. Null and empty texts, and texts without words, get the score of no evidence. Only
    the text is an input. Without any label every score is 0.5; with one label only, 0 or 1 throughout. Equal texts
    have equal scores. A column named score is replaced.
    """
    docs = docs.drop("score", "__p", "__usual")
    model = subword.fit_frame(docs, allowed, label_col, False, id_col, text_col, labels, per_class)
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    if 1 not in model.classes or len(model.classes) == 1:
        return docs.withColumn("score", F.lit(1.0 if 1 in model.classes else 0.0))
    model.usual = None  # every text is scored
    one = model.classes.index(1)
    return subword.probability_frame(docs, model, text_col).withColumn("score", F.get("__p", F.lit(one))).drop("__p", "__usual")
