"""Language ID over averaged hashed subword embeddings, with calibrated rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm import subword

UNDETERMINED = "und"


def language_scores(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 600) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, score and rejected.

    Learned from at most ``per_class`` texts of each language (and subword.SAMPLE_BYTES in all), among rows for which
    ``allowed`` holds and the language is known; rows without an id teach nothing, an id teaches once. score is the calibrated probability of lang_pred, the likeliest language. Texts that are null or have no
    letter, and all texts where nothing could be learned, get ``und`` with score 0. rejected: ``und``, or a
    score below the level that loses one in 1,000 of the rightly predicted held-back texts, with a fifth to spare (at most 0.4),
    or runs of four characters less usual in every language than the level between held-back texts and what these would be were
    their language not learned. The last depends on no prior, so it also finds texts of languages not learned. A few
    letters say too little to be rejected. Only the text is an input. Texts of any length are read whole; equal texts have
    equal results; no rows give no rows. Columns with one of the new names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected", "__p", "__usual")
    model = subword.fit_frame(docs, allowed, lang_col, True, id_col, text_col, None, per_class)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "rejected": F.lit(True)})
    known = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    best = F.array_max("__p")
    name = F.get(F.array(*(F.lit(str(c)) for c in model.classes)), (F.array_position("__p", best) - 1).cast("int"))
    out = subword.probability_frame(docs, model, text_col)
    out = out.withColumns({"lang_pred": F.when(known, name).otherwise(F.lit(UNDETERMINED)), "score": F.when(known, best).otherwise(F.lit(0.0))})
    return out.withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < model.reject_below) | (F.col("__usual") < model.least_usual)).drop("__p", "__usual")
