"""A training-data pipeline over documents: language ID, exact dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the
last returns the pieces of packed sequences. Stages read doc_id, text and lang; other columns, whatever their names,
are carried along. No rows give no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenia.llm.exact_dedup import exact_dedup
from provenia.llm.language_id import language_scores
from provenia.llm.packing import pack
from provenia.llm.queries import vocabulary
from provenia.llm.shared import Workspace
from provenia.llm.simhash import simhash_components
from provenia.llm.substring_dedup import substring_dedup

_READ = ("doc_id", "text", "lang")


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that stages read, and all others in one, so that none clashes with a stage's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in _READ]
    return docs.select(*(c for c in docs.columns if c in _READ), *([F.struct(*others).alias("__others")] if others else []))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*(F.col(c) if c in _READ else F.col("__others").getField(c).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with confidence; the model learns from four fifths of the labelled ones.

    Null and empty texts, and texts without a letter, are of no language and go. Rows that repeat or tie share their
    fate, with or without an id. A null language teaches nothing and is kept as it is. Where nothing can be learned,
    nothing stays.
    """
    scored = language_scores(_packed(docs), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return _unpacked(scored.where("not rejected"), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of equal texts; null texts equal empty ones.

    Null ids come last. Rows that share the least id of a group, or of a group without any id, all stay; the next
    stage leaves one of them.
    """
    return _unpacked(exact_dedup(_packed(docs)).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of least id, null ids last, then that of least text hash.

    Null and empty texts are copies of each other. Of rows with the same id and text one stays.
    """
    tagged = _packed(docs).withColumn("__tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = simhash_components(tagged, carry="__tag")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("__tag").alias("tag"))).alias("first")
    stay = found.groupBy("component").agg(first).select("first.id", "first.tag")
    kept = tagged.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("__tag") == F.col("tag")), "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id", "__tag").orderBy("__tag"))
    return _unpacked(kept.withColumn("__n", once).where("__n = 1"), docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of long passages that an earlier document holds; others stay as they are.

    Rows that share an id, and rows without one, never cut each other; null texts stay null. n_chars, where there is
    such a column, is that of the text that is left.
    """
    cut = substring_dedup(_packed(docs))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = _unpacked(cut.withColumn("text", text), docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a null or empty text is its end id alone, rows that repeat are packed each."""
    pieces = pack(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: A trained model and a tokenizer take part, so no SQL gives these rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread; a stage's input is dropped with its output written."""
    work = Workspace(spark, "pipeline")
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, _ = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if done is not None:
            work.drop(done)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
