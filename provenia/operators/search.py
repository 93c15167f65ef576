"""Ranked and pattern search over passages.

Ranking is BM25+ (Lv and Zhai, 2011): idf = ln(1 + (N - df + 0.5) / (df + 0.5)) and
score = idf (d + tf (k + 1) / (tf + k (1 - b + b |D| / avg))). Query words also match words within an edit distance of
round(0.2 |word|) characters and words that begin with them, weighted by ``fuzzy_weight`` and ``prefix_weight``.
Fields are scored each with its own document frequencies and mean length, and summed.

A search reads the passages themselves (``ranked_search``), or an inverted index (see ``index``).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.functions.text import tokens
from provenia.sources.tables import or_default


FIELDS = ("text", "title", "section_path")


@dataclass(frozen=True)
class Ranking:
    k: float = 1.2
    b: float = 0.7
    d: float = 0.5
    fuzzy: float = 0.2
    fuzzy_weight: float = 0.45
    prefix_weight: float = 0.375

    def idf(self, df: int, n: int) -> float:
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    def gain(self, tf: int, size: int, df: int, n: int, mean: float) -> float:
        """What a term adds to the score of a passage in plain numbers, as ``scored`` has it."""
        norm = 1 - self.b + self.b * size / mean if mean else 1.0
        return self.idf(df, n) * (self.d + tf * (self.k + 1) / (tf + self.k * norm))


def matching(term: F.Column, word: str, r: Ranking, fuzzy: bool, prefix: bool) -> F.Column:
    """Weight with which a term matches a query word; null if it does not."""
    weight = F.when(term == word, F.lit(1.0))
    if prefix:
        weight = weight.when(term.startswith(word), F.lit(r.prefix_weight))
    distance = round(r.fuzzy * len(word))
    if fuzzy and distance:
        near = (F.abs(F.length(term) - len(word)) <= distance) & (F.levenshtein(term, F.lit(word), distance) >= 0)
        weight = weight.when(near, F.lit(r.fuzzy_weight))
    return weight


def query_words(query: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def _matches(words: list[str], r: Ranking, fuzzy: bool, prefix: bool) -> F.Column:
    """array<struct<word, weight>> of the query's words that a term matches."""
    hits = ((word, matching(F.col("term"), word, r, fuzzy, prefix)) for word in words)
    return F.array_compact(F.array(*(F.when(w.isNotNull(), F.struct(F.lit(word).alias("word"), w.alias("weight"))) for word, w in hits)))


def _fields(nodes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(node_id, source_id, field, terms, size) of each field of each passage."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.coalesce(f, F.lit(""))).alias("terms")) for f in fields))).alias("f")
    return nodes.select("node_id", "source_id", each).select("node_id", "source_id", "f.field", "f.terms").withColumn("size", F.size("terms"))


def _figures(sized: DataFrame) -> DataFrame:
    """(field, n, mean): number of passages and mean length; one row a field."""
    return sized.groupBy("field").agg(F.count("*").alias("n"), F.avg("size").alias("mean"))


def scored(hits: DataFrame, r: Ranking) -> DataFrame:
    """(node_id, source_id, score) from the postings hit: node_id, source_id, size, tf, df, weight, n, mean."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(1 - r.b) + F.lit(r.b) * F.col("size") / F.col("mean")
    gain = idf * (F.lit(r.d) + F.col("tf") * F.lit(r.k + 1) / (F.col("tf") + F.lit(r.k) * norm))
    return hits.groupBy("node_id", "source_id").agg(F.round(F.sum(gain * F.col("weight")), 6).alias("score"))


def best(scores: DataFrame, limit: int | None) -> DataFrame:
    return scores if limit is None else scores.orderBy(F.desc("score"), "node_id").limit(limit)


def ranked_search(nodes: DataFrame, query: str, limit: int | None = 10, fuzzy: bool = True, prefix: bool = True, r: Ranking = Ranking(), fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(node_id, source_id, score) of the best passages, ties by node_id, read from the passages themselves.

    Words of the query are alternatives. Only terms that match a word are kept before the first shuffle, so what is
    grouped follows the hits and not the corpus.
    """
    words = query_words(query)
    if not words:
        return nodes.limit(0).select("node_id", "source_id", F.lit(0.0).alias("score"))
    sized = _fields(nodes, fields)
    found = F.filter("terms", lambda t: F.coalesce(*(matching(t, w, r, fuzzy, prefix) for w in words)).isNotNull())
    hits = sized.select("node_id", "source_id", "field", "size", F.explode(found).alias("term")).withColumn("m", _matches(words, r, fuzzy, prefix))
    hits = hits.groupBy("node_id", "source_id", "field", "size", "term", "m").agg(F.count("*").alias("tf"))
    # With tf the plan of the hits is the same on both sides of the join, so they are found and shuffled once.
    df = hits.groupBy("term", "field").agg(F.count_if(F.col("tf") > 0).alias("df"))
    weight = F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x["weight"]).alias("weight")
    known = hits.join(df, ["term", "field"]).join(F.broadcast(_figures(sized)), "field")  # one row a field
    return best(scored(known.select("node_id", "source_id", "size", "tf", "df", "n", "mean", weight), r), limit)


def with_titles(nodes: DataFrame, csl: DataFrame) -> DataFrame:
    """Passages with title, citation_key and merkle_root of their source; sources without a record go by their id."""
    root = F.col("merkle_root") if "merkle_root" in csl.columns else F.lit("").alias("merkle_root")
    record = csl.select(F.col("id").alias("source_id"), "id", "title", root)
    name = F.col("source_id")
    out = nodes.join(record, "source_id", "left").withColumn("title", or_default("title", name)).withColumn("citation_key", or_default("id", name)).drop("id")
    return out.withColumn("merkle_root", F.coalesce("merkle_root", F.lit("")))


def fetched(hits: DataFrame) -> DataFrame:
    """The rows of a search with a limit as a table on the driver, so that what follows does not search again."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def sources_of(hits: DataFrame) -> list[str]:
    """The sources of fetched hits: at most as many as hits were asked for."""
    return sorted({r.source_id for r in hits.select("source_id").distinct().collect()})


def of_sources(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Passages of the sources of fetched hits, where source_id is a column of the scanned files."""
    return nodes.where(F.col("source_id").isin(sources_of(hits)))


def cited(hits: DataFrame, nodes: DataFrame, csl: DataFrame) -> DataFrame:
    """Hits with passage and citation fields; sources without a record go by their id."""
    return with_titles(hits.join(nodes.select("node_id", "sha256", "section_path", "paragraph"), "node_id"), csl)


def is_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the pattern compiles."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(f"(?i){pattern}")
    except Exception:
        return False
    return True


def matched(rows: DataFrame, pattern: str, context: int = 120) -> DataFrame:
    """Passages that hold a match, ignoring case, with match (the first) and context, up to ``context`` characters around it."""
    rows = rows.where(F.col("text").rlike(f"(?i){pattern}"))
    rows = rows.withColumn("match", F.regexp_extract("text", f"(?i){pattern}", 0)).withColumn("at", F.regexp_instr("text", F.lit(f"(?i){pattern}")) - 1)
    half = context // 2
    begin, end = F.greatest(F.col("at") - half, F.lit(0)), F.least(F.col("at") + F.length("match") + half, F.length("text"))
    return rows.withColumn("context", F.substring("text", begin + F.lit(1), end - begin))


def ordered(found: DataFrame, limit: int | None) -> DataFrame:
    """(node_id, source_id, match, context) of the first matches in order of passages: sources by number, then by name."""
    out = found.select("node_id", "source_id", "match", "context", F.col("source_id").try_cast("long").alias("s"), "paragraph").orderBy("s", "source_id", "paragraph")
    return (out if limit is None else out.limit(limit)).drop("s", "paragraph")


def regex_search(nodes: DataFrame, pattern: str, source_id: str | None = None, limit: int = 10, context: int = 120) -> DataFrame:
    """(node_id, source_id, match, context): the first match of each passage, ignoring case, in order of passages.

    An invalid pattern gives no rows. Reads all passages; see ``patterns`` for an index.
    """
    if not is_pattern(nodes.sparkSession, pattern):
        return ordered(matched(nodes.limit(0), "", context), limit)
    rows = nodes if source_id is None else nodes.where(F.col("source_id") == source_id)
    return ordered(matched(rows, pattern, context), limit)


def in_scope(rows: DataFrame, approved: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows of approved sources."""
    return rows.join(approved.select(F.col("source_id").alias(key)), key, "left_semi")


def guarded(calls: DataFrame, approved: DataFrame) -> DataFrame:
    """calls (with source_id) with decision: ok for approved sources, else SOURCE_NOT_APPROVED."""
    known = approved.select("source_id").distinct().withColumn("known", F.lit(True))
    return calls.join(known, "source_id", "left").withColumn("decision", F.when(F.col("known"), "ok").otherwise("SOURCE_NOT_APPROVED")).drop("known")
