"""How the words of each source differ from those of the other sources of its language: exact, in plain relations.

Regexp matches are counted by group (language, source) and term; the groups are crossed with the kept vocabulary of their
language, so that words which a source lacks have rows too; a self-join on language and term, both by number, sets each
source against each other, and windows rank what comes out. All arithmetic is on integers: a share is a count of
billionths, found by long division, so no product leaves 64 bits. Matches are exploded and first counted in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm import spans
from provenia.llm.shared import Workspace

#: Bytes between terms: all of ASCII but letters. Terms are the matches of [^\x00-\x40\x5B-\x60\x7B-\x7F]+, A-Z lower-cased.
BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])

#: So many copies of the groups meet the vocabulary, each a share of it: a language may hold a third of all words.
SHARES = 64
_PART = 1 << 24
_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(data: np.ndarray, offsets: np.ndarray, lang: pa.Array, source: pa.Array) -> pa.RecordBatch:
    """_COUNTS of the texts of a part: each match with its text, counted by text and term, then by group and term."""
    inside = ~BETWEEN[data]
    starts, ends, first = spans.word_spans(np.where(inside, data, 32), offsets)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    low = spans.LOWER[data[inside]]  # the terms on end
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low)).dictionary_encode()
    size = max(len(terms.dictionary), 1)
    seen: dict[tuple, int] = {}
    group = np.array([seen.setdefault(g, len(seen)) for g in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64)
    text = np.repeat(np.arange(len(group), dtype=np.int64), np.diff(first))
    pair, n = np.unique(text * size + terms.indices.to_numpy(), return_counts=True)
    key, at = np.unique(group[pair // size] * size + pair % size, return_inverse=True)
    of = pa.array(key // size)
    langs, sources = (pa.array([g[k] for g in seen], pa.string()).take(of) for k in (0, 1))
    total, docs = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
    return pa.RecordBatch.from_arrays([langs, sources, terms.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(total), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def _matches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, offsets = spans.text_column(batch.column("text"))
        for i, j in spans.runs(offsets, _PART):
            yield _counted(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], *(batch.column(c).slice(i, j - i) for c in ("lang", "source")))
        del batch, data, offsets
    spans.released()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; counted within parts and tasks first."""
    return docs.mapInArrow(_matches, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), three digits a step: the quotient is at most 10^9."""
    rest, out = f"({count} + 1)", "1L"
    for weight in (1_000_000, 1_000, 1):
        out += f" + {weight}L * ({rest} * 1000L div ({total} + {terms}))"
        rest = f"({rest} * 1000L % ({total} + {terms}))"
    return F.expr(out)


def _excess(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _crossed(left: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """left joined with all groups of its language; each share of left, by a hash of ``key``, meets its own copy of the groups."""
    dealt = left.withColumn("__share", F.pmod(F.xxhash64(key), F.lit(SHARES)))
    copies = groups.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return dealt.join(copies, ["lang", "__share"]).drop("__share")


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from its other sources and from the whole.

    Each language keeps the terms in at least ``min_docs`` of its documents. Part ``pair``: item is another source of the
    language, value the sum of (p - q)^2 / q, rounded down, over all kept terms, p the source's share of a term and q the
    other's; all ranks, 0 where the language keeps no term. Part ``term``: item is a kept term that the source holds with a
    greater share than the language; the ``top`` ranks. Ranks run from 1 by falling value, then by rising item.

    Every row counts as a document, repeated rows and rows without an id too; null texts, languages and sources count as
    empty strings. Whole texts are read, whatever their length. No rows give no rows; a source alone in its language has
    no pairs. Columns beside lang, source and text, whatever their names, take no part.

    Counts are written to the shared folder once. The self-join is partitioned by language and term, so a language that
    holds most words is dealt out by its terms; its cost is the kept terms times the square of their language's sources.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "divergence")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    # Numbers are given behind the shuffle: all rows of a term are in one task, and a task that runs again writes all of them.
    of = Window.partitionBy("lang", "term")
    found = term_counts(docs).repartition("lang", "term").withColumn("row", F.monotonically_increasing_id())
    found = found.withColumns({"of_lang": F.sum("n").over(of), "docs": F.sum("docs").over(of), "number": F.min("row").over(of)}).where(F.col("docs") >= min_docs)
    found, _ = work.save(found.withColumn("head", F.col("row") == F.col("number")).drop("row", "docs"), "found")
    langs = found.where("head").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0)
    absent = F.when(F.col("terms") > 0, share("0L", "total", "terms"))
    groups, _ = work.save(groups.withColumn("group", F.monotonically_increasing_id()).withColumn("absent", absent), "groups")

    own = found.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "total", "terms").alias("p"), share("of_lang", "lang_total", "terms").alias("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _excess("p", "q").alias("value"))
    term = term.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    zeros = _crossed(found.where("head").select("lang", "number"), groups.select("lang", "group", F.col("absent").alias("p")), "number").select("number", "group", "p")
    held = found.join(groups, ["lang", "source"]).select("number", "group", share("n", "total", "terms").alias("p"))
    p = zeros.unionByName(held).repartition(parts, "number").groupBy("number", "group").agg(F.max("p").alias("p"))  # no share is below that of a term which is absent
    q = p.select("number", F.col("group").alias("other"), F.col("p").alias("q"))
    summed = p.join(q, "number").where("group <> other").groupBy("group", "other").agg(F.sum(_excess("p", "q")).alias("value"))
    bare = groups.where("terms = 0").select("lang", "group")
    none = _crossed(bare, bare.withColumnRenamed("group", "other"), "group").where("group <> other").select("group", "other", F.lit(0).cast("long").alias("value"))
    pair = summed.unionByName(none).join(groups.select("group", "lang", "source"), "group").join(groups.select(F.col("group").alias("other"), F.col("source").alias("item")), "other")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pair.unionByName(term)
