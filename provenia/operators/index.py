"""An inverted index in immutable segments, for ranked search that reads only what can reach the best.

A segment holds four tables. The first is written once, from the texts of the passages that came together; each of the others
follows from those before it and is written by the first search that needs it, so segments that are merged before have none:

- ``forward``: the different terms of each passage and field, a row each, by source;
- ``blocks``: postings in blocks of one term and field, by falling impact level, each with its greatest frequency and least size;
  a task sorts a bounded number of postings at a time, so a term lies in as many places as there are such runs at most;
- ``strata``: the same figures summed by term, field and level, which is the vocabulary, too;
- ``variants``: each term under hashes of its forms with one character left out, for longer terms also with two.

Passages that go are noted in a deletion (pairs of segment and source, and how often their terms occurred), found in
``forward``; counts of passages are those of all segments less those of all deletions, so scores equal those of a
fresh index. Segments of like size are merged from their ``forward`` tables. No text is read a second time.

A search takes the strata of its terms, bounds from above what a posting of each can add (by greatest frequency and least
size for any weights of the ranking and any mean; by greatest impact, more closely, for the usual weights, however the
mean has moved since), and from below the score of the best ``limit`` passages. Strata whose
bound and those of all other terms together stay under that threshold are never read: a passage among the best has no
posting there, so its score is still whole. With several terms the threshold is raised by reading the best strata first.

Words match terms by equality of hashes of shortened forms (two words within d changes have a form in common that
leaves out d characters at most of each), and by ranges of the sorted vocabulary where they begin alike.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.functions.text import tokens
from provenia.operators.search import FIELDS, Ranking, best, matching, query_words, scored

#: Postings of a block; levels of impact, from 0 to LEVELS - 1.
BLOCK, LEVELS = 128, 128
#: So many matching terms are planned for and pushed into the scans; more are joined.
PUSHED = 1000
#: So many pairs of term and field are pushed with a level of their own.
PUSHED_LEVELS = 64
#: Terms of this length and more have forms with two characters left out.
TWO_OUT = 6
_SLACK = 1e-5  # scores are rounded to 6 decimals


_BOUNDS = ("max_tf", "min_tf", "min_size", "max_size", "max_impact", "min_impact")


def _summed() -> list[Column]:
    """n and the bounds of a group of blocks or strata."""
    return [F.sum("n").alias("n"), *((F.max if c.startswith("max") else F.min)(c).alias(c) for c in _BOUNDS)]


def moved_impact(x: float, mean: float, now: float) -> tuple[float, float]:
    """(least, greatest) of tf / (tf + k norm) with another mean size, where it was x with the old one.

    norm = 1 - b + b size / mean moves by a factor between 1 and mean / now.
    """
    ends = [x / (x + (1 - x) * c) if x else 0.0 for c in (1.0, mean / now)]
    return min(ends), max(ends)


#: So many postings are grouped at once by a task, and so many terms shortened.
GROUPED, TERMS = 1 << 20, 50_000

_FORWARD_SCHEMA = "node_id string, source_id string, field string, size int, passages long, terms array<string>, tfs array<long>"


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        same = [pc.fill_null(pc.equal(c.slice(1), c.slice(0, n - 1)), False).to_numpy(zero_copy_only=False) for c in columns]
        new[1:] = ~reduce(np.logical_and, same)
    return new


def _counted(rows: pa.Table, fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of _FORWARD_SCHEMA of passages with the words of each field; those of equal ids and size count together, as in a scan."""
    ids = [rows.column(c).combine_chunks() for c in ("node_id", "source_id")]
    run = np.cumsum(_starts(ids)) - 1
    for k, field in enumerate(fields):
        words = rows.column(f"w{k}").combine_chunks()
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = words.flatten().dictionary_encode()
        _, first, group, copies = np.unique(run * (size.max() + 1) + size, return_index=True, return_inverse=True, return_counts=True)
        most = max(len(codes.dictionary), 1)
        pair, tf = np.unique(np.repeat(group, size) * most + codes.indices.to_numpy(), return_counts=True)
        at = pa.array(np.searchsorted(pair // most, np.arange(len(first) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, x) for x in (codes.dictionary.take(pa.array(pair % most)), pa.array(tf.astype(np.int64)))]
        own = [c.take(pa.array(first)) for c in ids]
        yield pa.RecordBatch.from_arrays([*own, pa.array([field] * len(first)), pa.array(size[first].astype(np.int32)), pa.array(copies.astype(np.int64)), *lists], [c.split(" ")[0] for c in _FORWARD_SCHEMA.split(", ")])


def _forward(nodes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(node_id, source_id, field, size, passages, terms, tfs): one row a passage and field, with its different terms.

    Texts are dealt out by passage and counted in Arrow batches, so that a task holds texts and never rows of terms.
    """
    words = [tokens(F.coalesce(f, F.lit(""))).alias(f"w{k}") for k, f in enumerate(fields)]
    cut = nodes.select("node_id", "source_id", *fields).repartition("node_id").sortWithinPartitions("source_id", "node_id").select("node_id", "source_id", *words)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the last passage, which may go on
        for batch in it:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*rest, batch]).combine_chunks()
            last = int(np.flatnonzero(_starts([rows.column(c).combine_chunks() for c in ("node_id", "source_id")]))[-1])
            if last:
                yield from _counted(rows.slice(0, last), fields)
            rest = rows.slice(last).to_batches()
        if rest:
            yield from _counted(pa.Table.from_batches(rest), fields)

    return cut.mapInArrow(count, _FORWARD_SCHEMA)


def _dealt(forward: DataFrame, *more: str) -> DataFrame:
    """(term, tf) of rows of ``forward`` beside other columns; the empty term stands for the passages themselves."""
    pairs = F.arrays_zip(F.concat("terms", F.array(F.lit(""))).alias("term"), F.concat("tfs", F.array("passages")).alias("tf"))
    return forward.select(*more, F.explode(pairs).alias("x")).select(*more, F.col("x.term").alias("term"), F.col("x.tf").alias("tf"))


def _impacts(tf: np.ndarray, size: np.ndarray, mean: np.ndarray, r: Ranking) -> np.ndarray:
    return tf / (tf + r.k * ((1 - r.b) + r.b * size / mean))


_BLOCK_SCHEMA = "term string, field string, level int, n long, max_tf long, min_tf long, min_size int, max_size int, max_impact double, min_impact double, postings array<struct<node_id:string,source_id:string,size:int,tf:long>>"


def _grouped(rows: pa.Table, means: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """Postings of forward rows, sorted, as blocks of at most BLOCK of one term, field and level."""
    rows = rows.combine_chunks()
    ids = [rows.column(c).combine_chunks() for c in ("node_id", "source_id")]
    field, words = rows.column("field").combine_chunks().dictionary_encode(), rows.column("terms").combine_chunks()
    row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    n = len(row)
    if not n:
        return
    codes, tf = words.flatten().dictionary_encode(), rows.column("tfs").combine_chunks().flatten().to_numpy()
    rank = np.empty(len(codes.dictionary), np.int64)
    rank[pc.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(rank))
    size, kind = rows.column("size").to_numpy()[row], field.indices.to_numpy()[row].astype(np.int64)
    mean = np.array([means[f] for f in field.dictionary.to_pylist()])[kind]
    impact = tf / (tf + Ranking().k * ((1 - Ranking().b) + Ranking().b * size / mean))
    level = np.minimum(np.floor(impact * LEVELS), LEVELS - 1).astype(np.int64)
    key = (rank[codes.indices.to_numpy()] * len(field.dictionary) + kind) * LEVELS + (LEVELS - 1 - level)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    at = np.flatnonzero((np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))) % BLOCK == 0)
    for lo in range(0, len(at), 1 << 13):
        some = at[lo : lo + (1 << 13) + 1]
        end = some[-1] if len(some) > 1 << 13 else n
        some = some[: 1 << 13]
        own, bounds = order[some[0] : end], np.append(some, end) - some[0]
        first, of = pa.array(order[some]), pa.array(row[own])
        figures = ((tf[own], np.maximum), (tf[own], np.minimum), (size[own], np.minimum), (size[own], np.maximum), (impact[own], np.maximum), (impact[own], np.minimum))
        posting = pa.StructArray.from_arrays([*(c.take(of) for c in ids), pa.array(size[own]), pa.array(tf[own])], ["node_id", "source_id", "size", "tf"])
        yield pa.RecordBatch.from_arrays(
            [codes.dictionary.take(codes.indices.take(first)), field.dictionary.take(pa.array(kind[order[some]])), pa.array(level[order[some]].astype(np.int32)), pa.array(np.diff(bounds)), *(pa.array(f.reduceat(x, bounds[:-1])) for x, f in figures), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), posting)],
            ["term", "field", "level", "n", *_BOUNDS, "postings"],
        )


def _blocks(means: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Forward rows as sorted runs of blocks, of some GROUPED postings each: no posting is shuffled."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in it:
            held.append(batch)
            n += len(batch.column("terms").flatten())
            if n >= GROUPED:
                yield from _grouped(pa.Table.from_batches(held), means)
                held, n = [], 0
        if held:
            yield from _grouped(pa.Table.from_batches(held), means)

    return cut


def shortened_forms(word: str, most: int) -> set[str]:
    """The word with up to ``most`` characters left out."""
    out = last = {word}
    for _ in range(most):
        last = {f[:k] + f[k + 1 :] for f in last for k in range(len(f))}
        out = out | last
    return out


def _forms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lo in range(0, batch.num_rows, 1024):
            terms = batch.column("term").slice(lo, 1024)
            forms = [list(shortened_forms(t, 2 if len(t) >= TWO_OUT else 1)) for t in terms.to_pylist()]
            of = np.repeat(np.arange(len(forms)), [len(f) for f in forms])
            yield pa.RecordBatch.from_arrays([pa.array([f for some in forms for f in some], pa.string()), terms.take(pa.array(of))], ["form", "term"])


def variants(terms: DataFrame) -> DataFrame:
    """(form, term): hashes of the term itself, of its forms with one character left out and, from TWO_OUT characters on, with two."""
    return terms.mapInArrow(_forms, "form string, term string").select(F.xxhash64("form").alias("form"), "term")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


@dataclass(frozen=True)
class Segment:
    """name of its folder, number of postings, and (passages, sum of sizes) by field."""

    name: str
    postings: int
    figures: dict[str, tuple[int, int]]


@dataclass(frozen=True)
class Deletion:
    """name of its folder, and by segment and field (passages, sum of sizes) that went."""

    name: str
    figures: dict[tuple[str, str], tuple[int, int]]


@dataclass(frozen=True)
class Plan:
    """What a search reads: its terms' weights, and for each term and field the least level; postings read, and all there are."""

    weights: dict[str, float]
    pairs: dict[tuple[str, str], tuple[int, int]]  # df, least level
    read: int
    all: int


@dataclass(frozen=True)
class SearchIndex:
    """Segments and deletions under a folder; ``add``, ``delete`` and ``merged`` give the index that comes after."""

    spark: SparkSession
    path: str
    fields: tuple[str, ...] = FIELDS
    segments: tuple[Segment, ...] = ()
    deletions: tuple[Deletion, ...] = ()

    # ------------------------------------------------------------ parts
    def part(self, name: str, of: tuple[Segment, ...] | None = None) -> DataFrame | None:
        """A table of all segments, or of some, with the segment of each row; None without segments."""
        some = self.segments if of is None else of
        for s in some if name != "forward" else ():
            self._made(s, name)
        folders = [f"{self.path}/{s.name}/{name}" for s in some]
        return self.spark.read.parquet(*folders).withColumn("segment", F.regexp_extract("_metadata.file_path", r"/(seg-[0-9a-f]+)/", 1)) if folders else None

    def _gone(self, name: str) -> DataFrame | None:
        """A table of all deletions, where their segments are still there."""
        folders = [f"{self.path}/{d.name}/{name}" for d in self.deletions]
        return self.spark.read.parquet(*folders).where(F.col("segment").isin([s.name for s in self.segments])) if folders else None

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows with segment and source_id, but for those that were deleted."""
        gone = self._gone("sources")
        return rows if gone is None else rows.join(gone, ["segment", "source_id"], "left_anti")

    def figures(self) -> dict[str, tuple[int, int]]:
        """(passages, sum of sizes) of each field."""
        out = dict.fromkeys(self.fields, (0, 0))
        names = {s.name for s in self.segments}
        found = [(f, x, 1) for s in self.segments for f, x in s.figures.items()] + [(f, x, -1) for d in self.deletions for (s, f), x in d.figures.items() if s in names]
        for f, (n, total), sign in found:
            out[f] = (out[f][0] + sign * n, out[f][1] + sign * total)
        return out

    def terms(self) -> DataFrame:
        """(field, term, passages, occurrences) of all terms, as the index stands."""
        blocks = self.part("blocks").select("segment", "term", "field", "postings")
        if self.deletions:
            rows = self._alive(blocks.select("segment", "term", "field", F.explode("postings").alias("p")).select("segment", "term", "field", "p.source_id", "p.tf"))
            return rows.groupBy("field", "term").agg(F.count("*").alias("passages"), F.sum("tf").alias("occurrences"))
        tf = F.col("postings.tf")
        rows = blocks.select("field", "term", F.size(tf).cast("long").alias("n"), F.aggregate(tf, F.lit(0).cast("long"), lambda a, x: a + x).alias("tf"))
        return rows.groupBy("field", "term").agg(F.sum("n").alias("passages"), F.sum("tf").alias("occurrences"))

    # ------------------------------------------------------------ upkeep
    def _written(self, forward: DataFrame) -> SearchIndex:
        """The index with one more segment, of rows as in _forward."""
        name = f"seg-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        forward.write.parquet(f"{at}/forward")
        forward = self.spark.read.parquet(f"{at}/forward")
        found = forward.groupBy("field").agg(F.sum("passages").alias("n"), F.sum(F.col("passages") * F.col("size")).alias("total")).collect()
        figures = {r["field"]: (r.n, r.total) for r in found}
        postings = forward.agg(F.sum(F.size("terms"))).first()[0] or 0
        return replace(self, segments=(*self.segments, Segment(name, postings, figures)))

    def _made(self, s: Segment, name: str) -> None:
        """Write a table of a segment that follows from others of it, if it is not there."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at, new = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{s.name}/{x}") for x in (name, f"new-{uuid.uuid4().hex}"))
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            return
        if name == "blocks":
            means = {f: max(total / n, 1.0) for f, (n, total) in s.figures.items() if n}
            rows = self.part("forward", (s,)).select("node_id", "source_id", "field", "size", "terms", "tfs").mapInArrow(_blocks(means), _BLOCK_SCHEMA)
        elif name == "strata":
            blocks = self.part("blocks", (s,)).select("term", "field", "level", "n", *_BOUNDS)
            rows = blocks.repartitionByRange("term").groupBy("term", "field", "level").agg(*_summed()).sortWithinPartitions("term", "field")
        else:
            terms = self.part("strata", (s,)).select("term")
            # Small as terms are, their forms are many: a task takes a bounded number of terms.
            parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), terms.agg(F.approx_count_distinct("term")).first()[0] // TERMS + 1)
            rows = variants(terms.repartition(parts, "term").distinct()).sortWithinPartitions("form")
        # Small row groups: a search reads those of its terms and levels alone.
        rows.write.option("parquet.block.size", 1 << 20).parquet(new.toString())
        if fs.exists(at) or not fs.rename(new, at):  # another process was first
            fs.delete(new, True)

    def add(self, nodes: DataFrame) -> SearchIndex:
        """The index with more passages, which must have the columns of its fields; reads these alone."""
        return self._written(_forward(nodes, self.fields))

    def delete(self, sources: list[str] | DataFrame) -> SearchIndex:
        """The index without the passages of some sources, given by id or as a relation with source_id; reads their rows of ``forward`` alone."""
        if not self.segments:
            return self
        forward = self.part("forward")
        if isinstance(sources, list):
            forward = forward.where(F.col("source_id").isin(sources))
        else:
            forward = forward.join(sources.select("source_id"), "source_id", "left_semi")
        name, forward = f"del-{uuid.uuid4().hex}", self._alive(forward)
        at = f"{self.path}/{name}"
        forward.select("segment", "source_id").distinct().write.parquet(f"{at}/sources")
        counts = _dealt(forward, "segment", "field", "size").groupBy("segment", "term", "field").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"), F.sum(F.col("tf") * F.col("size")).alias("total"))
        counts.write.parquet(f"{at}/terms")
        found = self.spark.read.parquet(f"{at}/terms").where("term = ''").collect()  # one row a segment and field
        return replace(self, deletions=(*self.deletions, Deletion(name, {(r.segment, r["field"]): (r.tf, r.total) for r in found})))

    def merged(self, fanout: int = 4) -> SearchIndex:
        """The index with segments of like size merged, ``fanout`` or more of them at a time, until no size has so many.

        Sizes go by powers of ``fanout``, so a posting is written again as often as the index grew by that factor; merges that
        would lead to another are taken together, so a call writes it once. Deletions may leave a size that merges again.
        """
        tier = lambda group: int(math.log(max(sum(s.postings for s in group), 1), fanout))
        groups: list[tuple[Segment, ...]] = [(s,) for s in self.segments]
        while some := next((own for t in sorted({tier(g) for g in groups}) if len(own := [g for g in groups if tier(g) == t]) >= fanout), None):
            groups = [g for g in groups if g not in some] + [tuple(s for g in some for s in g)]
        out = self
        for group in groups:
            out = out._merge(group) if len(group) > 1 else out
        return self if out is self else out.merged(fanout)

    def _merge(self, some: tuple[Segment, ...]) -> SearchIndex:
        forward = self._alive(self.part("forward", some)).drop("segment")
        return replace(self, segments=tuple(s for s in self.segments if s not in some))._written(forward)

    def drop_unused(self) -> None:
        """Delete the folders of segments and deletions that this index does not hold; no search of an older one may be open."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs, held = root.getFileSystem(conf), {x.name for x in (*self.segments, *self.deletions)}
        with suppress(Exception):
            for x in fs.listStatus(root):
                if x.getPath().getName() not in held:
                    fs.delete(x.getPath(), True)

    # ------------------------------------------------------------ search
    def _candidates(self, words: list[str], r: Ranking, fuzzy: bool, prefix: bool) -> DataFrame:
        """(term) that may match one of the words: those that are equal, begin with it or share a shortened form; without a scan.

        Words for which more than two changes are allowed, or two within a short word, run over the vocabulary.
        """
        strata = self.part("strata").select("term", "n")
        ranges = [F.col("term") == w for w in words] + [F.col("term").startswith(w) for w in words if prefix]
        lookup, scans = [], []
        for w in words if fuzzy else []:
            most = round(r.fuzzy * len(w))
            if most > 2 or (most == 2 and len(w) - 2 < TWO_OUT):
                scans.append(F.levenshtein("term", F.lit(w), most) >= 0)
            elif most:
                lookup += [F.col("form") == F.xxhash64(F.lit(f)) for f in sorted(shortened_forms(w, most))]
        out = strata.where(_any(ranges + scans)).select("term")
        return out.unionByName(self.part("variants").where(_any(lookup)).select("term")).distinct() if lookup else out.distinct()

    def _known(self, words: list[str], r: Ranking, fuzzy: bool, prefix: bool) -> DataFrame:
        """(term, weight) of the terms that match."""
        m = _matched(words, r, fuzzy, prefix)
        return self._candidates(words, r, fuzzy, prefix).withColumn("m", m).where(F.size("m") > 0).select("term", F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x).alias("weight"))

    def _counts(self, fields: tuple[str, ...]) -> DataFrame:
        """Strata and deletions, the latter without a level and with n below 0."""
        columns = ("segment", "term", "field", "level", "n", *_BOUNDS)
        rows, gone = self.part("strata").select(*columns), self._gone("terms")
        if gone is not None:
            rows = rows.unionByName(gone.where("term <> ''").select("segment", "term", "field", (-F.col("n")).alias("n")), allowMissingColumns=True)
        return rows.where(F.col("field").isin(*fields))

    def plan(self, query: str, limit: int | None = 10, fuzzy: bool = True, prefix: bool = True, r: Ranking = Ranking(), fields: tuple[str, ...] | None = None) -> Plan | None:
        """What a search will read; None where too many terms match to plan for."""
        words, fields = query_words(query), fields or self.fields
        if not words or not self.segments:
            return Plan({}, {}, 0, 0)
        if fuzzy or prefix:
            weights = {x.term: x.weight for x in self._known(words, r, fuzzy, prefix).limit(PUSHED + 1).collect()}
            if len(weights) > PUSHED:
                return None
        else:
            weights = dict.fromkeys(words, 1.0)
        # At most LEVELS + 1 rows for each of PUSHED terms, field and segment.
        rows = self._counts(fields).where(F.col("term").isin(list(weights))).groupBy("segment", "term", "field", "level").agg(*_summed()).collect()
        return self._planned(rows, weights, limit, r, fields)

    def _planned(self, rows: list, weights: dict[str, float], limit: int | None, r: Ranking, fields: tuple[str, ...]) -> Plan:
        figures = self.figures()
        strata: dict[tuple[str, str], list] = {}
        gone: dict[tuple[str, str], int] = {}
        for x in rows:
            key = (x.term, x["field"])
            gone[key] = gone.get(key, 0) - (x.n if x.level is None else 0)
            if x.level is not None:
                strata.setdefault(key, []).append(x)
        df = {key: sum(x.n for x in own) - gone[key] for key, own in strata.items()}
        strata = {key: own for key, own in strata.items() if df[key] > 0}

        means = {(s.name, f): max(total / n, 1.0) for s in self.segments for f, (n, total) in s.figures.items() if n}
        usual = (r.k, r.b) == (Ranking().k, Ranking().b)

        def bounds(key: tuple[str, str], x: object) -> tuple[float, float]:
            """(least, greatest) that a posting of a stratum adds."""
            n, total = figures[key[1]]
            low, high = (weights[key[0]] * r.gain(tf, size, df[key], n, total / n) for tf, size in ((x.min_tf, x.max_size), (x.max_tf, x.min_size)))
            if usual and total:
                was, now, scale = means[x.segment, key[1]], total / n, weights[key[0]] * r.idf(df[key], n)
                low = max(low, scale * (r.d + (r.k + 1) * moved_impact(x.min_impact, was, now)[0]))
                high = min(high, scale * (r.d + (r.k + 1) * moved_impact(x.max_impact, was, now)[1]))
            return low, high

        upper = {key: [(bounds(key, x)[1], x.n, x.level) for x in own] for key, own in strata.items()}
        most = {key: max(u for u, _, _ in own) for key, own in upper.items()}
        others = {key: sum(most.values()) - m for key, m in most.items()}
        whole = sum(n for own in upper.values() for _, n, _ in own)

        def pruned(threshold: float) -> tuple[dict, int]:
            least = {key: min((level for u, _, level in own if u + others[key] >= threshold - _SLACK), default=LEVELS) for key, own in upper.items()}
            return {key: (df[key], level) for key, level in least.items()}, sum(n for key, own in upper.items() for _, n, level in own if level >= least[key])

        threshold = 0.0
        for key, own in strata.items() if limit else ():
            seen = 0
            for low, n in sorted(((bounds(key, x)[0], x.n) for x in own), reverse=True):
                seen += n
                if seen >= limit + gone[key]:  # so many passages score this much by one term alone
                    threshold = max(threshold, low)
                    break
        pairs, read = pruned(threshold)
        ahead = max(64 * (limit or 0), 4096)
        while limit and len(pairs) > 1 and read > 8 * ahead:
            first, left = {}, ahead
            for u, n, level, key in sorted(((u, n, level, key) for key, own in upper.items() for u, n, level in own), key=lambda x: -x[0]):
                if left > 0:
                    first[key] = (df[key], min(level, first.get(key, (0, LEVELS))[1]))
                    left -= n
            found = self._scores(Plan(weights, first, 0, 0), r, None).orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
            if found.n == limit and found.least > threshold:
                threshold = found.least
            pairs, now = pruned(threshold)
            if now > read / 2:
                break
            read, ahead = now, 8 * ahead
        return Plan(weights, pairs, sum(n for key, own in upper.items() for _, n, level in own if level >= pairs[key][1]), whole)

    def _scores(self, plan: Plan, r: Ranking, limit: int | None) -> DataFrame:
        figures = self.figures()
        pairs = {key: x for key, x in plan.pairs.items() if x[1] < LEVELS}
        if not pairs:
            return _nothing(self.spark)
        known = [(t, f, df, float(plan.weights[t]), figures[f][0], figures[f][1] / figures[f][0], level) for (t, f), (df, level) in pairs.items()]
        known = self.spark.createDataFrame(known, "term string, field string, df long, weight double, n long, mean double, least int")
        blocks = self.part("blocks").select("segment", "term", "field", "level", "postings")
        if len(pairs) <= PUSHED_LEVELS:
            blocks = blocks.where(_any([(F.col("term") == t) & (F.col("field") == f) & (F.col("level") >= level) for (t, f), (_, level) in pairs.items()]))
        else:
            blocks = blocks.where(F.col("term").isin(sorted({t for t, _ in pairs})))
        hits = blocks.join(F.broadcast(known), ["term", "field"]).where("level >= least")  # PUSHED terms at most, once a field
        return best(scored(self._alive(hits.select("segment", "df", "weight", "n", "mean", F.explode("postings").alias("p")).select("*", "p.*")), r), limit)

    def search(self, query: str, limit: int | None = 10, fuzzy: bool = True, prefix: bool = True, r: Ranking = Ranking(), fields: tuple[str, ...] | None = None) -> DataFrame:
        """(node_id, source_id, score) as ranked_search over the fields of the index, or some of them."""
        plan = self.plan(query, limit, fuzzy, prefix, r, fields)
        if plan is not None:
            return self._scores(plan, r, limit)
        fields, figures = fields or self.fields, self.figures()
        known = self._counts(fields).join(self._known(query_words(query), r, fuzzy, prefix), "term").groupBy("term", "field", "weight").agg(F.sum("n").alias("df")).where("df > 0")
        sizes = self.spark.createDataFrame([(f, figures[f][0], figures[f][1] / max(figures[f][0], 1)) for f in fields], "field string, n long, mean double")
        hits = self.part("blocks").select("segment", "term", "field", F.explode("postings").alias("p")).select("segment", "term", "field", "p.*")
        return best(scored(self._alive(hits.join(known, ["term", "field"]).join(F.broadcast(sizes), "field")), r), limit)  # one row a field


def _matched(words: list[str], r: Ranking, fuzzy: bool, prefix: bool) -> Column:
    """array<double> of the weights of the words that a term matches."""
    return F.array_compact(F.array(*(matching(F.col("term"), w, r, fuzzy, prefix) for w in words)))


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "node_id string, source_id string, score double")


def build_index(nodes: DataFrame, path: str, fields: tuple[str, ...] = FIELDS) -> SearchIndex:
    """The index of passages that have the columns ``fields``, see with_titles, in one segment."""
    return SearchIndex(nodes.sparkSession, path, fields).add(nodes)
