"""Search by regular expressions through an index of character trigrams.

A pattern is turned into a formula of trigrams that every match must hold, an AND or OR of others: literal runs, small
classes, alternatives and repetitions give trigrams, anything else gives none. Passages whose trigrams satisfy the
formula are candidates, and the pattern itself runs on these alone, in order of passages and only until there are enough
matches. A pattern without trigrams, or written in a way that this reading does not cover, runs over all passages.

Matching ignores the case of ASCII letters, so trigrams are taken from the text with A-Z lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import re._constants as ops
import re._parser as reader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.operators.search import is_pattern, matched, ordered

#: Alternatives of a run of literals, and characters of a class, that are still told apart.
MOST = 32
#: Rarest trigrams of a conjunction that are looked up; the others could only narrow further.
RAREST = 4
#: Places of a block of postings, and pairs of trigram and place that a task sorts at once.
BLOCK, HELD = 1024, 1 << 21
#: Candidates of the first round of a search with a limit; each further round takes eight times as many.
AHEAD, ROUNDS = 256, 4

Formula = tuple | int | None  # ("and" | "or", parts), a trigram, or None: any passage


def trigram(text: str) -> int:
    """Three characters as one number, 21 bits each."""
    a, b, c = map(ord, text)
    return a << 42 | b << 21 | c


def _lower(c: int) -> str:
    return chr(c + 32) if 65 <= c <= 90 else chr(c)


def _both(kind: str, parts: list[Formula]) -> Formula:
    """An AND or OR, simplified; any passage is the unit of the one and the end of the other."""
    if kind == "or" and (None in parts or not parts):
        return None
    flat = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [] if p is None else [p]
    unique = list(dict.fromkeys(flat))
    return None if not unique else unique[0] if len(unique) == 1 else (kind, tuple(unique))


def _of_strings(strings: set[str]) -> Formula:
    """What a text must hold that holds one of the strings."""
    return _both("or", [_both("and", [trigram(s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items: list) -> set[str] | None:
    """The characters of a class if they are few."""
    out: set[str] = set()
    for op, value in items:
        if op is ops.LITERAL:
            out.add(_lower(value))
        elif op is ops.RANGE and value[1] - value[0] < MOST:
            out |= {_lower(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST else None


def _read(op: object, value: object) -> tuple[set[str] | None, Formula]:
    """(all strings that an element can match if they are few, else None; what a text must hold that it matches in)."""
    if op is ops.LITERAL:
        return {_lower(value)}, None
    if op is ops.IN:
        return _class(value), None
    if op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
        return {""}, None
    if op is ops.SUBPATTERN:
        return _sequence(value[3])
    if op is ops.ATOMIC_GROUP:
        return _sequence(value)
    if op is ops.BRANCH:
        found = [_sequence(x) for x in value[1]]
        strings = set().union(*(s for s, _ in found if s is not None))
        if all(s is not None for s, _ in found) and len(strings) <= MOST:
            return strings, None
        return None, _both("or", [f if s is None else _of_strings(s) for s, f in found])
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, formula = _sequence(inner)
        if strings is not None and most == 1:
            return strings | ({""} if least == 0 else set()), None
        if strings is not None and least == most and len(strings) ** least <= MOST and least <= MOST:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in strings}
            return out, None
        return None, None if least == 0 else formula if strings is None else _of_strings(strings)
    return None, None


def _sequence(items: object) -> tuple[set[str] | None, Formula]:
    run, parts, broken = {""}, [], False
    for op, value in items:
        strings, formula = _read(op, value)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a in run for b in strings}
            continue
        parts.append(_of_strings(run))
        broken, run = True, {""} if strings is None else strings
        if strings is None:
            parts.append(formula)
    return (None, _both("and", [*parts, _of_strings(run)])) if broken else (run, None)


#: Escapes, groups and classes that mean the same to the parser here and to the engine that matches.
_ESCAPE = re.compile(r"\\([dDwWsSbBAZzntrf]|[^A-Za-z0-9])")
_GROUP = re.compile(r"\(\?(:|=|!|<=|<!)")


def _plain(pattern: str) -> bool:
    i, inside = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if not _ESCAPE.match(pattern, i) or (inside and pattern[i + 1] in "bBAZz"):
                return False
            i += 2
            continue
        if inside:
            if c == "[" or pattern.startswith("&&", i):
                return False
            inside = c != "]"
        elif c == "[":
            inside = True
            i += pattern.startswith("[^", i)
            if pattern.startswith("]", i + 1):
                return False
        elif pattern.startswith("(?", i) and not _GROUP.match(pattern, i):
            return False
        i += 1
    return True


def formula_of(pattern: str) -> Formula:
    """The trigrams that every text with a match of the pattern, case ignored, must hold; None where nothing is known."""
    if not _plain(pattern):
        return None
    try:
        strings, formula = _sequence(reader.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None
    return formula if strings is None else _of_strings(strings)


def _narrowed(f: Formula, df: dict[int, int]) -> tuple[Formula, int]:
    """(the formula with the RAREST parts of each conjunction alone, how many passages satisfy it at most)."""
    if not isinstance(f, tuple):
        return f, df.get(f, 0)
    parts = [_narrowed(p, df) for p in f[1]]
    if f[0] == "or":
        return _both("or", [p for p, _ in parts]), sum(n for _, n in parts)
    parts = sorted(parts, key=lambda p: p[1])[:RAREST]
    return _both("and", [p for p, _ in parts]), parts[0][1]


def _grams(f: Formula) -> list[int]:
    return sorted({g for p in f[1] for g in _grams(p)}) if isinstance(f, tuple) else [] if f is None else [f]


def _holds(f: Formula, column: dict[int, Column]) -> Column:
    if not isinstance(f, tuple):
        return column[f]
    tests = [_holds(p, column) for p in f[1]]
    out = tests[0]
    for t in tests[1:]:
        out = out & t if f[0] == "and" else out | t
    return out


def _grams_of(texts: list[str], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, place) of the different trigrams of each passage, sorted."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    passage = np.repeat(np.arange(len(texts)), size)
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = passage[2:] == passage[:-2]
    grams, code = np.unique((points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inside], return_inverse=True)
    pair = np.unique(code * len(texts) + passage[2:][inside])
    return grams[pair // len(texts)], places[pair % len(texts)]


def _lists(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages (text, place) as runs of (gram, n, places), sorted by gram: some HELD pairs a run, BLOCK places a list at most."""

    def run(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        gram, place = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        order = np.argsort(gram, kind="stable")
        gram, place, n = gram[order], place[order], len(order)
        new = np.append(True, gram[1:] != gram[:-1])
        at = np.flatnonzero((np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))) % BLOCK == 0)
        for lo in range(0, len(at), 1 << 13):
            some = at[lo : lo + (1 << 13)]
            bounds = np.append(some, at[lo + (1 << 13)] if lo + (1 << 13) < len(at) else n)
            lists = pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(place[bounds[0] : bounds[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(gram[some]), pa.array(np.diff(bounds)), lists], ["gram", "n", "places"])

    held, n = [], 0
    for batch in it:
        for lo in range(0, batch.num_rows, 1024):
            own = batch.slice(lo, 1024)
            held.append(_grams_of(own.column("text").fill_null("").to_pylist(), own.column("place").to_numpy()))
            n += len(held[-1][0])
            if n >= HELD:
                yield from run(held)
                held, n = [], 0
    if n:
        yield from run(held)


@dataclass(frozen=True)
class PatternIndex:
    """Passages in order, each with its place, and the places of each trigram, under a folder."""

    spark: SparkSession
    path: str

    @property
    def passages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/passages")

    @property
    def _postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    def candidates(self, pattern: str) -> DataFrame | None:
        """(place) of the passages that may hold a match; None: all of them may."""
        formula = formula_of(pattern)
        if formula is None:
            return None
        found = self._postings.where(F.col("gram").isin(_grams(formula))).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # as many as the pattern has
        formula, most = _narrowed(formula, {r.gram: r.n for r in found})
        grams = _grams(formula)
        if not most:
            return self._postings.limit(0).select(F.col("gram").alias("place"))
        rows = self._postings.where(F.col("gram").isin(grams)).select("gram", F.explode("places").alias("place"))
        if len(grams) == 1:
            return rows.select("place")
        has = {g: F.col(f"g{k}") for k, g in enumerate(grams)}
        return rows.groupBy("place").agg(*(F.max(F.col("gram") == g).alias(f"g{k}") for k, g in enumerate(grams))).where(_holds(formula, has)).select("place")

    def search(self, pattern: str, source_id: str | None = None, limit: int | None = 10, context: int = 120) -> DataFrame:
        """As regex_search: (node_id, source_id, match, context), the first match of each passage, in order of passages.

        With a limit, candidates are read in order, round by round, until there are enough matches; the rows of the last
        rounds are joined.
        """
        passages = self.passages if source_id is None else self.passages.where(F.col("source_id") == source_id)
        if not is_pattern(self.spark, pattern):
            return ordered(matched(passages.limit(0), "", context), limit)
        places = self.candidates(pattern)
        if places is None:
            return ordered(matched(passages, pattern, context), limit)
        if limit is None or source_id is not None:
            return ordered(matched(passages.join(places, "place", "left_semi"), pattern, context), limit)
        out, last = [], -1
        for k in range(ROUNDS):
            ahead = AHEAD * 8**k
            some = [r.place for r in places.where(F.col("place") > last).orderBy("place").limit(ahead).collect()]
            if some:
                rows = passages.where(F.col("place").between(some[0], some[-1]) & F.col("place").isin(some))
                out += ordered(matched(rows, pattern, context), limit - len(out)).collect()
                last = some[-1]
            if len(some) < ahead or len(out) == limit:
                return self.spark.createDataFrame(out, ordered(matched(passages, pattern, context), limit).schema)
        rest = passages.join(places.where(F.col("place") > last), "place", "left_semi")
        more = ordered(matched(rest, pattern, context), limit - len(out))
        return self.spark.createDataFrame(out, more.schema).unionByName(more)


def build_pattern_index(nodes: DataFrame, path: str) -> PatternIndex:
    """The index of passages; equal places never occur, and places rise with source and paragraph."""
    spark = nodes.sparkSession
    rows = nodes.select("node_id", "source_id", "paragraph", "text", F.col("source_id").try_cast("long").alias("s"))
    keys = ["s", "source_id", "paragraph", "node_id"]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("s").withColumn("place", F.monotonically_increasing_id()).write.option("parquet.block.size", 4 << 20).parquet(f"{path}/passages")
    out = PatternIndex(spark, path)
    lists = out.passages.select("text", "place").mapInArrow(_lists, "gram long, n long, places array<long>")
    # Small row groups: a search reads those of its trigrams alone, of each run; no pair is shuffled.
    lists.write.option("parquet.block.size", 1 << 20).parquet(f"{path}/grams")
    return out
