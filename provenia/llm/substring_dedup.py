"""Substring dedup by De Bruijn compaction.

The token k-mers (windows of ``window`` words) are the edges of a De Bruijn graph whose nodes are the sequences of
one word less. A graph over a large corpus is not built edge by edge: it is dealt by minimizers (Chikhi et al., 2016).
The minimizer of an edge is its ``core``-word subsequence of least hash, so equal edges have equal minimizers, and the
edges of one document that follow each other with the same minimizer form one path.

1. Each document sends one row per path: minimizer, fingerprint of the path's words, and coordinates (document, first
   window, number of windows). That is one row for about 18 words.
2. A minimizer seen in one document only holds no repeated edge and is left out. Where all its paths have the same
   words, the path does not branch: all of its edges occur in the same documents and are compacted to one, with the
   least document as source.
3. Where paths of one minimizer differ, the graph branches. Different paths, one of each at its source coordinates,
   are opened into edges; a join over the edges gives each its least document.
4. A join brings these to all coordinates of each path. Edges whose least document is smaller than their own, with
   neighbours of the same source behind each other, become spans: coordinates in a document and in its source.
5. Spans are verified at their source coordinates: the source's words, read again there, are digested (BLAKE2b, 128
   bits) once for all copies, and a document loses only spans whose own words have the same digest.

Until then paths and edges count as equal if their minimizers (64 bits) and the fingerprints of their whole word
sequences (64 bits, by another multiplier) are. Texts are only shuffled where they hold branching sources, sources of
spans or removed words: a bitmap of at most ``_BITS`` bits, whose size does not depend on the data, lets all other rows
pass by in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm import spans
from provenia.llm.shared import Workspace

_CHUNK = 1 << 19
_BITS = 1 << 26  # 8 MB
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LAST = (1 << 63) - 1
#: What tells rows apart: the id, a hash of the text, and for null ids, which all come last, one more.
_KEY = ["doc", "tag", "more"]
_SOURCE = [f"source_{c}" for c in _KEY]
#: What paths have in common that count as equal: minimizer, fingerprint and number of windows.
_PATH = ["m", "p", "count"]


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


class _Sequence:
    """Fingerprints of any stretch of a sequence of word hashes, from prefix sums."""

    def __init__(self, hashes: np.ndarray, which: int, bits: int = 64) -> None:
        self.drop = np.uint64(64 - bits)
        n = 1 << max(18, (len(hashes) + 1).bit_length())
        base = int(_MULTIPLIERS[which])
        self.inverse = _powers(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _powers(base, n)[: len(hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        x ^= x >> np.uint64(29)
        x *= _MULTIPLIERS[0]
        return (x ^ (x >> np.uint64(32))) >> self.drop


def paths(data: np.ndarray, offsets: np.ndarray, window: int, core: int, bits: int = 64) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, minimizer, fingerprint, first window, windows) arrays of the paths of each text."""
    for i, j in spans.runs(offsets, _CHUNK):
        starts, ends, first = spans.word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = len(starts) - window + 1
        if n < 1:
            continue
        hashes = spans.xxh64(data[offsets[i] : offsets[j]], starts, ends, 1)
        at = np.arange(len(starts) - core + 1)
        value = _Sequence(hashes, 0).of(at, at + core)
        cores, place, width, goal = value, at, 1, window - core + 1
        while width < goal:  # least core of each window, the first of equal ones
            step = min(width, goal - width)
            later = cores[step:] < cores[:-step]
            cores, place = np.where(later, cores[step:], cores[:-step]), np.where(later, place[step:], place[:-step])
            width += step
        text = np.repeat(np.arange(j - i), np.diff(first))
        inside = np.flatnonzero(text[:n] == text[window - 1 :])
        if not len(inside):
            continue
        begin = np.ones(len(inside), bool)
        begin[1:] = (place[inside[1:]] != place[inside[:-1]]) | (inside[1:] != inside[:-1] + 1)
        begin = np.flatnonzero(begin)
        count = np.diff(np.append(begin, len(inside)))
        s = inside[begin]
        words = _Sequence(hashes, 1, bits).of(s, s + count + window - 1)
        yield i + text[s], value[place[s]].view(np.int64), words.view(np.int64), (s - first[text[s]]).astype(np.int32), count.astype(np.int32)


def edges_at(data: np.ndarray, start: np.ndarray, count: np.ndarray, window: int, bits: int = 64) -> np.ndarray:
    """Fingerprints of the windows start[p] .. start[p] + count[p] - 1 of one text, path after path."""
    s, e, _ = spans.word_spans(data, np.array([0, len(data)]))
    at = np.repeat(start.astype(np.int64), count) + spans.spread(count.astype(np.int64))
    return _Sequence(spans.xxh64(data, s, e, 1), 1, bits).of(at, at + window).view(np.int64)


class Words:
    """The words of one text, parted by single spaces, so that any stretch of them is one slice."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        text, self.starts, self.ends = spans.single_spaced(data, starts, ends)
        self.text = text.tobytes()

    def digest(self, start: int, words: int) -> bytes | None:
        """None where the text has no such words."""
        if start + words > len(self.starts):
            return None
        return blake2b(self.text[self.starts[start] : self.ends[start + words - 1]], digest_size=16).digest()


def merged(start: np.ndarray, count: np.ndarray, source: list[np.ndarray], at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first word, words) of spans: windows behind each other, here and in the same source, become one.

    Windows start[k] .. start[k] + count[k] - 1 of a text equal those from at[k] on of the text source[..][k].
    """
    order = np.lexsort((start, at - start, *source))
    s, e, shift = start[order], (start + count)[order], (at - start)[order]
    new = np.ones(len(s), bool)
    new[1:] = shift[1:] != shift[:-1]
    for x in source:
        new[1:] |= x[order][1:] != x[order][:-1]
    # Within one source and shift, a window beyond all before it begins a span.
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(e + group * (1 << 32)) - group * (1 << 32)
    new[1:] |= s[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return order[first], s[first], reach[last] - s[first] + window - 1


def _bitmap(keys: DataFrame, key: list[str], n: int) -> tuple[DataFrame, int]:
    """(bucket, bits) of a bitmap over the hashes of keys, of 8 bits a key and at most _BITS; and its size."""
    size = min(_BITS, 1 << max(15, (8 * n).bit_length()))
    at = F.pmod(F.xxhash64(*key), F.lit(size))
    spot = keys.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND(32767).alias("bit"))
    return spot.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), size


def _split(docs: DataFrame, keys: DataFrame, key: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """Rows of docs that may be in keys, and rows that cannot be; neither is shuffled."""
    bitmap, size = _bitmap(keys, key, n)
    at = F.pmod(F.xxhash64(*key), F.lit(size))
    tested = docs.withColumn("bucket", F.shiftright(at, 15)).join(F.broadcast(bitmap), "bucket", "left")  # 8 MB at most
    bit = at.bitwiseAND(32767)
    octet = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.floor(octet / F.pow(F.lit(2), bit.bitwiseAND(7))) % 2 == 1
    tested = tested.withColumn("may", F.coalesce(hit, F.lit(False)))
    return tested.where("may").drop("bucket", "bits", "may"), tested.where("not may").drop("bucket", "bits", "may")


def removals(docs: DataFrame, work: Workspace, window: int, core: int, bits: int) -> tuple[DataFrame, int]:
    """_KEY and cuts of the documents that lose words, and how many: cuts: array<struct<start, words, digest>>.

    docs: _KEY, text. Documents are told apart by all of _KEY, ordered by doc alone.
    """

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = spans.text_column(batch.column("text"))
            for text, *found in paths(data, offsets, window, core, bits):
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in _KEY), *map(pa.array, found)], [*_KEY, "m", "p", "start", "count"])
            del batch, data, offsets
        spans.released()

    rows, _ = work.save(docs.select(*_KEY, "text").mapInArrow(scan, "doc long, tag long, more long, m long, p long, start int, count int"), "paths")
    stats = rows.groupBy("m").agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.min("doc").alias("d0"), F.max("doc").alias("d1"))
    # Written, so that both sides of the joins are plain shuffles and adaptive execution can split a hot minimizer.
    known, _ = work.save(stats.where("d0 < d1").select("m", F.expr("p0 <> p1").alias("branches")), "known")
    repeated, _ = work.save(rows.join(known, "m"), "repeated")
    source = F.min(F.struct(*_KEY, "start")).alias("source")
    classes, _ = work.save(repeated.groupBy(*_PATH).agg(source, F.max("branches").alias("branches")), "classes")
    whole = classes.where("not branches").select(*_PATH, F.array(F.struct(F.lit(0).alias("o"), F.col("count").alias("c"), "source")).alias("least"))

    at = F.struct(*_PATH, F.col("source.start").alias("start"))
    opened, seen = work.save(classes.where("branches").groupBy(*(F.col(f"source.{c}").alias(c) for c in _KEY)).agg(F.collect_list(at).alias("at")), "opened", n=F.count("*"))
    held, _ = _split(docs.select(*_KEY, "text"), opened, _KEY, seen["n"])

    def open_paths(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = spans.text_column(batch.column("text"))
            keys = [batch.column(c).to_numpy() for c in _KEY]
            for k, at in enumerate(batch.column("at")):
                t = at.values
                *path, start = (t.field(c).to_numpy(zero_copy_only=False) for c in (*_PATH, "start"))
                count = path[-1]
                e = edges_at(data[offsets[k] : offsets[k + 1]], start, count, window, bits)
                nth = spans.spread(count.astype(np.int64)).astype(np.int32)
                own = [np.full(len(e), x[k], np.int64) for x in keys]
                out = [pa.array(x) for x in (*(np.repeat(x, count) for x in path), nth, e, *own, np.repeat(start, count) + nth)]
                yield pa.RecordBatch.from_arrays(out, [*_PATH, "o", "e", *_KEY, "start"])

    opened_schema = "m long, p long, count int, o int, e long, doc long, tag long, more long, start int"
    edges, _ = work.save(held.join(opened, _KEY).select(*_KEY, "text", "at").mapInArrow(open_paths, opened_schema), "edges")
    first, _ = work.save(edges.groupBy("m", "e").agg(source), "first")
    branching = edges.select(*_PATH, "o", "e").join(first, ["m", "e"]).groupBy(*_PATH)
    branching = branching.agg(F.collect_list(F.struct("o", F.lit(1).alias("c"), "source")).alias("least"))

    hit = F.transform(F.filter("least", lambda x: x["source"]["doc"] < F.col("doc")), lambda x: F.struct((F.col("start") + x["o"]).alias("start"), x["c"].alias("count"), x["source"].alias("source")))
    cut = repeated.drop("branches").join(whole.unionByName(branching), _PATH).select(*_KEY, hit.alias("hit")).where(F.size("hit") > 0)
    # The same path of the same document may come twice where rows repeat; windows are a set.
    per_doc = cut.groupBy(*_KEY).agg(F.flatten(F.collect_set("hit")).alias("cuts"))

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for k, cuts in enumerate(batch.column("cuts")):
                t = cuts.values
                start, count = (t.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "count"))
                *origin, at = (t.field("source").field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_KEY, "start"))
                entry, begin, words = merged(start, count, origin, at, window)
                out.append((np.full(len(entry), k), begin, words, *(x[entry] for x in origin), (at - start)[entry] + begin))
            if out:
                row, *cols = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in _KEY), *map(pa.array, cols)], [*_KEY, "start", "words", *_SOURCE, "at"])

    spans_schema = ", ".join(f"{c} long" for c in (*_KEY, "start", "words", *_SOURCE, "at"))
    found, _ = work.save(per_doc.mapInArrow(merge, spans_schema), "spans")
    asked = found.select(*(F.col(s).alias(c) for s, c in zip(_SOURCE, _KEY, strict=True)), "at", "words").distinct()
    asked, seen = work.save(asked.groupBy(*_KEY).agg(F.collect_list(F.struct("at", "words")).alias("asked")), "asked", n=F.count("*"))
    sources, _ = _split(docs.select(*_KEY, "text"), asked, _KEY, seen["n"])

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = spans.text_column(batch.column("text"))
            out = []
            for k, wanted in enumerate(batch.column("asked").to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                starts, ends, _ = spans.word_spans(text, np.array([0, len(text)]))
                held = Words(text, starts, ends)
                out += [(k, w["at"], w["words"], held.digest(w["at"], w["words"])) for w in wanted]
            if out:
                row, at, words, got = zip(*out, strict=True)
                own = [batch.column(c).take(pa.array(row)) for c in _KEY]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int64()), pa.array(words, pa.int64()), pa.array(got, pa.binary())], [*_SOURCE, "at", "words", "digest"])

    held = sources.join(asked, _KEY).select(*_KEY, "text", "asked")
    want = held.mapInArrow(digests, ", ".join(f"{c} long" for c in (*_SOURCE, "at", "words")) + ", digest binary")
    want, _ = work.save(want.distinct(), "digests")  # rows that repeat give the same digests
    checked = found.join(want, [*_SOURCE, "at", "words"]).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "words", "digest")).alias("cuts"))
    out, seen = work.save(checked, "cuts", n=F.count("*"))
    for done in (rows, known, repeated, first, edges, classes, opened, found, asked, want):
        work.drop(done)
    return out, seen["n"]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, core: int = 20, bits: int = 64) -> DataFrame:
    """All rows and columns of ``docs`` with kept_text, n_words, n_removed and removed.

    A word goes if a window of ``window`` consecutive words of one document covers it whose sequence also starts in a
    document with a smaller id; windows are judged on the input. kept_text: the other words joined by one space;
    removed: array<struct<start, end>> of word numbers. Only words go that equal those at the source's coordinates, by a
    digest of both; ``bits`` of the fingerprints find them. Null texts have no words. Rows that share an id never remove each other's words, nor do rows with a
    null id, which come after all others. Texts of any length are read whole.
    Columns with one of the new names are replaced. No rows give no rows.
    """
    core = min(core, window)
    work = Workspace(docs.sparkSession, "substring-dedup")
    docs = docs.drop("kept_text", "n_words", "n_removed", "removed")
    text = F.coalesce(text_col, F.lit(""))
    doc = F.col(id_col).cast("long")
    more = F.when(doc.isNull(), F.xxhash64(F.lit(11), text)).otherwise(F.lit(0).cast("long"))
    keys: dict[str, Column] = {"__doc": F.coalesce(doc, F.lit(_LAST)), "__tag": F.xxhash64(text), "__more": more}
    slim = docs.select(*(c.alias(k) for k, c in zip(_KEY, keys.values(), strict=True)), text.alias("text"))
    cuts, n = removals(slim, work, window, core, bits)
    full = docs.withColumns(keys)
    cuts = cuts.select(*(F.col(k).alias(f"__{k}") for k in _KEY), F.col("cuts").alias("__cuts"))
    may, rest = _split(full, cuts, list(keys), n)
    marked = may.join(cuts, list(keys), "left").unionByName(rest.withColumn("__cuts", F.lit(None).cast(cuts.schema["__cuts"].dataType)))
    names = docs.columns

    def cut_texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = spans.text_column(batch.column(text_col))
            lists = batch.column("__cuts")
            for i, j in spans.runs(offsets, 1 << 20):
                piece = data[offsets[i] : offsets[j]]
                starts, ends, first = spans.word_spans(piece, offsets[i : j + 1] - offsets[i])
                words = np.diff(first)
                gone = np.zeros(len(starts), bool)
                ranges = [[]] * (j - i)
                for k in np.flatnonzero(np.asarray(lists.slice(i, j - i).is_valid())).tolist():
                    a, b = first[k], first[k + 1]
                    held = Words(piece, starts[a:b], ends[a:b])
                    lost = gone[a:b]
                    for c in lists[i + k].as_py():
                        if c["digest"] is not None and held.digest(c["start"], c["words"]) == c["digest"]:
                            lost[c["start"] : c["start"] + c["words"]] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], lost, [0]])))
                    ranges[k] = [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                n_removed = spans.sums(gone, first, np.int64)
                left = words - n_removed
                size = spans.sums((ends - starts) * ~gone, first, np.int64) + np.maximum(left - 1, 0)
                out, _, _ = spans.single_spaced(piece, starts[~gone], ends[~gone])
                # Texts with words are parted by the same single space that parts words; it is taken out again.
                some = np.flatnonzero(left)
                begin = np.zeros(len(some), np.int64)
                np.cumsum(size[some][:-1] + 1, out=begin[1:])
                keep = np.ones(len(out), bool)
                keep[begin[1:] - 1] = False
                flat = out[keep]
                bounds = np.concatenate([[0], np.cumsum(size)])
                kept = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())
                spans_out = pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                own = [batch.column(c).slice(i, j - i) for c in names]
                yield pa.RecordBatch.from_arrays([*own, kept, pa.array(words.astype(np.int64)), pa.array(n_removed), spans_out], [*names, "kept_text", "n_words", "n_removed", "removed"])
            del batch, data, offsets, lists
        spans.released()

    schema = docs.limit(0).selectExpr("*", "'' kept_text", "0L n_words", "0L n_removed", "cast(null as array<struct<start:bigint,end:bigint>>) removed").schema
    return marked.select(*(F.col(f"`{c}`") for c in names), "__cuts").mapInArrow(cut_texts, schema)
