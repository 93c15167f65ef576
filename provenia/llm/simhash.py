"""SimHash near-dedup by anchor-point covering.

Fingerprints have 64 bits. The anchors are the words of a covering code on 46 of them: the product of two binary
Golay codes of 23 bits, each perfect with covering radius 3, so every fingerprint has an anchor within R = 6. If two
fingerprints differ in at most t bits, the second lies within R + t of the first one's nearest anchor. Each
fingerprint is thus sent home, to its nearest anchor, and replicated to every anchor within R + t (78 of 16,777,216
on average for t = 2), and homes are compared with replicas per anchor. No pair within t is missed.

Copies cost nothing: documents are first reduced to different fingerprints. What one anchor gathers is compared in
blocks, and of the links found only a spanning forest leaves the task; components come from star passes over these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm import spans
from provenia.llm.components import components
from provenia.llm.shared import Workspace, batches

_CHUNK = 1 << 18
_SHINGLES = 1 << 18
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1. Fixed value.
_GOLAY = 0b101011100011
_RADIUS = 3

_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


# ---------------------------------------------------------------- fingerprints


def _bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group of hashes h[first[g]:first[g + 1]], how many have each of the 64 bits."""
    size = np.diff(first)
    blocks = -(-size // 255)
    start = np.repeat(first[:-1], blocks) + 255 * spans.spread(blocks)
    of = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros((len(size), 64), np.int64)
    if len(start):
        octets = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, k]], start).view(np.uint8).reshape(-1, 8)
            out[:, 8 * k : 8 * k + 8] = spans.sums(lanes, of, np.int64)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text as uint64: lower-cased A-Z, words parted by white space, shingles of ``width`` words.

    Texts of fewer words have one shingle, the whole sequence; texts without words get fingerprint 0.
    """
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, j in spans.runs(offsets, _CHUNK):
        at = offsets[i : j + 1] - offsets[i]
        text = spans.LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = spans.word_spans(text, at)
        if not len(starts):
            continue
        text, starts, ends = spans.single_spaced(text, starts, ends)
        words = np.diff(first)
        shingles = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
        of = np.concatenate([[0], np.cumsum(shingles)])
        begin = np.repeat(first[:-1], shingles) + spans.spread(shingles)
        end = begin + np.repeat(np.minimum(words, width), shingles) - 1
        ones = np.zeros((j - i, 64), np.int64)
        for lo in range(0, len(begin), _SHINGLES):  # a very long text takes several turns
            hi = min(lo + _SHINGLES, len(begin))
            h = spans.xxh64(text, starts[begin[lo:hi]], ends[end[lo:hi]], seed)
            ones += _bit_counts(h, np.clip(of, lo, hi) - lo)
        bits = (2 * ones > shingles[:, None]).astype(np.uint8)
        out[i:j] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_frame(docs: DataFrame, id_col: str, text_col: str, width: int, carry: str | None = None) -> DataFrame:
    """(id, fp): a signed long with the 64 bits; and the column ``carry`` as it is."""
    kept = [carry] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *kept)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(it):
            fp = fingerprints(data, offsets, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp), *(batch.column(c) for c in kept)], ["id", "fp", *kept])
            del batch, data, offsets
        spans.released()

    return rows.mapInArrow(run, rows.limit(0).select("id", F.lit(None).cast("long").alias("fp"), *kept).schema)


# ---------------------------------------------------------------- anchors


@cache
def _balls(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to ``radius`` in 23 bits: (patterns by syndrome and then weight, weights, first, upto).

    Those of syndrome s begin at first[s]; upto[s, w] of them have weight w or less.
    """
    syndrome_of = np.array([_syndrome(1 << k) for k in range(23)], np.int64)
    s, w, e = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for k in range(1, radius + 1):
        c = np.array(list(combinations(range(23), k)), np.int64)
        s.append(np.bitwise_xor.reduce(syndrome_of[c], axis=1))
        w.append(np.full(len(c), k))
        e.append((1 << c).sum(axis=1))
    s, w, e = (np.concatenate(x) for x in (s, w, e))
    order = np.lexsort((e, w, s))
    upto = np.zeros((2048, radius + 1), np.int64)
    np.add.at(upto, (s, w), 1)
    return e[order], w[order], np.searchsorted(s[order], np.arange(2048)), np.cumsum(upto, axis=1)


def _syndrome(word: int) -> int:
    """Remainder of the word's polynomial by the generator."""
    for k in range(22, 10, -1):
        if word >> k & 1:
            word ^= _GOLAY << (k - 11)
    return word


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 bits and of the high 11 bits of a word."""
    return np.array([_syndrome(x) for x in range(1 << 12)]), np.array([_syndrome(x << 12) for x in range(1 << 11)])


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) for each fingerprint and each anchor within covering radius plus threshold.

    ``home`` marks the nearest anchor of a fingerprint. An anchor's number is made of the 12 free bits of its two
    code words.
    """
    fp, reach = fp.view(np.uint64), 2 * _RADIUS + threshold
    e, w, first, upto = _balls(reach)
    low, high = _syndromes()
    a, b = ((fp >> np.uint64(k) & np.uint64(0x7FFFFF)).astype(np.int64) for k in (0, 23))
    sa, sb = (low[x & 0xFFF] ^ high[x >> 12] for x in (a, b))
    count = upto[sa, reach - w[first[sb]]]  # what the nearest word of the other half leaves
    row = np.repeat(np.arange(len(fp)), count)
    nth_a = spans.spread(count)
    at_a = first[sa][row] + nth_a
    pairs = upto[sb[row], reach - w[at_a]]
    nth_b = spans.spread(pairs)
    row, at_a, nth_a = np.repeat(row, pairs), np.repeat(at_a, pairs), np.repeat(nth_a, pairs)
    code_a, code_b = a[row] ^ e[at_a], b[row] ^ e[first[sb][row] + nth_b]
    return row, (code_a >> 11) << 12 | code_b >> 11, (nth_a == 0) & (nth_b == 0)


# ---------------------------------------------------------------- links


class Forest:
    """Union-find over the numbers 0 .. n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def bucket_links(anchor: np.ndarray, home: np.ndarray, fp: np.ndarray, threshold: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a spanning forest of the links between homes and replicas of each anchor.

    Rows are sorted by anchor. Pairs are compared in blocks of ``block``, so memory stays bounded whatever one
    anchor holds.
    """
    n = len(anchor)
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    group = np.repeat(np.arange(len(begin)), size)
    homes = np.flatnonzero(home & (size[group] > 1))
    left, right = [], []
    todo = size[group[homes]]
    ends = np.cumsum(todo)
    i = 0
    while i < len(homes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + block, "right")))
        for lo in range(0, int(todo[i]) if j == i + 1 else 1, block):  # a home whose anchor holds more than a block
            some = homes[i:j]
            count = np.minimum(todo[i:j] - lo, block)
            x = np.repeat(some, count)
            y = np.repeat(begin[group[some]] + lo, count) + spans.spread(count)
            near = (np.bitwise_count(fp[x] ^ fp[y]) <= threshold) & (fp[x] != fp[y])
            left.append(x[near])
            right.append(y[near])
        i = j
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = np.concatenate(left), np.concatenate(right)
    _, label = np.unique(fp, return_inverse=True)
    lo, hi = np.minimum(label[left], label[right]), np.maximum(label[left], label[right])
    _, once = np.unique(lo * (label.max() + 1 if n else 1) + hi, return_index=True)
    trees = Forest(n)
    keep = [k for k in once.tolist() if trees.join(int(label[left[k]]), int(label[right[k]]))]
    return left[keep], right[keep]


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: int = 2, carry: str | None = None) -> DataFrame:
    """One row per document: id, fp (signed long), component_id, the least id reachable by links, itself included,
    component, the least fingerprint reachable, and the column ``carry`` as it is.

    Fingerprints link at ``threshold`` or fewer differing bits; equal ones link. Null and empty texts have fingerprint
    0 and link like any other. Repeated rows give repeated results. A null id takes part by its fingerprint; its
    component is null only if no id of it is known. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "simhash")
    prints, _ = work.save(fingerprint_frame(docs, id_col, text_col, width, carry), "prints")
    classes, _ = work.save(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")

    def replicate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for lo in range(0, len(fps), 4096):
                part = np.ascontiguousarray(fps[lo : lo + 4096])
                row, anchor, home = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(home), pa.array(part[row])], ["anchor", "home", "fp"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def links(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            anchor, home, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            x, y = bucket_links(anchor, home, fp.view(np.uint64), threshold)
            return pa.RecordBatch.from_arrays([pa.array(fp[x]), pa.array(fp[y])], ["a", "b"])

        for batch in it:
            if not batch.num_rows:
                continue
            anchor, home, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "home", "fp"))
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
            if cut:
                yield links([*kept, (anchor[:cut], home[:cut], fp[:cut])])
                kept = []
            elif kept and kept[-1][0][-1] != anchor[-1]:
                yield links(kept)
                kept = []
            kept.append((anchor[cut:], home[cut:], fp[cut:]))
        if kept:
            yield links(kept)

    dealt = classes.select("fp").mapInArrow(replicate, "anchor int, home boolean, fp long")
    edges = dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")
    joined = components(edges, work)
    found, _ = work.save(joined, "components")
    tops = found.join(classes.withColumnRenamed("fp", "node"), "node")
    least = tops.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = tops.select("node", "component").join(least, "component").select(F.col("node").alias("fp"), "component_id", "component")
    named = classes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("component", "fp").alias("component"))
    named, _ = work.save(named, "named")  # so that adaptive execution can split a hot fingerprint in the last join
    return prints.join(named, "fp", "left").select("id", "fp", "component_id", "component", *([carry] if carry else []))
