"""Averaged hashed subword embeddings with a softmax, trained by numpy stochastic gradient descent.

The classifier behind quality and language ID (after Joulin et al., 2016). Features of a text are its words, pairs of
neighbouring words and character n-grams of its single-spaced form, hashed to rows of an embedding table; a text is the
mean of its rows, and a linear softmax reads it. A word behind itself is one feature whatever the word, the repetition
token of Howard and Ruder (2018): averaged n-grams cannot show that a text repeats words it was not trained on. Training sees at most ``PER_CLASS`` texts of each class, those of least
hashed id among the rows allowed, and at most ``SAMPLE_BYTES`` of text in all; every text is scored whole.

As the softmax's input is linear in the mean, table and output weights are multiplied out after training, so scoring
is a gather of one row of logits for each feature and a sum by text.

Whether a text is of any learned class at all is judged apart from the softmax, whose best class is likely for want of
others: by how usual its runs of four characters are in the class where these are most usual.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm import spans
from provenia.llm.shared import hashed_rank

PER_CLASS = 1500
#: Bytes of text that training reads, shared evenly by the classes; a text over a sixteenth of a class's share is not read.
SAMPLE_BYTES = 1 << 26
_BITS = 17
_CHUNK = 1 << 18
_OUT = 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)
_GRAMS = (3, 4)
_BLOCKS = 2 + len(_GRAMS)
_USUAL = 3
#: Lower case of characters whose lower case is one character, up to the end of Armenian.
_LOWER = np.array([ord(c) if len(c := chr(k).lower()) == 1 else k for k in range(0x590)], np.uint32)
#: So many runs of usual likelihood are added to each text, so that a few odd ones say little.
_SHRINK = 8


def _bucket(x: np.ndarray, block: int) -> np.ndarray:
    return ((x * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64) + (block << _BITS)


def features(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the table, first of each text) for each kind of feature."""
    starts, ends, first = spans.word_spans(data, offsets)
    if not len(starts):
        yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        return
    text, starts, ends = spans.single_spaced(spans.LOWER[data] if lower else data, starts, ends)
    h = spans.xxh64(text, starts, ends, 3)
    yield _bucket(h, 0), first
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(h) > 1:
        same = of[1:] == of[:-1]
        pair = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])[same]
        pair = np.where(h[:-1][same] == h[1:][same], np.uint64(0), pair)
        yield _bucket(pair, 1), np.concatenate([[0], np.cumsum(same)])[np.minimum(first, len(same))]
    # Character n-grams; a text reaches from the space before its first word to the one after its last.
    padded = np.concatenate([[32], text, [32]]).astype(np.uint8)
    points = np.frombuffer(padded.tobytes().decode().encode("utf-32-le"), np.uint32)
    if lower:
        points = np.where(points < len(_LOWER), _LOWER[np.minimum(points, len(_LOWER) - 1)], points)
    some = np.flatnonzero(np.diff(first))
    begin = np.zeros(len(first) - 1, np.int64)
    end = np.zeros(len(first) - 1, np.int64)
    begin[some], end[some] = starts[first[some]], ends[first[some + 1] - 1] + 2
    if len(points) < len(padded):
        lead = np.flatnonzero((padded & 0xC0) != 0x80)
        begin, end = np.searchsorted(lead, begin), np.searchsorted(lead, end)
    code = points.astype(np.uint64)
    for k in range(2, max(_GRAMS) + 1):
        code = code[:-1] * _PRIME + points[k - 1 :]
        if k in _GRAMS:
            size = np.maximum(end - begin - k + 1, 0)
            at = np.repeat(begin, size) + spans.spread(size)
            yield _bucket(code[at], 2 + _GRAMS.index(k)), np.concatenate([[0], np.cumsum(size)])


@dataclass
class Model:
    """classes: labels in order; logits: one row of class scores per feature row; scale and shift calibrate.

    usual: for each class and run of four characters its log-likelihood over the class's mean; least_usual: texts below it are foreign.
    """

    classes: list
    logits: np.ndarray
    scale: float
    shift: np.ndarray
    lower: bool
    reject_below: float = 0.0
    usual: np.ndarray | None = None
    least_usual: float = -np.inf

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities of each text, without features the calibrated prior; and how usual its runs of four characters are."""
        out, usual = np.zeros((len(offsets) - 1, len(self.classes))), np.zeros(len(offsets) - 1)
        for i, j in spans.runs(offsets, _CHUNK):
            out[i:j], usual[i:j] = self.raw(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        return _softmax(out * self.scale + self.shift), usual

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, n = np.zeros((len(offsets) - 1, len(self.classes))), np.zeros(len(offsets) - 1)
        usual = np.zeros(len(offsets) - 1)
        for rows, first in features(data, offsets, self.lower):
            n += np.diff(first)
            for c in range(len(self.classes)):
                total[:, c] += spans.sums(self.logits[c][rows], first)
            if self.usual is not None and len(rows) and rows[0] >> _BITS == _USUAL:
                at = rows - (_USUAL << _BITS)
                sums = [spans.sums(u[at].astype(float), first) for u in self.usual]
                usual = np.max(sums, axis=0) / (np.diff(first) + _SHRINK)
        return total / np.maximum(n, 1)[:, None], usual


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _usual(bags: list, y: np.ndarray, fit: np.ndarray, test: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Model.usual of the fitted texts, and its level from the held-back ones.

    The level lies midway between the least of the held-back texts (the 0.001 quantile) and the median that the same
    texts reach without the class that they are of, which stands for a language not learned.
    """
    def runs_of_four(bag: tuple) -> tuple[np.ndarray, np.ndarray]:
        of = bag[0] >> _BITS == _USUAL
        return bag[0][of] - (_USUAL << _BITS), bag[1][of]

    counts = np.zeros((k, 1 << _BITS))
    for b in fit:
        at, n = runs_of_four(bags[b])
        counts[y[b], at] += n
    usual = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True))
    parts = [runs_of_four(bags[b]) for b in test]
    sums, size = np.array([usual[:, at] @ n for at, n in parts]), np.array([n.sum() for _, n in parts], float)
    for c in range(k):
        own = y[test] == c
        mean = sums[own, c].sum() / size[own].sum() if size[own].sum() else (counts[c] @ usual[c]) / max(counts[c].sum(), 1)
        usual[c] -= mean
        sums[:, c] -= mean * size
    sums = sums[size > 0] / (size[size > 0] + _SHRINK)[:, None]
    if not len(sums):
        return usual.astype(np.float32), -np.inf
    low = float(np.quantile(sums.max(axis=1), 0.001))
    sums[np.arange(len(sums)), y[test][size > 0]] = -np.inf
    foreign = float(np.median(sums.max(axis=1))) if k > 1 else low - 2
    return usual.astype(np.float32), min(low, (low + foreign) / 2)


def _bag(text: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    found = [rows for rows, _ in features(data, np.array([0, len(data)]), lower)]
    rows, count = np.unique(np.concatenate(found), return_counts=True)
    return rows, count


def train(texts: list[str], labels: list, prior: dict, lower: bool, dim: int = 16, epochs: int = 8, rate: float = 8.0, seed: int = 11) -> Model:
    """Fit on four fifths of the texts, calibrate temperature, prior and rejection on the rest."""
    classes = sorted(set(labels))
    y = np.array([classes.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    table = ((rng.random((_BLOCKS << _BITS, dim), dtype=np.float32) - 0.5) / dim).astype(np.float32)
    out = (rng.standard_normal((dim, len(classes))) * 0.1).astype(np.float32)
    counted = [_bag(t, lower) for t in texts]
    bags = [(rows, (count / max(count.sum(), 1)).astype(np.float32)) for rows, count in counted]
    held = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~held | (len(y) < 50))
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(fit):
            rows, w = bags[k]
            lr, step = rate * (1 - step / steps), step + 1
            v = w @ table[rows]
            g = _softmax(v @ out)
            g[y[k]] -= 1
            back = out @ g
            out -= np.float32(lr * 0.02) * np.outer(v, g)
            table[rows] -= np.float32(lr) * w[:, None] * back
    logits = np.ascontiguousarray((table @ out).T)
    test = np.flatnonzero(held) if held.sum() >= 20 else np.arange(len(y))
    raw = np.array([logits[:, bags[k][0]] @ bags[k][1] for k in test])
    share = np.log(np.array([max(prior.get(c, 0), 1) for c in classes], float))
    had = np.log(np.maximum(np.bincount(y, minlength=len(classes)), 1.0))
    shift = (share - share.max()) - (had - had.max())
    weight = np.exp(shift)[y[test]]
    scales = np.geomspace(0.05, 20, 120)
    loss = [-(weight * np.log(np.maximum(_softmax(raw * s + shift)[np.arange(len(test)), y[test]], 1e-12))).sum() for s in scales]
    model = Model(classes, logits, float(scales[int(np.argmin(loss))]), shift, lower)
    p = _softmax(raw * model.scale + shift)
    right = p.argmax(axis=1) == y[test]
    model.reject_below = min(0.4, float(np.quantile(p.max(axis=1)[right], 0.001)) * 0.8) if right.any() else 0.0
    model.usual, model.least_usual = _usual(counted, y, fit, test, len(classes))
    return model


def _cell(column: str) -> Column:
    """Rank of a hashed id on a logarithmic scale, 64 steps to a doubling; no two ids swap their order."""
    above = F.shiftrightunsigned(hashed_rank(column, 5).bitwiseXOR(F.lit(-(1 << 63))), 1)
    return F.floor(F.log2(above + F.lit(1.0)) * 64).cast("int")


def sample_ids(of: DataFrame, per_class: int) -> tuple[list, dict]:
    """([(id, label)], rows by label): of each label the ``per_class`` different ids of least hash.

    of: id, label. A count by label and logarithmic range of hashes, a few thousand rows a label, tells how far to read;
    copies of an id are combined before any shuffle, and where they leave too few ids, the range grows. So what is
    ranked is little more than what is kept, however many rows a label or an id has.
    """
    of = of.where("id is not null and label is not null").withColumn("cell", _cell("id"))
    kind = of.schema["label"].dataType.simpleString()
    counts = of.groupBy("label", "cell").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("cell"))
    order = Window.partitionBy("label").orderBy(hashed_rank("id", 5), "id")
    target = per_class
    while True:
        last = F.coalesce(F.min(F.when(F.col("upto") >= target, F.col("cell"))), F.max("cell"))
        ends = counts.withColumn("upto", upto).groupBy("label").agg(last.alias("last"), F.max("cell").alias("top"), F.sum("n").alias("n")).collect()
        if not ends:
            return [], {}
        cut = of.sparkSession.createDataFrame([(r["label"], r["last"]) for r in ends], f"label {kind}, last int")
        near = of.join(F.broadcast(cut), "label").where(F.col("cell") <= F.col("last")).select("id", "label").distinct()  # one row a label
        ids = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class).select("id", "label").collect()
        have = Counter(r["label"] for r in ids)
        if all(have[r["label"]] >= per_class or r["last"] == r["top"] for r in ends):
            return [(r["id"], r["label"]) for r in ids], {r["label"]: r["n"] for r in ends}
        target *= 16


def fit_frame(docs: DataFrame, allowed: Column, label: str, lower: bool, id_col: str, text_col: str, labels: DataFrame | None = None, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model of ``label``, learned from the allowed rows of docs, or of docs joined with labels; None without any.

    What reaches the driver is bounded by ``per_class`` texts of each class, one for each id (the least text where
    rows share an id), and by ``sample_bytes`` in all. Rows without an id teach nothing.
    """
    named = (docs if labels is None else labels).where(allowed & F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    ids, prior = sample_ids(named if labels is None else named.distinct(), per_class)
    if not ids:
        return None
    kinds = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, kinds))  # per_class rows a class
    keys = ["id"] if labels is not None else ["id", "label"]
    texts = docs if labels is not None else docs.where(allowed & F.col(label).isNotNull())
    texts = texts.select(F.col(id_col).alias("id"), *([] if labels is not None else [F.col(label).alias("label")]), F.coalesce(text_col, F.lit("")).alias("text"))
    share = sample_bytes // len(prior)
    texts = texts.where(F.octet_length("text") <= share // 16).join(chosen, keys).groupBy("id", "label").agg(F.min("text").alias("text"))
    read = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(hashed_rank("id", 5), "id"))
    picked = texts.withColumn("read", read).where(F.col("read") <= share).select("id", "label", "text").toArrow()
    if not picked.num_rows:
        return None
    picked = picked.sort_by([("id", "ascending"), ("label", "ascending")])
    mixed = np.random.default_rng(2).permutation(picked.num_rows)
    got = picked.take(pa.array(mixed))
    return train(got["text"].to_pylist(), got["label"].to_pylist(), prior, lower)


def probability_frame(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """All columns of docs, ``__p``, the list of class probabilities in order of model.classes, and ``__usual``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    names = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = spans.text_column(batch.column(text_col))
            for i, j in spans.runs(offsets, _OUT):  # small batches out: the JVM holds them beside those that go in
                p, usual = shared.value.probabilities(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, lists, pa.array(usual)], [*names, "__p", "__usual"])
            del batch, data, offsets
        spans.released()

    return docs.mapInArrow(run, docs.limit(0).withColumns({"__p": F.lit(None).cast("array<double>"), "__usual": F.lit(None).cast("double")}).schema)
