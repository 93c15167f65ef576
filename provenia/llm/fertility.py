"""Quality rules by how public tokenizers take a text: characters per token, share of byte fallback, entropy of tokens.

Text unlike the prose of its language falls into more and shorter tokens, into bytes, or into few tokens again and
again. Each measure is an integer (thousandths), so that its distribution over all documents of a language and of a script is
an exact histogram; the bands are its median and a number of median deviations around it, which a third of all rows,
all of one kind, does not shift far. A language with too few documents is judged by the bands of its script.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm import spans
from provenia.llm.packing import encoder
from provenia.llm.piece_codec import codec
from provenia.llm.shared import Workspace

#: Blocks of letters by script, first and last code point. Fixed values.
SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x531, 0x58F), ("hebrew", 0x5D0, 0x5F4), ("arabic", 0x620, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3041, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF),
]
_NAMES = ["none", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
_BEGINS = np.array([b for _, a, z in SCRIPTS for b in (a, z + 1)])
_CLASS = np.array([0, *(k for name, _, _ in SCRIPTS for k in (_NAMES.index(name), 0))])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that begin a letter, a digit or a character beyond ASCII: the characters that fertility counts.
_PROSE = np.array([chr(b).isalnum() if b < 128 else b >= 0xC0 for b in range(256)])

#: Least words of a document, and the greatest percentage of words in repeated three-word windows.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Tokens of a window over which entropy is taken, at least; a shorter text is one window.
WINDOW = 256
_PART = 1 << 20

#: Measure -> whether values below and above its band reject, and the least half-width of the band: a short text has few bytes to share.
MEASURES = {"chars_per_piece": (True, True, 0), "chars_per_token": (True, True, 0), "byte_share": (False, True, 50), "entropy": (True, False, 0)}
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    seen: dict[tuple, int] = {}
    marked = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:])):  # noqa: B905
        j = seen.setdefault(window, i)
        if j != i:
            marked[i : i + 3] = marked[j : j + 3] = b"\1\1\1"
    return sum(marked)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of _BASE for each text."""
    out = {c: np.zeros(len(offsets) - 1, np.int64) for c in _BASE}
    out["word_chars"] = _per_text(((data & 0xC0) != 0x80) & ~spans.SPACE[data], offsets)
    out["n_symbols"] = _per_text(_SYMBOL[data], offsets)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = data[a:b].tobytes()
        words = text.split()
        lines = [line for line in text.split(b"\n") if line.strip()]
        out["n_words"][k], out["n_dup_lines"][k], out["n_repeat_words"][k] = len(words), len(lines) - len(set(lines)), repeated_words(words)
    return out


def scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The script of most letters of each text, the earlier of SCRIPTS in a tie; none without letters."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    kind = _CLASS[np.searchsorted(_BEGINS, points, "right")]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    counts = np.bincount(text * len(_NAMES) + kind, minlength=(len(offsets) - 1) * len(_NAMES)).reshape(-1, len(_NAMES))
    counts[:, 0] = 0
    return [_NAMES[k] for k in counts.argmax(1)]


def entropies(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Thousandths of the greatest possible entropy, averaged over windows of like length of each text; 1000 without tokens.

    Windows hold WINDOW to twice as many tokens, so the measure does not depend on the length of a longer text.
    """
    size = np.diff(first)
    windows = np.maximum(size // WINDOW, 1)
    base = np.cumsum(windows) - windows
    text = np.repeat(np.arange(len(size)), size)
    window = base[text] + spans.spread(size) * windows[text] // np.maximum(size[text], 1)
    length = np.bincount(window, minlength=int(windows.sum()))
    key, count = np.unique(window.astype(np.int64) << 32 | ids, return_counts=True)
    inner = np.bincount(key >> 32, count * np.log2(count), minlength=len(length))
    most = np.log2(np.maximum(length, 2))
    share = np.where(length > 1, (most - inner / np.maximum(length, 1)) / most, 1.0)
    total = spans.sums(share * length, np.append(base, len(length)))
    return np.round(1000 * np.where(size > 0, total / np.maximum(size, 1), 1.0)).astype(np.int64)


def _part(data: np.ndarray, offsets: np.ndarray, pieces_path: str, bytes_path: str) -> list[pa.Array]:
    base = base_counts(data, offsets)
    c = codec(pieces_path)
    ids, first = c.encode(data, offsets)
    pieces, tokens = np.diff(first), np.diff(encoder(bytes_path).encode(data, offsets)[1])
    is_byte = np.zeros(max(c.n, 1), bool)
    is_byte[[i for i in range(c.n) if c.library.is_byte(i)]] = True
    chars = 1000 * _per_text(_PROSE[data], offsets)
    shares = [chars // np.maximum(pieces, 1), chars // np.maximum(tokens, 1), 1000 * _per_text(is_byte[ids], first) // np.maximum(pieces, 1), entropies(ids, first)]
    return [pa.array(scripts(data, offsets)), *(pa.array(base[x]) for x in _BASE), *map(pa.array, shares)]


def measured(docs: DataFrame, pieces_path: str, bytes_path: str, text_col: str = "text") -> DataFrame:
    """docs with script, the counts of _BASE and the MEASURES in place of the text; null texts count as empty."""
    others = [c for c in docs.columns if c != text_col]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = spans.text_column(batch.column(text_col))
            for i, j in spans.runs(offsets, _PART):
                found = _part(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], pieces_path, bytes_path)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in others), *found], [*others, "script", *_BASE, *MEASURES])
            del batch, data, offsets
        spans.released()

    new = {"script": F.lit("")} | {c: F.lit(0).cast("long") for c in (*_BASE, *MEASURES)}
    return docs.select(*others, text_col).mapInArrow(run, docs.select(*others).limit(0).withColumns(new).schema)


def _median(histogram: DataFrame) -> DataFrame:
    """(key, measure, median, docs) of (key, measure, value, n): the least value that half of the documents do not pass."""
    of = Window.partitionBy("key", "measure")
    summed = histogram.withColumn("until", F.sum("n").over(of.orderBy("value"))).withColumn("docs", F.sum("n").over(of))
    return summed.where("2 * until >= docs AND 2 * (until - n) < docs").select("key", "measure", F.col("value").alias("median"), "docs")


def bands(histogram: DataFrame, width: float = 8.0, least: float = 0.2, min_docs: int = 100) -> DataFrame:
    """(key, low and high of each measure): the median and ``width`` median deviations, or ``least`` of the median or the measure's least half-width if that is wider.

    Keys with fewer than ``min_docs`` documents are left out. histogram: key, measure, value, n; as many rows a key as
    measures have values, whatever the number of documents.
    """
    middle = _median(histogram).where(F.col("docs") >= min_docs).drop("docs")
    away = histogram.join(middle, ["key", "measure"]).withColumn("value", F.abs(F.col("value") - F.col("median")))
    spread = _median(away.groupBy("key", "measure", "value").agg(F.sum("n").alias("n"))).select("key", "measure", F.col("median").alias("away"))
    least_of = F.element_at(F.create_map(*(F.lit(x) for m, (_, _, at_least) in MEASURES.items() for x in (m, at_least))), F.col("measure"))
    half = F.greatest(F.lit(width) * F.col("away"), F.lit(least) * F.col("median"), least_of)
    edges = middle.join(spread, ["key", "measure"]).select("key", "measure", (F.col("median") - half).alias("low"), (F.col("median") + half).alias("high"))
    one = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}")
    return edges.groupBy("key").agg(*(one(m, side) for m in MEASURES for side in ("low", "high")))


def _inside(prefix: str) -> Column:
    """Whether all measures lie inside the bands in the struct ``prefix``; null without bands."""
    tests = [F.col(m) >= F.col(f"{prefix}.{m}_low") for m, (low, _, _) in MEASURES.items() if low] + [F.col(m) <= F.col(f"{prefix}.{m}_high") for m, (_, high, _) in MEASURES.items() if high]
    out = tests[0]
    for t in tests[1:]:
        out &= t
    return out


def fertility_rules(docs: DataFrame, pieces_path: str, bytes_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **band: float) -> DataFrame:
    """(id, counts, base_failed, kept, script, measures) of each document, whole texts whatever their length.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEATED % of them inside repeated three-word windows. The
    others are kept if all measures lie inside the bands of their language, or of their script where the language is
    null or has too few documents (see ``bands`` for the parameters); where both have too few, they are kept. Bands
    are taken over all documents that pass the base rules.

    Null and empty texts have no words and fail. Rows that repeat or tie, with or without an id, are judged alike and
    each counts. No rows give no rows. Columns beside id, text and language take no part.
    """
    work = Workspace(docs.sparkSession, "fertility")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"))
    rows = measured(rows, pieces_path, bytes_path, "__text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows, _ = work.save(rows.withColumn("base_failed", failed), "measured")
    keys = F.array_compact(F.array(F.concat(F.lit("lang "), "__lang"), F.concat(F.lit("script "), "script")))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES)))
    histogram = rows.where("not base_failed").select("*", F.explode(keys).alias("key")).select("key", each.alias("m")).groupBy("key", "m.measure", "m.value").agg(F.count("*").alias("n"))
    found, _ = work.save(bands(work.save(histogram, "histogram")[0], **band), "bands")
    edges = [c for c in found.columns if c != "key"]
    by = lambda kind: found.where(F.col("key").startswith(kind)).select(F.substring("key", len(kind) + 1, 1 << 30).alias(f"__of_{kind.strip()}"), F.struct(*edges).alias(f"__{kind.strip()}_bands"))
    out = rows.join(by("lang "), F.col("__lang") == F.col("__of_lang"), "left").join(by("script "), F.col("script") == F.col("__of_script"), "left")
    inside = F.coalesce(_inside("__lang_bands"), _inside("__script_bands"), F.lit(True))
    return out.select(F.col("__id").alias("id"), *_BASE, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "script", *MEASURES)
