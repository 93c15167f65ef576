"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding is a score-ordered agenda of adjacent symbol pairs: of all pairs that form a piece, the one of highest score
is merged first, the leftmost of equal ones, until none is left; symbols that are no piece fall back to bytes.

No piece holds a space mark behind another character, so merges never reach over the beginning of a run of spaces; nor
do they touch characters that only occur as pieces of their own. Texts are cut there into chunks, and each different
chunk of a part of an Arrow batch is encoded once and remembered. All chunks of like length run their agendas side by side in numpy;
very long chunks use a heap. One in ``CHECKED`` of the different chunks is compared with the sentencepiece library when it
is encoded, and one text in ``_CHECK_EVERY`` of each part as a whole; a difference is an error, and so is a vocabulary of
another type.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm import spans
from provenia.llm.merges import CHECKED, Memory, PairTable, side_by_side

_PART = 1 << 20
_CHECK_EVERY = 50
_MARK = "▁"


class Codec:
    """A merge-type sentencepiece model, with lookup tables for the agenda and for decoding."""

    def __init__(self, path: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.eos, self.n = sp.eos_id(), n
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(pieces[i][3:5], 16)] = i
        symbol = {pieces[i]: i for i in plain}
        for i in plain:  # characters that only occur inside pieces get numbers from n on
            for c in pieces[i]:
                symbol.setdefault(c, n + len(symbol))
        look: dict[tuple[int, int], tuple[int, int]] = {}
        rank = {score: k for k, score in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        for i in plain:
            p = pieces[i]
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    look[symbol[p[:k]], symbol[p[k:]]] = (rank[sp.get_score(i)], i)
        self.table, self.memory = PairTable(look), Memory()
        if any(_MARK in pieces[i].lstrip(_MARK) for i in plain):
            raise ValueError(f"{path}: pieces hold a space mark behind another character, so texts cannot be cut at spaces")
        self.char = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.char[32] = self.char[ord(_MARK)]
        joint = {c for i in plain if len(pieces[i]) > 1 for c in pieces[i]}
        self.alone = np.array([b < 32 and chr(b) not in joint for b in range(256)])
        decoded = [b""] * n
        for i in plain:
            decoded[i] = pieces[i].replace(_MARK, " ").encode()
        for b in range(256):
            decoded[self.byte_id[b]] = bytes([b])
        self.piece_size = np.array([len(x) for x in decoded], np.int64)
        self.piece_first = np.concatenate([[0], np.cumsum(self.piece_size)])
        self.piece_bytes = np.frombuffer(b"".join(decoded), np.uint8)

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of chunks: each begins with the spaces before it; a text's edges always part chunks."""
        space = data == 32
        alone = self.alone[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first of each text) without the end id."""
        # An own copy: a space before each text that is not empty, and plain spaces for typed space marks.
        texts = [bytes(data[a:b]).replace(_MARK.encode(), b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        data = np.frombuffer(b"".join(b" " + t for t in texts if t), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts])])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts, ends = self._chunks(data, offsets)
        size = ends - starts
        h = spans.xxh64(data, starts, ends, 9)
        fresh, of = self.memory.find(h, size)
        raw = data[np.repeat(starts[fresh], size[fresh]) + spans.spread(size[fresh])]
        lead = (raw & 0xC0) != 0x80
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lead)])[np.concatenate([[0], np.cumsum(size[fresh])])]
        symbols = self.char[points]
        symbols = np.where(symbols < 0, self.n + (1 << 20) + points, symbols).astype(np.int32)
        ids, kept = self._fall_back(*side_by_side(symbols, first, self.table))
        self._check(raw.tobytes(), size[fresh], ids, kept, h[fresh])
        flat, head, count = self.memory.complete(h, size, fresh, of, ids, kept)
        out = flat[np.repeat(head, count) + spans.spread(count)]
        per_chunk = np.concatenate([[0], np.cumsum(count)])
        return out, per_chunk[np.searchsorted(starts, offsets)]

    def _check(self, raw: bytes, size: np.ndarray, ids: np.ndarray, first: np.ndarray, h: np.ndarray) -> None:
        """Compare the ids of one chunk in CHECKED, by hash, with the library's, behind a line end that it cannot be merged with."""
        if not self.alone[10]:
            return
        before = len(self.library.encode("\n"))
        some = np.flatnonzero(h % CHECKED == 0)
        ends = np.cumsum(size)
        texts = [raw[a:b].decode() for a, b in zip((ends - size)[some].tolist(), ends[some].tolist(), strict=True)]
        for k, text, want in zip(some.tolist(), texts, self.library.encode(["\n" + t for t in texts], num_threads=1), strict=True):
            if ids[first[k] : first[k + 1]].tolist() != want[before:]:
                raise ValueError(f"pieces differ from those of the sentencepiece library: {text[:200]!r}")

    def _fall_back(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes for symbols that are no piece."""
        strange = np.flatnonzero(symbols >= self.n)
        if not len(strange):
            return symbols, first
        names = {int(v): c for c, v in enumerate(self.char.tolist()) if v >= self.n} if (symbols[strange] < self.n + (1 << 20)).any() else {}
        count = np.ones(len(symbols), np.int64)
        parts = []
        for k in strange.tolist():
            v = int(symbols[k])
            b = self.byte_id[list(chr(v - self.n - (1 << 20) if v >= self.n + (1 << 20) else names[v]).encode())]
            count[k] = len(b)
            parts.append(b)
        at = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        plain = np.ones(len(symbols), bool)
        plain[strange] = False
        out[at[plain]] = symbols[plain]
        sizes = count[strange]
        out[np.repeat(at[strange], sizes) + spans.spread(sizes)] = np.concatenate(parts)
        return out, np.append(at, len(out))[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, first of each text): pieces joined, space marks as spaces, the space before a text taken off."""
        size = self.piece_size[ids]
        data = self.piece_bytes[np.repeat(self.piece_first[ids], size) + spans.spread(size)]
        offsets = np.concatenate([[0], np.cumsum(size)])[first]
        begin = offsets[:-1][offsets[:-1] < offsets[1:]]
        keep = np.ones(len(data), bool)
        keep[begin[data[begin] == 32]] = False
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with the end id, by the agenda alone."""
        data, offsets = spans.text_column(pa.array(texts, pa.string()))
        ids, first = self.encode(data, offsets)
        return [[*ids[a:b].tolist(), self.eos] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


@lru_cache(4)
def codec(path: str) -> Codec:
    out = Codec(path)
    spans.released()  # what the file was parsed into
    return out


def _part(c: Codec, data: np.ndarray, offsets: np.ndarray, number: int) -> tuple[pa.Array, pa.Array]:
    """(ids, decoded) of the texts of a part."""
    n = len(offsets) - 1
    ids, first = c.encode(data, offsets)
    flat, bounds = c.decode(ids, first)
    for k in range(number % _CHECK_EVERY % max(n, 1), n, _CHECK_EVERY):
        text = bytes(data[offsets[k] : offsets[k + 1]]).decode()
        want = c.library.encode(text)
        if want != ids[first[k] : first[k + 1]].tolist() or c.library.decode(want) != bytes(flat[bounds[k] : bounds[k + 1]]).decode(errors="replace"):
            raise ValueError(f"pieces differ from those of the sentencepiece library: {text[:200]!r}")
    count = np.diff(first) + 1
    bounds32 = np.concatenate([[0], np.cumsum(count)])
    out = np.full(int(bounds32[-1]), c.eos, np.int32)
    out[np.repeat(bounds32[:-1], count - 1) + spans.spread(count - 1)] = ids
    decoded = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(bounds32.astype(np.int32)), pa.array(out)), decoded


def encode_and_decode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ids (array<int>, the end id last) and decoded (the text of these ids).

    A null or empty text has the end id alone and decodes to an empty text. Whole texts are encoded, whatever their
    length. Rows that repeat or tie give repeated results; no rows give no rows. Other columns stay as they are; those
    named ids or decoded are replaced.
    """
    docs = docs.drop("ids", "decoded")
    names = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in it:
            data, offsets = spans.text_column(batch.column(text_col))
            for i, j in spans.runs(offsets, _PART):
                ids, decoded = _part(c, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
                yield pa.RecordBatch.from_arrays([*(x.slice(i, j - i) for x in batch.columns), ids, decoded], [*names, "ids", "decoded"])
            del batch, data, offsets
        spans.released()

    return docs.mapInArrow(run, docs.limit(0).withColumns({"ids": F.lit(None).cast("array<int>"), "decoded": F.lit("")}).schema)
