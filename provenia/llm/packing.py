"""Packing of documents into fixed windows by minimum bin slack.

A document's tokens fill whole windows first; what remains of it goes to the task's pool. From the pool, each window is
filled by minimum bin slack (Gupta and Ho, 1999): the longest remainder is set, and over the multiset of the remaining
lengths a bitset subset-sum dynamic program finds the sum closest to what is left; how many of each length are taken is
found by backtracking. While the pool is large, windows come out full. When the input of a task ends, a window that
stays short is closed by cutting the longest remainder left, and what does not fill a window at last is dealt to
windows whose lengths are powers of two, which need no padding.

Tasks pack the partition that they read: nothing is shuffled, and the pool holds at most ``POOL`` remainders.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm import spans
from provenia.llm.merges import CHECKED, Memory, PairTable, side_by_side

WINDOW = 1024
POOL = 4096
_PART = 1 << 20
_CHECK_EVERY = 200
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


# ---------------------------------------------------------------- byte-level tokens


class Classes:
    """Letter, number, white space or other of each character, as the tokenizer's own pre-tokeniser has it.

    The library cuts texts in which each character in question stands behind a letter and behind a digit: it joins the
    one, the other, the sign after it, or nothing. Asked once for each character that is met.
    """

    def __init__(self, library: object) -> None:
        self.library = library
        self.known = np.zeros(0x110000, np.int8) - 1

    def of(self, points: np.ndarray) -> np.ndarray:
        kind = self.known[points]
        if len(points) and kind.min() < 0:
            self._ask(np.unique(points[kind < 0]))
            kind = self.known[points]
        return kind

    def _ask(self, points: np.ndarray) -> None:
        for lo in range(0, len(points), 1 << 12):
            some = points[lo : lo + (1 << 12)].tolist()
            probe = "".join(f"a{chr(c)}!1{chr(c)}!" for c in some)
            begins = {a for _, (a, _) in self.library.pre_tokenizer.pre_tokenize_str(probe)}
            for k, c in enumerate(some):
                at = 6 * k
                if at + 1 not in begins:
                    kind = _LETTER
                elif at + 4 not in begins:
                    kind = _NUMBER
                elif at + 2 not in begins and c != 32:
                    kind = _OTHER
                else:
                    kind = _SPACE
                self.known[c] = kind


def pretokens(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level pre-tokenisation begin, as positions in ``points``. kind: see Classes.

    Runs of letters, numbers or other characters, each with one space before it; English contractions; white space.
    """
    begin = np.ones(len(points), bool)
    begin[1:] = kind[1:] != kind[:-1]
    edge = first[first < len(points)]
    begin[edge] = True
    fresh = np.zeros(len(points), bool)
    fresh[edge] = True
    after = np.flatnonzero(begin[1:] & ~fresh[1:] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
    begin[after - 1] = True
    begin[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero(begin & (points == 39))
    quote = quote[quote + 1 < len(points)]
    quote = quote[~fresh[quote + 1]]
    wide = np.concatenate([points, np.zeros(3, points.dtype)])
    new = np.concatenate([fresh, np.ones(3, bool)])
    a, b = wide[quote + 1], np.where(new[quote + 2], 0, wide[quote + 2])
    short = np.isin(a, [ord(c) for c in "stmd"])
    long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for some, size in ((quote[short], 2), (quote[long], 3)):
        begin[some + 1] = False
        rest = some + size
        rest = rest[rest < len(points)]
        begin[rest[kind[rest] == _LETTER]] = True
    return np.flatnonzero(begin)


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and back."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of whole texts by a byte-level merge vocabulary of the tokenizers library.

    Each different pre-token of a part is merged once, and remembered. Texts that hold the literal of an added token go
    to the library. One in CHECKED of the different pre-tokens is compared with the library when it is merged, and one text in
    _CHECK_EVERY as a whole; a difference is an error.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        whole = json.loads(self.library.to_str())
        model = whole["model"]
        self.added = [t["content"].encode() for t in whole["added_tokens"]]
        ids = model["vocab"]
        self.byte_id = np.zeros(256, np.int32)
        for c, b in _byte_characters().items():
            self.byte_id[b] = ids[c]
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            pairs[ids[x], ids[y]] = (rank, ids[x + y])
        self.table, self.memory, self.classes = PairTable(pairs), Memory(), Classes(self.library)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _holds_added(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Whether the literal of an added token begins in each text."""
        out = np.zeros(len(offsets) - 1, bool)
        for literal in self.added:
            at = raw.find(literal)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                out[k] = True
                at = raw.find(literal, int(offsets[k + 1]))
        return out

    def _check(self, raw: bytes, starts: np.ndarray, size: np.ndarray, merged: np.ndarray, first: np.ndarray, h: np.ndarray) -> None:
        """Compare the ids of one pre-token in CHECKED, by hash, with the library's."""
        some = np.flatnonzero(h % CHECKED == 0)
        texts = [raw[a : a + n].decode() for a, n in zip(starts[some].tolist(), size[some].tolist(), strict=True)]
        for k, text, want in zip(some.tolist(), texts, self._library(texts), strict=True):
            if merged[first[k] : first[k + 1]].tolist() != want:
                raise ValueError(f"ids differ from those of the tokenizers library: {text[:200]!r}")

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first of each text)."""
        texts = len(offsets) - 1
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(lead, offsets)
        strange = self._holds_added(raw, offsets)
        whole = {k: self._library([raw[offsets[k] : offsets[k + 1]].decode()])[0] for k in np.flatnonzero(strange).tolist()}
        begin = pretokens(points, self.classes.of(points), first)
        starts = lead[begin]
        size = np.diff(starts, append=len(data))
        h = spans.xxh64(data, starts, starts + size, 5)
        fresh, of = self.memory.find(h, size)
        symbols = self.byte_id[data[np.repeat(starts[fresh], size[fresh]) + spans.spread(size[fresh])]]
        merged, kept = side_by_side(symbols, np.concatenate([[0], np.cumsum(size[fresh])]), self.table)
        self._check(raw, starts[fresh], size[fresh], merged, kept, h[fresh])
        flat, head, count = self.memory.complete(h, size, fresh, of, merged, kept)
        ids = flat[np.repeat(head, count) + spans.spread(count)].astype(np.uint32)
        bounds = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(begin, first)]
        if whole:
            parts = [np.array(whole[k], np.uint32) if k in whole else ids[bounds[k] : bounds[k + 1]] for k in range(texts)]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        for k in range(0, texts, _CHECK_EVERY):
            text = raw[offsets[k] : offsets[k + 1]].decode()
            if ids[bounds[k] : bounds[k + 1]].tolist() != self._library([text])[0]:
                raise ValueError(f"ids differ from those of the tokenizers library: {text[:200]!r}")
        return ids, bounds


@lru_cache(2)
def encoder(path: str) -> Encoder:
    out = Encoder(path)
    spans.released()  # what the file was parsed into
    return out


# ---------------------------------------------------------------- minimum bin slack


def fill(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """(how many of each length, slack): the longest and the multiset of others whose sum comes closest to capacity.

    Bit s of ``sums`` says that s can be reached. Counts are split into powers of two, so a length with c copies takes
    about log2(c) steps.
    """
    longest = max(counts)
    room = capacity - longest
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        if sums >> room & 1:
            break
        left = min(counts[length] - (length == longest), room // length)
        step = 1
        while left > 0:
            take = min(step, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left -= take
            step *= 2
    best = sums.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    chosen[longest] = 1
    s = best
    for length, take, before in reversed(steps):
        if not before >> s & 1:
            s -= length * take
            chosen[length] += take
    return chosen, room - best


class Packer:
    """Deals token runs to windows. A piece: (document, start, ids, document's tokens, window, offset)."""

    def __init__(self, window: int = WINDOW, pool: int = POOL, first_window: int = 0) -> None:
        self.window, self.pool, self.next = window, pool, first_window
        self.by_length: dict[int, list[tuple]] = defaultdict(list)
        self.counts: dict[int, int] = {}
        self.held = self.tokens = 0
        self.out: list[tuple] = []

    def add(self, doc: object, ids: np.ndarray) -> None:
        n = len(ids)
        for at in range(0, n - self.window + 1, self.window):
            self._close([(doc, at, ids[at : at + self.window], n)])
        if at := n % self.window:
            self._keep((doc, n - at, ids[n - at :].copy(), n))
        if self.held >= self.pool:
            while self.held > self.pool // 2:
                chosen, slack = fill(self.counts, self.window)
                if slack:
                    break
                self._close(self._take(chosen))
            else:
                return
            while self.held >= self.pool and self.tokens >= self.window:  # lengths that do not fit together: cut as at the end
                self._close_short()

    def finish(self) -> None:
        while self.held:
            if self.tokens < self.window:
                return self._powers()
            self._close_short()

    def _close_short(self) -> None:
        chosen, slack = fill(self.counts, self.window)
        items = self._take(chosen)
        while slack and self.held:
            doc, start, ids, n = self._take({max(self.counts): 1})[0]
            cut = min(slack, len(ids))
            items.append((doc, start, ids[:cut], n))
            if cut < len(ids):
                self._keep((doc, start + cut, ids[cut:], n))
            slack -= cut
        self._close(items)

    def _powers(self) -> None:
        """The last tokens of a task, fewer than a window: windows of 512, 256, ... tokens."""
        items = self._take(dict(self.counts))
        total = sum(len(x[2]) for x in items)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            now = []
            while size:
                doc, start, ids, n = items.pop(0)
                now.append((doc, start, ids[:size], n))
                if len(ids) > size:
                    items.insert(0, (doc, start + size, ids[size:], n))
                size -= len(now[-1][2])
            self._close(now)

    def _keep(self, item: tuple) -> None:
        n = len(item[2])
        self.by_length[n].append(item)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.held += 1
        self.tokens += n

    def _take(self, chosen: dict[int, int]) -> list[tuple]:
        got = []
        for n, c in chosen.items():
            for _ in range(c):
                got.append(self.by_length[n].pop())
            self.counts[n] -= c
            self.held -= c
            self.tokens -= n * c
            if not self.counts[n]:
                del self.counts[n], self.by_length[n]
        return got

    def _close(self, items: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in items:
            self.out.append((doc, start, ids, n, self.next, offset))
            offset += len(ids)
        self.next += 1


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, pool: int = POOL) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text with ``end_id`` behind; each lies in exactly one piece. ids holds a
    piece's ids as little-endian unsigned 32-bit numbers. A null or empty text is the end id alone. Rows that repeat,
    also with the same id, are packed each on its own; a null id stays null. sequence_id is the partition's number
    times 2^40 plus a counter, so no sequence spans two tasks. Other columns are ignored; no rows give no rows.
    """
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, pool, TaskContext.get().partitionId() << 40)
        tokens = encoder(tokenizer_path)

        def emit() -> pa.RecordBatch:
            doc, start, ids, n, seq, offset = zip(*packer.out, strict=True) if packer.out else ((),) * 6
            packer.out = []
            cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            cols += [pa.array(x, pa.int64()) for x in (n, seq, offset)]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in it:
            data, offsets = spans.text_column(batch.column("text"))
            names = batch.column("id").to_pylist()
            for i, j in spans.runs(offsets, _PART):
                ids, first = tokens.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                full = np.full(len(ids) + j - i, end_id, "<u4")
                first = first + np.arange(j - i + 1)
                own = np.ones(len(full), bool)
                own[first[1:] - 1] = False
                full[own] = ids
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    packer.add(names[i + k], full[a:b])
                yield emit()
            del batch, data, offsets
        packer.finish()
        yield emit()
        spans.released()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, schema)
