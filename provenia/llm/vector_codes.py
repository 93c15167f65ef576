"""Product codes of vectors: a codebook for each part, fitted by Lloyd rounds that shuffle changes alone.

Components are integers (floor of ``SCALE`` times the value) and so is all arithmetic, so results do not depend on the order
of rows or tasks. Each round reads the parts with their assignments of the round before from the shared folder, writes
them with the new ones, and sends only what changed: a part that moved is taken off its old entry and put on its new
one. Tasks sum these changes by (part, entry) before the shuffle, so a task sends at most parts * entries rows; they are
added to running integer sums, from which the next codebooks follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.shared import Workspace

SCALE = 1024
#: Components of codes lie within these, so that sums of squares fit 64 bits.
LIMIT = 1 << 25
_BLOCK = 8192
_SUMS = "part int, entry int, n long, total array<long>"


def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(floor(SCALE x) of all components on end, offsets, which vectors are whole: not null, and all components finite)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(column) else column.values.slice(0, 0)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    good = np.isfinite(values)
    offsets = offsets - offsets[0]
    bad = np.concatenate([[0], np.cumsum(~good)])
    whole = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.floor(np.where(good, values, 0.0) * SCALE)
    return scaled, offsets, whole


def _floored(column: str):  # noqa: ANN202
    """Batches with __v (floor(SCALE x); null where a component is beyond LIMIT) for rows whose vector is whole."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index(column)
            scaled, offsets, whole = _integers(batch.column(at))
            far = np.concatenate([[0], np.cumsum(np.abs(scaled) >= LIMIT)])
            fits = far[offsets[1:]] == far[offsets[:-1]]
            size = np.where(fits, np.diff(offsets), 0)
            inside = np.repeat(fits, np.diff(offsets))
            bounds = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(~fits, False))
            v = pa.ListArray.from_arrays(bounds, pa.array(scaled[inside].astype(np.int32)))
            others = [batch.column(k) for k in range(batch.num_columns) if k != at]
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*others, v], [*names, "__v"]).filter(pa.array(whole))

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(len(column), width)


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, the lower index of equal ones; exact.

    |v|^2 is left out of the comparison. Products are summed in double precision where all of them are below 2^53, and as
    64-bit integers else.
    """
    v, book = v.astype(np.int64), book.astype(np.int64)
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * v.shape[1] * most * most < 1 << 53 else np.int64
    half, norm = (-2 * book.T).astype(kind), (book * book).sum(1).astype(kind)
    index = np.empty(len(v), np.int32)
    for a in range(0, len(v), _BLOCK):
        index[a : a + _BLOCK] = (v[a : a + _BLOCK].astype(kind) @ half + norm).argmin(1)
    gap = v - book[index]
    return index, (gap * gap).sum(1)


def assigned(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances) of all parts of all rows; books: part, entry, position."""
    width = books.shape[2]
    found = [nearest(v[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def _assign(books: np.ndarray):  # noqa: ANN202
    """Batches with __was, the assignments until now, and __now, those by these codebooks."""
    parts, _, width = books.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                now, _ = assigned(_matrix(batch.column("__v"), parts * width), books)
                bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * parts)
                was = batch.schema.get_field_index("__now")
                columns = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] not in ("__was", "__now")]
                names = [n for n in batch.schema.names if n not in ("__was", "__now")]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(was), pa.ListArray.from_arrays(bounds, pa.array(now.ravel()))], [*names, "__was", "__now"])

    return run


def _changes(parts: int, entries: int, width: int):  # noqa: ANN202
    """(part, entry, n, total) of a task: what moved parts add to their new entries and take off their old ones."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in it:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("__v"), parts * width).astype(np.int64).reshape(batch.num_rows, parts, width)
            was, now = (_matrix(batch.column(c), parts) for c in ("__was", "__now"))
            row, part = np.nonzero(was != now)
            for sign, side in ((1, now), (-1, was)):
                entry = side[row, part]
                some = entry >= 0
                at = part[some] * entries + entry[some]
                np.add.at(n, at, sign)
                np.add.at(total, at, sign * v[row[some], part[some]])
        used = np.flatnonzero((n != 0) | (total != 0).any(1))
        if len(used):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), pa.array(total[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(n[used]), lists], ["part", "entry", "n", "total"])

    return run


def _coded(books: np.ndarray):  # noqa: ANN202
    """Batches with __code, two hex digits a part, and __error, the squared distances summed over parts."""
    parts, _, width = books.shape
    hexes = np.array([f"{k:02x}" for k in range(256)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                index, distance = assigned(_matrix(batch.column("__v"), parts * width), books)
                code = ["".join(x) for x in hexes[index].tolist()]
                keep = [k for k, name in enumerate(batch.schema.names) if name not in ("__v", "__was", "__now")]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(code), pa.array(distance.sum(1))], [*(batch.schema.names[k] for k in keep), "__code", "__error"])

    return run


def _summed(vector: str, width: int) -> Column:
    """Element-wise sum of arrays of one length, summed before the shuffle."""
    return F.array(*(F.sum(F.get(vector, F.lit(k))) for k in range(width))).alias(vector)


def _moved(spark, rows: DataFrame, books: np.ndarray) -> DataFrame:  # noqa: ANN001
    """Summed changes (part, entry, n, total) of all tasks; rows whose parts all stayed are left out by the scan."""
    parts, entries, width = books.shape
    changed = rows.where(~F.col("__was").eqNullSafe(F.col("__now"))).select("__v", "__was", "__now")
    return changed.mapInArrow(_changes(parts, entries, width), _SUMS).groupBy("part", "entry").agg(F.sum("n").alias("n"), _summed("total", width))


def fit(rows: DataFrame, first: np.ndarray, rounds: int, work: Workspace) -> tuple[DataFrame, np.ndarray]:
    """(rows with their assignments, codebooks) after ``rounds`` rounds from the codebooks ``first``; ends when nothing moves.

    rows: __v and any other columns. The codebooks, of fixed size, go with the tasks; so do the sums to the driver.
    """
    books, spark = first.copy(), rows.sparkSession
    parts, entries, width = books.shape
    none = F.array(*[F.lit(-1)] * parts)
    now, sums = rows.withColumn("__was", none).withColumn("__now", none), None
    for _ in range(rounds):
        new, _ = work.save(now.mapInArrow(_assign(books), now.schema), "assigned")
        if sums is not None:
            work.drop(now)
        now, delta = new, _moved(spark, new, books)
        both = delta if sums is None else sums.unionByName(delta)
        before = sums
        sums, moved = work.save(both.groupBy("part", "entry").agg(F.sum("n").alias("n"), _summed("total", width)), "sums")
        if before is not None:
            work.drop(before)
        old = books.copy()
        for s in sums.where("n > 0").collect():  # parts * entries rows at most
            books[s.part, s.entry] = [t // s.n for t in s.total]
        if (old == books).all():
            break
    return now, books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of each vector, null ones and such with null or non-finite components left out.

    A vector's components become floor(1024 x) and are cut into ``parts`` equal parts. Each part's codebook starts as
    that part of the ``entries`` vectors of smallest id, ascending (equal ids by their components, null ids last); each
    round assigns every part to the nearest entry and replaces entries by the means, rounded down, of their parts. code:
    indexes in hex; error: the squared distances summed over parts; label_error: error summed over all rows of the
    label, null labels together.

    Repeated rows are coded each. No vectors give no rows, and fewer vectors than ``entries`` give smaller codebooks.
    Vectors of another length than most (longer ones of equally frequent lengths win), or with a component beyond
    2^15 in size, cannot be coded: code and error are null, and they count for nothing else. A length that ``parts``
    does not divide is an error. Other columns take no part.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "codes")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("__x"))
    schema = rows.select("id", "label", F.lit(None).cast("array<int>").alias("__v")).schema
    rows, _ = work.save(rows.mapInArrow(_floored("__x"), schema), "vectors")
    lengths = rows.where("__v IS NOT NULL").groupBy(F.size("__v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    out = "id {0}, label {1}, code string, error long, label_error long, codebooks_sha256 string".format(*(rows.schema[c].dataType.simpleString() for c in ("id", "label")))
    digest = lambda books: hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    if lengths is None:
        none = rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return none.withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.lit(digest(np.zeros(0, int)))).to(spark.createDataFrame([], out).schema)
    if lengths["size"] % parts or not lengths["size"]:
        raise ValueError(f"vectors of length {lengths['size']} cannot be cut into {parts} equal parts")
    width = lengths["size"] // parts
    fits = F.coalesce(F.size("__v") == parts * width, F.lit(False)) & F.col("__v").isNotNull()
    head = rows.where(fits).orderBy(F.asc_nulls_last("id"), "__v").limit(entries).select("__v").collect()
    first = np.array([h[0] for h in head], np.int64).reshape(len(head), parts, width).transpose(1, 0, 2)
    now, books = fit(rows.where(fits), first, rounds, work)
    schema = now.select("id", "label", F.lit("").alias("__code"), F.lit(0).cast("long").alias("__error")).schema
    coded = now.mapInArrow(_coded(books), schema).select("id", "label", F.col("__code").alias("code"), F.col("__error").alias("error"))
    odd = rows.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded, _ = work.save(coded.unionByName(odd), "coded")
    work.drop(now)
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    return joined.withColumn("codebooks_sha256", F.lit(digest(books)))
