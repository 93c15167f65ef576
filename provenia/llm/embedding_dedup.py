"""Embedding near-dedup by a forest of random-projection trees with spill overlap.

Every tree splits recursively: level by level a random direction, at each node a threshold (the median of the fitted
sample there), and whatever lies within ``spill`` of it goes to both sides. Leaves are compared within, in double
precision, over many trees. Trees are fitted on at most ``SAMPLE`` vectors, the ones of least hashed id; every vector
is indexed. Below the depth that the sample supports, nodes split at the projection of the mean of their last fitted
ancestor, so trees grow with the table without a larger model.

Equal vectors are first reduced to one with a weight. A pair is counted in the first leaf that both share, in order of
tree and leaf, so that no pairs need to be collected: each leaf sends one row per linked vector, with the weight of
its partners and the edge of a local spanning forest.

A dense ball, that is a centre around which the sample holds many vectors within half the threshold's angle, needs no
comparisons inside: any two of its vectors link, by the triangle inequality. Its members are counted by one sum, and any
other vector links with all of them, or with none, or, in the shell in between, is compared with them in blocks dealt
over tasks; a ball with more in its shell than inside is not used. So near-identical vectors cost time in proportion to
their number, even if they are a third of all.
Only vectors outside the balls go through the trees; a direction that cannot part a node's sample does not split it.

Recall: a pair exactly at cosine 0.95 differs in a projection by 0.316/sqrt(d) standard deviations of a unit vector's;
with the default spill a tree of 10 levels keeps it with a chance of about 0.6, eight trees miss it less than once in
1,000. Tests measure recall against brute force.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm import spans
from provenia.llm.components import components
from provenia.llm.shared import Workspace, hashed_rank

SAMPLE = 16_384
_BLOCK = 2048
#: A dense ball holds this share of the sample at least, and so many of its vectors; so there are at most SAMPLE / _FEW.
_DENSE, _FEW = 0.01, 32
#: Members of a ball that a task holds to compare the shell with.
_MEMBERS = 8192
#: Angles this close to a bound are not decided by it but by comparison.
_ROUNDING = 1e-6


class Tree:
    """Directions (levels x d) and thresholds of all nodes, level after level (node k of level l at 2^l - 1 + k)."""

    def __init__(self, sample: np.ndarray, levels: int, spill: float, rng: np.random.Generator) -> None:
        d = sample.shape[1]
        self.spill = spill
        self.directions = rng.standard_normal((levels, d)).astype(np.float32)
        self.directions /= np.linalg.norm(self.directions, axis=1, keepdims=True)
        self.fitted: list[np.ndarray] = []
        groups = [np.arange(len(sample))]
        while len(self.fitted) < levels and len(sample) >= 16 << len(self.fitted):
            z = sample @ self.directions[len(self.fitted)]
            cuts = self._cuts(z, groups, np.median)
            self.fitted.append(cuts)
            groups = [part for g, c in zip(groups, cuts, strict=True) for part in (g[z[g] <= c], g[z[g] > c])]
        # Thresholds of the levels below, one for each node of the last fitted level.
        self.later = [self._cuts(sample @ v, groups, np.mean) for v in self.directions[len(self.fitted) :]]

    def _cuts(self, z: np.ndarray, groups: list[np.ndarray], middle: Callable) -> np.ndarray:
        """Thresholds; where most of a node's sample lies within the overlap, all stays on one side."""
        out = np.full(len(groups), np.inf, np.float32)
        for k, g in enumerate(groups):
            if len(g):
                cut = middle(z[g])
                if 2 * (np.abs(z[g] - cut) <= self.spill).sum() <= len(g):
                    out[k] = cut
        return out

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf of each row of x."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        z = x @ self.directions.T
        for level in range(len(self.directions)):
            below = level - len(self.fitted)
            off = z[row, level] - (self.fitted[level][node] if below < 0 else self.later[below][node >> below])
            left, right = np.flatnonzero(off <= self.spill), np.flatnonzero(off > -self.spill)
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in one array and where each list begins."""
    size = np.asarray(column.value_lengths().fill_null(0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)), np.concatenate([[0], np.cumsum(size)])


def _normalised(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def leaf_links(x: np.ndarray, weight: np.ndarray, codes: list[np.ndarray], here: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight of linked partners not counted before, least row of the local component) for each row of a leaf.

    codes: for each row all of its leaves over all trees. Similarities are computed block by block.
    """
    n = len(x)
    counted = np.zeros(n, np.int64)
    before, col = np.unique(np.concatenate(codes), return_inverse=True)
    of = np.repeat(np.arange(n), [len(c) for c in codes])
    earlier = before[col] < here
    of = of[earlier]
    _, col = np.unique(col[earlier], return_inverse=True)
    linked = np.zeros(n, bool)
    step = max(1, min(_BLOCK, (1 << 22) // n))  # so that a block of similarities has a bounded size
    for lo in range(0, n, step):
        near = x[lo : lo + step] @ x.T >= threshold
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
        some = np.flatnonzero(near.any(axis=1))
        linked[lo + some] = True
        if not len(some):
            continue
        near = near[some]
        for c in range(0, int(col.max()) + 1 if len(col) else 0, 256):  # pairs that share an earlier leaf were counted there
            here_in = (col >= c) & (col < c + 256)
            member = np.zeros((n, 256), np.float32)
            member[of[here_in], col[here_in] - c] = 1
            near &= member[lo + some] @ member.T == 0
        counted[lo + some] = near @ weight
    root = np.arange(n)
    free = linked.copy()
    for s in np.flatnonzero(linked):  # each row is compared once more, when the walk reaches it
        if free[s]:
            free[s] = False
            stack = [s]
            while stack:
                left = np.flatnonzero(free)
                if not len(left):
                    break
                got = left[x[left] @ x[stack.pop()] >= threshold]
                free[got] = False
                root[got] = s
                stack.extend(got.tolist())
    return counted, root


def dense_balls(sample: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """Centres of dense balls, unit vectors in double precision; see above.

    A ball whose shell holds more of the sample than the ball is none: comparing them would cost more than it saves.
    """
    theta = np.arccos(threshold)
    near, shell = np.cos(theta / 2 - _ROUNDING), np.cos(min(1.5 * theta, np.pi))
    left, found = sample, []
    need = max(_FEW, int(_DENSE * len(sample)))
    while len(left) >= need:
        tried = left[rng.choice(len(left), min(len(left), 256), replace=False)]
        best = tried[(tried @ left.T >= near).sum(axis=1).argmax()]
        centre = left[left @ best >= near].mean(axis=0)
        centre /= np.linalg.norm(centre)
        inside = left @ centre >= near
        if inside.sum() < need:
            break
        if (sample @ centre >= shell).sum() <= 2 * inside.sum():
            found.append(centre)
        left = left[~inside]
    return np.array(found).reshape(len(found), sample.shape[1])


def _outside(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float, work: Workspace) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The classes in no dense ball; and, if there are balls, the (node, linked) and (a, b) of all links with members.

    Of each vector and ball but its own, the angle to the centre says whether it links with all members or with none;
    in the shell between, it is compared with the members, which are dealt over tasks in blocks of about _MEMBERS.
    """
    if not any(len(c) for c in centres.values()):
        return classes, None, None
    theta = np.arccos(threshold)
    half = theta / 2 - _ROUNDING
    number = np.cumsum([0, *(len(c) for c in centres.values())])
    base = dict(zip(centres, number.tolist(), strict=False))

    def relate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            values, first = _matrix(batch.column("v"))
            size = np.diff(first)
            ball = np.full(len(size), -1, np.int32)
            lists: list[list[list[int]]] = [[[] for _ in size], [[] for _ in size]]
            for d in np.unique(size).tolist():
                if not len(centres.get(d, ())):
                    continue
                rows = np.flatnonzero(size == d)
                angle = np.arccos(np.clip(_normalised(values[first[rows][:, None] + np.arange(d)]) @ centres[d].T, -1, 1))
                own = angle.argmin(axis=1)
                inside = angle[np.arange(len(rows)), own] <= half
                ball[rows[inside]] = base[d] + own[inside]
                angle[np.flatnonzero(inside), own[inside]] = np.inf
                whole = angle <= theta - half - _ROUNDING
                shell = ~whole & (angle <= theta + half + _ROUNDING)
                for out, hit in zip(lists, (whole, shell), strict=True):
                    for k, c in zip(*np.nonzero(hit), strict=True):
                        out[rows[k]].append(base[d] + int(c))
            cols = [*(batch.column(c) for c in ("node", "weight", "v")), pa.array(ball), *(pa.array(x, pa.list_(pa.int32())) for x in lists)]
            yield pa.RecordBatch.from_arrays(cols, ["node", "weight", "v", "ball", "whole", "shell"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks one after another, in each first the members and then the vectors of the shell."""
        block, ids, weight, x, got = None, None, None, None, None

        def rows(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c.astype(np.int64))], ["a", "b", "c"])

        for batch in it:
            at = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("ball", "block", "member", "node", "weight", "counts")]
            values, first = _matrix(batch.column("v"))
            key = at[0].astype(np.int64) << 32 | at[1]
            for lo in np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[2][1:] != at[2][:-1])])).tolist() if len(key) else []:
                hi = lo + 1
                while hi < len(key) and key[hi] == key[lo] and at[2][hi] == at[2][lo]:
                    hi += 1
                part = _normalised(values[first[lo] : first[hi]].reshape(hi - lo, -1))
                if key[lo] != block:
                    if block is not None:
                        yield rows(ids, ids, got)
                    block, ids, weight, x = key[lo], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, part.shape[1]))
                    got = np.zeros(0, np.int64)
                if at[2][lo]:
                    ids, weight, x = np.concatenate([ids, at[3][lo:hi]]), np.concatenate([weight, at[4][lo:hi]]), np.concatenate([x, part])
                    got = np.zeros(len(ids), np.int64)
                    continue
                for k in range(0, len(part), 256):
                    near = part[k : k + 256] @ x.T >= threshold
                    some = np.flatnonzero(near.any(axis=1))
                    if len(some):
                        yield rows(at[3][lo + k + some], ids[near[some].argmax(axis=1)], near[some] @ weight)
                        got += (at[4][lo + k + some] * at[5][lo + k + some]) @ near[some]
        if block is not None:
            yield rows(ids, ids, got)

    of = classes.schema["v"].dataType.simpleString()
    marked, _ = work.save(classes.select("node", "weight", "v").mapInArrow(relate, f"node long, weight long, v {of}, ball int, whole array<int>, shell array<int>"), "marked")
    members = marked.where("ball >= 0")
    balls = members.groupBy("ball").agg(F.sum("weight").alias("total"), F.min("node").alias("head"), F.count("*").alias("size"))
    balls, _ = work.save(balls.withColumn("blocks", F.ceil(F.col("size") / _MEMBERS).cast("int")), "balls")
    balls = F.broadcast(balls)  # at most SAMPLE / _FEW rows
    whole = marked.select("node", "weight", (F.col("ball") < 0).alias("open"), F.explode("whole").alias("ball")).join(balls, "ball")
    gained = F.broadcast(whole.groupBy("ball").agg(F.sum(F.when(F.col("open"), F.col("weight")).otherwise(0)).alias("gained")))  # a row a ball
    own = members.join(balls, "ball").join(gained, "ball", "left")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    fields = ("ball", "block", "member", "node", "weight", "counts", "v")
    # A member of another ball counts its links itself; a vector outside the balls is counted for both.
    held = members.join(balls, "ball").select("ball", block.alias("block"), F.lit(1).alias("member"), "node", "weight", F.lit(0).alias("counts"), "v")
    asked = marked.select("node", "weight", "v", (F.col("ball") < 0).cast("int").alias("counts"), F.explode("shell").alias("ball")).join(balls, "ball")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("member", F.lit(0))
    wanted = F.broadcast(asked.select("ball").distinct())  # a row a ball
    both = held.join(wanted, "ball", "left_semi").select(*fields).unionByName(asked.select(*fields))
    compared = both.repartition("ball", "block").sortWithinPartitions("ball", "block", F.desc("member")).mapInArrow(compare, "a long, b long, c long")
    compared, _ = work.save(compared, "shell")
    linked = own.select("node", (F.col("total") - F.col("weight") + F.coalesce("gained", F.lit(0))).alias("linked"))
    linked = linked.unionByName(whole.select("node", F.col("total").alias("linked"))).unionByName(compared.select(F.col("a").alias("node"), F.col("c").alias("linked")))
    edges = own.select(F.col("node").alias("a"), F.col("head").alias("b")).unionByName(whole.select(F.col("node").alias("a"), F.col("head").alias("b")))
    edges = edges.unionByName(compared.select("a", "b")).where("a <> b")
    return marked.where("ball < 0").select("node", "weight", "v"), linked, edges


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, trees: int = 8, leaf_size: int = 400, seed: int = 7, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    n_links counts the other vectors (rows) found with a cosine of ``threshold`` or more; component_id is the least id
    reachable by links. Double vectors stay doubles. Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths. Rows with equal vectors link with each other; repeated rows count as
    vectors of their own. Null ids take part, with a null component only if no id of it is known. Other columns are
    ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "embedding-dedup")
    kind = "double" if vectors.schema[vector_col].dataType.simpleString() == "array<double>" else "float"
    v = F.col(vector_col).cast(f"array<{kind}>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    # -0.0 and 0.0 are one value: the key is built from texts of the components after adding 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, F.transform(v, lambda e: e + F.lit(0.0).cast(kind))).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.transform("v", lambda e: e.cast("string"))), 256)))
    good = rows.where("v is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.min("v").alias("v"))
    numbered = good.withColumn("node", F.coalesce("rep", -1 - F.abs(F.xxhash64("key") % (1 << 62))))
    classes, _ = work.save(numbered, "classes")
    picked = classes.select("v", hashed_rank("node", seed).alias("o")).orderBy("o").limit(sample).select("v").toArrow()["v"]
    values, first = _matrix(pa.concat_arrays(picked.chunks) if picked.num_chunks else pa.array([], pa.list_(pa.float32())))
    size = np.diff(first)
    fits = {d: _normalised(values[first[:-1][size == d][:, None] + np.arange(d)]) for d in np.unique(size).tolist()}
    centres = {d: dense_balls(fit, threshold, np.random.default_rng([seed, d, 1])) for d, fit in fits.items()}
    open_, linked, edges = _outside(classes, centres, threshold, work)
    levels = max(0, int(np.ceil(np.log2(max(open_.count(), 1) / leaf_size))))
    forests: dict[int, list[Tree]] = {}
    for d, fit in fits.items():
        rng = np.random.default_rng([seed, d])
        apart = fit[~(fit @ centres[d].T >= np.cos(np.arccos(threshold) / 2 - _ROUNDING)).any(axis=1)].astype(np.float32)
        spill = 0.25 * np.sqrt(max(0.0, 2 - 2 * threshold) / d)
        forests[d] = [Tree(apart, levels, spill, rng) for _ in range(trees)]

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each leaf of each vector; a length that the sample lacks makes one leaf."""
        for batch in it:
            values, first = _matrix(batch.column("v"))
            size = np.diff(first)
            for d in np.unique(size).tolist():
                all_rows = np.flatnonzero(size == d)
                for lo in range(0, len(all_rows), 2048):
                    rows = all_rows[lo : lo + 2048]
                    x = _normalised(values[first[rows][:, None] + np.arange(d)]).astype(np.float32)
                    found = [(np.arange(len(x)), np.zeros(len(x), np.int64), 0)] if d not in forests else [(*t.leaves(x), k) for k, t in enumerate(forests[d])]
                    row = np.concatenate([r for r, _, _ in found])
                    code = np.concatenate([((d << 6 | k) << 40) + leaf for _, leaf, k in found])
                    order = np.lexsort((code, row))
                    row, code = row[order], code[order]
                    count = np.bincount(row, minlength=len(x))
                    begin = np.cumsum(count) - count
                    per = np.repeat(count[row], 1)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(code[np.repeat(begin[row], per) + spans.spread(per)]))
                    at = pa.array(rows[row])
                    yield pa.RecordBatch.from_arrays([pa.array(code), lists, *(batch.column(c).take(at) for c in ("node", "weight", "v"))], ["leaf", "leaves", "node", "weight", "v"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            leaf = t["leaf"].to_numpy()
            begin = np.append(np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])), len(leaf))
            node, weight = t["node"].to_numpy(), t["weight"].to_numpy()
            values, first = _matrix(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"])
            codes, at = _matrix(t["leaves"].combine_chunks() if isinstance(t["leaves"], pa.ChunkedArray) else t["leaves"])
            out: list[tuple[np.ndarray, ...]] = []
            for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                if hi - lo > 1:
                    x = _normalised(values[first[lo] : first[hi]].reshape(hi - lo, -1))
                    order = np.argsort(node[lo:hi], kind="stable")
                    c, root = leaf_links(x[order], weight[lo:hi][order], [codes[at[k] : at[k + 1]] for k in (lo + order).tolist()], int(leaf[lo]), threshold)
                    some = np.flatnonzero((c > 0) | (root != np.arange(hi - lo)))
                    own = node[lo:hi][order]
                    out.append((own[some], own[root[some]], c[some]))
            a, b, c = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["a", "b", "c"])

        kept: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            leaf = batch.column("leaf").to_numpy()
            if kept and kept[-1].column("leaf")[-1].as_py() != leaf[0]:
                yield links(kept)
                kept = []
            cut = int(np.searchsorted(leaf, leaf[-1]))
            if cut:
                yield links([*kept, batch.slice(0, cut)])
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield links(kept)

    dealt = open_.select("node", "weight", "v").mapInArrow(assign, f"leaf long, leaves array<long>, node long, weight long, v array<{kind}>")
    found = dealt.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(compare, "a long, b long, c long")
    found, _ = work.save(found, "links")
    counted = found.select(F.col("a").alias("node"), F.col("c").alias("linked"))
    degree = (counted if linked is None else counted.unionByName(linked)).groupBy("node").agg(F.sum("linked").alias("linked"))
    pairs = found.where("a <> b").select("a", "b")
    joined, _ = work.save(components(pairs if edges is None else pairs.unionByName(edges), work), "components")
    tops = joined.join(classes.select("node", "rep"), "node")
    least = tops.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = tops.select("node", "component").join(least, "component").select("node", "component_id")
    named = classes.select("key", "node", "rep", "weight").join(degree, "node", "left").join(of, "node", "left")
    named = named.select("key", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    named, _ = work.save(named, "named")  # so that adaptive execution can split a hot vector in the last join
    out = rows.select("id", "key").join(named, "key", "left")
    own = out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return own.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
