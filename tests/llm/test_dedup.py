"""Exact, SimHash, embedding and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from provenia.llm import embedding_dedup as embedding
from provenia.llm import exact_dedup as exact
from provenia.llm import simhash, spans
from provenia.llm import substring_dedup as substring
from provenia.llm.components import components
from provenia.llm.embedding_dedup import embedding_dedup
from provenia.llm.exact_dedup import build_index, exact_dedup
from provenia.llm.shared import Workspace, shared_folder
from provenia.llm.simhash import simhash_components
from provenia.llm.substring_dedup import substring_dedup

DOCS = "doc_id long, text string"


def classes(links, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    ids = {x for pair in links if pair[0] != pair[1] for x in pair}
    got = components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()
    assert {(g.node, g.component) for g in got} == set(classes(links, ids).items()) and len(got) == len(ids)
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Cluster.conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster())


ODD = [(5, "a  b"), (3, "a\tb"), (9, None), (8, ""), (1, "a b "), (7, "é"), (7, "é"), (None, "a b"), (11, " \n "), (12, " "), (13, "x" * 200_000), (14, "x" * 200_000)]


@pytest.mark.parametrize("options", [{}, {"capacity": 1, "initial_depth": 0}, {"hash_bits": 1, "capacity": 2}, {"hash_bits": 8, "capacity": 2, "initial_depth": 1}, {"capacity": 3, "broadcast_buckets": 0}])
def test_exact_dedup_matches_brute_force(spark, options):
    r = random.Random(1)
    rows = ODD + [(100 + k, " ".join(r.choice("abc") for _ in range(3))) for k in range(60)]
    docs = spark.createDataFrame([(*x, "old", 1) for x in rows], DOCS + ", kept string, other int")
    got = exact_dedup(docs, **options).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(x for x in g if x is not None)
        want.append((i, t, 1, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    key = lambda x: tuple(map(str, x))
    assert sorted(((g.doc_id, g.text, g.other, g.keep_id, g.group_size, g.kept, g.text_sha256) for g in got), key=key) == sorted(want, key=key)


def test_directory_doubles_only_overfull_buckets(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(400)], DOCS)
    index, buckets = build_index(docs, Workspace(spark, "t"), capacity=25, initial_depth=1)
    load = {f"{b.depth}:{b.prefix}": b.load for b in buckets.collect()}
    size = {}
    for x in index.collect():
        size[x.bucket] = size.get(x.bucket, 0) + 1
        depth, prefix = map(int, x.bucket.split(":"))
        assert prefix == (x.h % (1 << 64)) >> (64 - depth) and x.chain == 1
    assert size == load and sum(load.values()) == 400 and max(load.values()) <= 25
    assert len({b.split(":")[0] for b in load}) > 1  # only overfull buckets were split further
    # A split goes on as far as keys share bits: no bucket stays overfull, whatever the first depth.
    _, buckets = build_index(docs, Workspace(spark, "t"), capacity=1, initial_depth=0)
    assert {b.load for b in buckets.collect()} == {1}


def test_colliding_keys_form_chains(spark):
    docs = spark.createDataFrame([(k, f"text {k % 20}") for k in range(60)], DOCS)
    index, _ = build_index(docs, Workspace(spark, "t"), hash_bits=2, capacity=1)
    chains = {}
    for x in index.collect():
        chains.setdefault(x.h, []).append(x.chain)
        assert x.group_size == 3
    assert len(chains) <= 4 and sum(map(len, chains.values())) == 20 and all(sorted(c) == list(range(1, len(c) + 1)) for c in chains.values())


def test_rows_are_found_through_the_directory(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k % 50}") for k in range(100)], DOCS)
    work = Workspace(spark, "t")
    _, buckets = build_index(docs, work, capacity=4)
    keyed = docs.select(exact._key(64, "text").alias("h"))
    for lost in (buckets.where("prefix <> 3"), buckets.withColumn("prefix", (buckets.prefix + 1))):
        for most in (0, 1 << 16):  # joined by range, and broadcast
            with pytest.raises(Exception, match="no bucket"):
                exact.place(keyed, lost, 64, most).collect()
    # Documents that are sent to other buckets than the owners' find no entry.
    real, calls = exact.place, []

    def astray(rows, buckets, *more):
        calls.append(1)
        out = real(rows, buckets, *more)
        return out if len(calls) == 1 else out.withColumn(more[-1], F.lit("0:0"))

    monkeypatch.setattr(exact, "place", astray)
    with pytest.raises(Exception, match="no entry"):
        exact_dedup(docs, capacity=4).collect()


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).collect() == []


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    r = random.Random(2)
    base = [" ".join(r.choice(["Alpha", "beta", "gamma", "É", "delta", "eps"]) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    rows = [*enumerate(base), (500, None), (501, ""), (502, " \n"), (503, base[0]), (503, base[0])]
    long = [f"w{k}" for k in range(3000)]
    rows += [(600 + k, " ".join([*long[:k], "new", *long[k:]])) for k in range(5)]
    got = {(g.id, g.fp % (1 << 64), g.component_id) for g in simhash_components(spark.createDataFrame([(*x, "z") for x in rows], DOCS + ", fp string")).collect()}
    fp = {i: fingerprint(t) for i, t in rows}
    links = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2]
    comp = classes(links, fp)
    assert got == {(i, fp[i], comp[i]) for i in fp}
    assert simhash_components(spark.createDataFrame([], DOCS)).collect() == []


def test_every_close_pair_meets_at_an_anchor():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 64, 300, dtype=np.uint64)
    y = x.copy()
    for _ in range(2):
        y ^= np.uint64(1) << r.integers(0, 64, len(x), dtype=np.uint64)
    fp = np.unique(np.concatenate([x, y]))
    row, anchor, home = simhash.anchors(fp, 2)
    assert home.sum() == len(fp)
    order = np.argsort(anchor, kind="stable")
    for block in (1 << 20, 7):
        a, b = simhash.bucket_links(anchor[order], home[order], fp[row[order]], 2, block)
        sets = classes([(int(p), int(q)) for p, q in zip(fp[row[order]][a], fp[row[order]][b], strict=True)], [int(v) for v in fp])
        assert all(sets[int(p)] == sets[int(q)] for p, q in zip(x, y, strict=True))


def test_embeddings_match_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.05 * r.standard_normal((30, 16)), base[:5], 3 * base[5:8]]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] + [1.0] * 15), (204, [None] + [1.0] * 15), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, [float("inf")] + [1.0] * 15), (200, None)]
    got = {(g.id, g.n_links, g.component_id, g.kept) for g in embedding_dedup(spark.createDataFrame([(*v, 1) for v in rows], "vec_id long, embedding array<float>, id int"), leaf_size=20).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    links = [(a, b) for a in range(len(x)) for b in range(a) if near[a, b]]
    comp = classes(links, range(len(x)))
    want = {(k, int(near[k].sum()) - 1, comp[k], comp[k] == k) for k in range(len(x))}
    want |= {(k, 0, k, True) for k in (200, 201, 202, 203, 204, 207)} | {(205, 1, 205, True), (206, 1, 205, False)}
    assert got == want


def test_embedding_recall_on_many_leaves(spark):
    r = np.random.default_rng(8)
    base = r.standard_normal((1500, 32))
    x = np.concatenate([base, base + 0.25 * r.standard_normal((1500, 32))]).astype(np.float32)
    got = {g.id: g.n_links for g in embedding_dedup(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>"), leaf_size=100).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.9 * want.sum() > 0


@pytest.mark.parametrize(("noise", "balls"), [(0.02, 1), (0.06, 1), (0.18, 1), (0.4, 0)])
def test_dense_groups_match_brute_force(spark, noise, balls, monkeypatch):
    """A third of all vectors near one another, a second such group beside it, vectors in the shell, and others."""
    r = np.random.default_rng(9)
    d = 16
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    one, other = unit(r.standard_normal((2, d)))
    beside = unit(one + 0.4 * unit(other - one * (one @ other)))
    near = [unit(c + noise * unit(r.standard_normal((n, d))) * r.random((n, 1))) for c, n in ((one, 200), (beside, 120))]
    between = [unit(one + w * unit(r.standard_normal((1, d)))) for w in np.linspace(0.05, 0.7, 60)]
    x = np.concatenate([*near, *between, r.standard_normal((220, d)), near[0][:7]]).astype(np.float32)
    x = x[r.permutation(len(x))]
    monkeypatch.setattr(embedding, "_MEMBERS", 50)
    centres = embedding.dense_balls(embedding._normalised(x), 0.95, np.random.default_rng(1))
    assert len(centres) == balls
    got = {g.id: (g.n_links, g.component_id) for g in embedding_dedup(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>"), leaf_size=1000).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = u @ u.T >= 0.95
    comp = classes([(a, b) for a in range(len(x)) for b in range(a) if links[a, b]], range(len(x)))
    assert got == {k: (int(links[k].sum()) - 1, comp[k]) for k in range(len(x))}


def test_trees_do_not_split_what_they_cannot_part():
    r = np.random.default_rng(2)
    x = np.concatenate([np.ones((4000, 8)) + 1e-4 * r.standard_normal((4000, 8)), r.standard_normal((4000, 8))])
    x = embedding._normalised(x).astype(np.float32)
    row, leaf = embedding.Tree(x, 12, 0.03, r).leaves(x)
    assert len(row) <= 4 * len(x)  # a split of the dense half would send each of its vectors to thousands of leaves


def brute_cut(rows, window):
    first = {}
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_windows_of_one_source_become_spans():
    r = random.Random(8)
    for _ in range(200):
        rows = [(r.randrange(40), r.randrange(1, 6), r.randrange(2), r.randrange(3)) for _ in range(r.randrange(1, 25))]
        start, count, doc, shift = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        entry, begin, words = substring.merged(start, count, [doc, doc * 0], start + shift, 4)
        want = {(d, x, s + k) for s, c, d, x in rows for k in range(c)}
        got = [(int(doc[e]), int(shift[e]), int(b) + k) for e, b, n in zip(entry, begin, words, strict=True) for k in range(n - 3)]
        assert set(got) == want and len(got) == len(want)
        assert all((d, x, b - 1) not in want for d, x, b in zip(doc[entry].tolist(), shift[entry].tolist(), begin.tolist(), strict=True))


def test_words_that_do_not_verify_stay(spark):
    """Fingerprints of two bits take most paths for equal; what is not equal at the source's coordinates stays."""
    r = random.Random(6)
    rows = [(k, " ".join(r.choice("abc") for _ in range(40))) for k in range(30)] + [(100, "p q r s t u v w x y z"), (101, "p q r s t u v w x y z")]
    want = {i: (n, kept.split()) for i, _, n, kept in brute_cut(rows, 6)}
    got = substring_dedup(spark.createDataFrame(rows, DOCS), window=6, core=2, bits=1).collect()
    assert all(g.n_removed <= want[g.doc_id][0] for g in got) and sum(g.n_removed for g in got) < sum(n for n, _ in want.values())
    for g in got:
        words = dict(rows)[g.doc_id].split()
        kept = [k for k in range(len(words)) if not any(s.start <= k < s.end for s in g.removed)]
        assert [words[k] for k in kept] == g.kept_text.split()


@pytest.mark.parametrize(("window", "core"), [(5, 2), (8, 3), (3, 3)])
def test_substring_dedup_matches_brute_force(spark, window, core):
    r = random.Random(window)
    passage = [r.choice("abcdefgh") for _ in range(40)]
    rows = [(1, None), (2, ""), (3, "x"), (3, "a b c d e f g h i j")]
    for i in range(4, 60):
        w = [r.choice(["p", "q", "r", "s", "é"]) for _ in range(r.randrange(30))]
        a = r.randrange(30)
        rows.append((i, "\n".join([*w, *passage[a : a + r.randrange(20)], *w[:5]])))
    rows += [(70, rows[10][1]), (71, rows[10][1]), (71, rows[10][1]), (80, " ".join(["z"] * 100)), (81, " ".join(["z"] * 30))]
    out = substring_dedup(spark.createDataFrame([(*x, 0) for x in rows], DOCS + ", n_words int"), window=window, core=core)
    got = out.collect()
    assert sorted((g.doc_id, g.n_words, g.n_removed, g.kept_text) for g in got) == brute_cut(rows, window)
    assert all(g.n_removed == sum(s.end - s.start for s in g.removed) for g in got)
    assert substring_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_double_vectors_are_compared_as_doubles(spark):
    """Components beyond the range of floats, and a pair whose cosine passes the threshold by less than a float can tell."""
    rows = [(1, [1e300, 2e300, 0.0, 0.0]), (2, [2e300, 4e300, 0.0, 1e290]), (3, [1e-300, -2e-300, 3e-300, 0.0])]
    s = 0.95 + 1e-12
    rows += [(4, [0.0, 0.0, 0.0, 1.0]), (5, [0.0, 0.0, (1 - s * s) ** 0.5, s]), (6, [0.0, (1 - (s - 3e-12) ** 2) ** 0.5, 0.0, s - 3e-12])]
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6)}
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []
