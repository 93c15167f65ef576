"""Trees over rows against trees by hand, in blocks small enough for many stages."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from provenia.operators import evidence, merkle

SCHEMA = "node_id string, source_id string, sha256 string, paragraph int"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([h(now[i] + (now[i + 1] if i + 1 < len(now) else now[i])) for i in range(0, len(now), 2)])
    return out


def proof_of(levels, place):
    out = []
    for level in levels[:-1]:
        out.append(f"right:{level[place + 1] if place + 1 < len(level) else level[place]}" if place % 2 == 0 else f"left:{level[place - 1]}")
        place //= 2
    return out


@pytest.fixture(params=[(1, 2), (2, 3), (10, 1 << 12)], ids=["pairs", "fours", "default"])
def blocks(request, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", request.param[0])
    monkeypatch.setattr(merkle, "SIZE", 1 << request.param[0])
    monkeypatch.setattr(merkle, "RUN", request.param[1])


def forest_rows(sizes, seed=0):
    rng = random.Random(seed)
    rows, want = [], {}
    for s, n in enumerate(sizes):
        own = sorted((rng.randint(0, 3 * n), f"{s}:{k:03d}", h(f"{s}/{rng.randint(0, n)}")) for k in range(n))
        rows += [(node, f"s{s}", sha, paragraph) for paragraph, node, sha in own]
        want[f"s{s}"] = levels_of([sha for _, _, sha in own])
    rng.shuffle(rows)
    return rows, want


def test_roots_rows_and_proofs(spark, blocks):
    rows, want = forest_rows([1, 2, 3, 4, 5, 7, 8, 9, 13, 15])
    n = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = merkle.forest(n)
    assert {r.source_id: (r.root, r.leaf_count) for r in merkle.roots(stages).collect()} == {s: (t[-1][0], len(t[0])) for s, t in want.items()}
    got = {(r.source_id, r.level, r.place): r.hash for r in merkle.tree_rows(stages).collect()}
    assert got == {(s, k, i): x for s, t in want.items() for k, level in enumerate(t) for i, x in enumerate(level)}
    for r in merkle.stage_proofs(stages).collect():
        tree = want[r.source_id]
        assert r.proof == proof_of(tree, r.place) and r.root == tree[-1][0] and r.hash == tree[0][r.place]
    for r in evidence.proofs(n).collect():
        tree = want[r.source_id]
        assert r.proof == proof_of(tree, tree[0].index(r.sha256)) and r.root == tree[-1][0]
    steps = {}
    for r in merkle.sibling_steps(merkle.tree_rows(stages)).collect():
        steps[r.source_id, r.level, r.place] = r.step
    assert steps == {(s, k, i): proof_of(t[k:], i)[0] for s, t in want.items() for k, level in enumerate(t[:-1]) for i in range(len(level))}


def test_updates_hash_the_paths_above_changes_alone(spark, blocks, tmp_path):
    rows, want = forest_rows([1, 2, 5, 9, 12, 15], seed=4)
    kept = merkle.save_forest(merkle.forest(spark.createDataFrame(rows, SCHEMA)), f"file://{tmp_path}/a")
    changes = [("s2", 4, h("x")), ("s3", 0, h("y")), ("s3", 1, h("z")), ("s4", 11, h("w")), ("s0", 0, h("v")), ("s5", 99, h("none")), ("s9", 0, h("none"))]
    now, hashed = merkle.update_forest(kept, spark.createDataFrame(changes, "source_id string, place long, hash string"), f"file://{tmp_path}/b")
    paths = set()
    for s, place, new in changes:
        if s in want and place < len(want[s][0]):
            want[s][0][place] = new
            paths |= {(s, k, place >> k) for k in range(1, len(want[s]))}
    want = {s: levels_of(t[0]) for s, t in want.items()}
    got = {(r.source_id, r.level, r.place): r.hash for r in merkle.tree_rows(now).collect()}
    assert got == {(s, k, i): x for s, t in want.items() for k, level in enumerate(t) for i, x in enumerate(level)}
    assert hashed == len(paths) <= sum(4 for _ in changes)
    again, none = merkle.update_forest(merkle.open_forest(spark, f"file://{tmp_path}/b"), spark.createDataFrame(changes[:0], "source_id string, place long, hash string"), f"file://{tmp_path}/c")
    assert none == 0 and merkle.roots(again).count() == len(want)


def test_one_source_is_built_by_many_tasks(spark):
    n = spark.range(40_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.lit("one").alias("source_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.col("id").cast("int").alias("paragraph"))
    root = merkle.roots(merkle.forest(n)).first()
    assert root.root == levels_of([h(str(k)) for k in range(40_000)])[-1][0] and root.leaf_count == 40_000
    sizes = merkle.blocks(merkle.leaves(n).withColumn("leaf_count", F.col("total"))).select(F.size(F.get("levels", F.lit(0))).alias("n")).collect()
    assert len(sizes) == 40 and max(s.n for s in sizes) == merkle.SIZE


def test_no_passages_and_no_paragraph(spark):
    n = spark.createDataFrame([("a", "s", h("a"), None), ("b", "s", h("b"), None)], SCHEMA)
    assert merkle.roots(merkle.forest(n)).first().root == h(h("a") + h("b"))
    assert merkle.roots(merkle.forest(n.limit(0))).collect() == [] and evidence.leaf_proofs(n.limit(0)).collect() == []
