"""Merkle trees over rows: a source's tree is built, proved and updated block by block, by as many tasks as it has blocks.

A block holds 2^HEIGHT leaves and all nodes above them, so its size is bounded; the roots of a source's blocks are the leaves
of its next stage, until one block is left. Four stages hold 2^40 leaves. A node is addressed by source, level and place;
an odd last node pairs with itself on every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenia.functions import integrity as I

#: Levels of a block above its leaves, leaves of a block, and stages.
HEIGHT = 10
SIZE = 1 << HEIGHT
STAGES = 4
#: So many consecutive paragraph numbers of a source are put in order by one task.
RUN = 1 << 12


def leaves(nodes: DataFrame) -> DataFrame:
    """(source_id, place, hash, total): leaves in order of passages (paragraph, node_id, hash), numbered from 0.

    Ranks are taken within runs of RUN paragraph numbers and shifted by the sizes of the runs before, so that no source
    is put in order by one task. Only sources of more than one run take part in the join.
    """
    run = F.floor(F.coalesce("paragraph", F.lit(-1)) / RUN)
    of = Window.partitionBy("source_id", "run")
    ranked = nodes.select("source_id", run.alias("run"), "paragraph", "node_id", F.col("sha256").alias("hash"))
    ranked = ranked.withColumn("rank", F.row_number().over(of.orderBy("paragraph", "node_id", "hash")).cast("long") - 1).withColumn("n", F.count("*").over(of))
    source = Window.partitionBy("source_id")
    runs = ranked.where("rank = 0").select("source_id", "run", "n").withColumn("runs", F.count("*").over(source)).withColumn("all", F.sum("n").over(source))
    runs = runs.withColumn("before", F.sum("n").over(source.orderBy("run")) - F.col("n")).where("runs > 1").select("source_id", "run", "before", "all")
    joined = ranked.join(runs, ["source_id", "run"], "left")
    return joined.select("source_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("place"), "hash", F.coalesce("all", "n").alias("total"))


def blocks(rows: DataFrame) -> DataFrame:
    """(source_id, block, total, leaf_count, levels) of the leaves of a stage: a block of many goes up HEIGHT levels, one alone to its root.

    total: leaves of the stage; leaf_count: leaves of the source.
    """
    hashes = F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])
    grouped = rows.groupBy("source_id", "total", "leaf_count", F.floor(F.col("place") / SIZE).alias("block")).agg(hashes.alias("hashes"))
    steps = F.when(F.col("total") > SIZE, F.lit(HEIGHT)).otherwise(F.ceil(F.log2(F.col("total").cast("double"))).cast("int"))
    return grouped.select("source_id", "block", "total", "leaf_count", I.levels_up(F.col("hashes"), steps).alias("levels"))


def _top(levels: Column) -> Column:
    return F.get(F.element_at(levels, -1), F.lit(0))


def _next(stage: DataFrame) -> DataFrame:
    """The roots of blocks as leaves of the next stage, for sources with more than one block."""
    return stage.where(F.col("total") > SIZE).select("source_id", F.col("block").alias("place"), _top(F.col("levels")).alias("hash"), F.ceil(F.col("total") / SIZE).alias("total"), "leaf_count")


def forest(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of each stage; sources of at most SIZE leaves have no row beyond the first."""
    out = [blocks(leaves(nodes).withColumn("leaf_count", F.col("total")))]
    for _ in range(STAGES - 1):
        out.append(blocks(_next(out[-1])))
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def roots(stages: list[DataFrame]) -> DataFrame:
    """(source_id, root, leaf_count) of each source."""
    return _union([s.where(F.col("total") <= SIZE).select("source_id", _top(F.col("levels")).alias("root"), "leaf_count") for s in stages])


def tree_rows(stages: list[DataFrame]) -> DataFrame:
    """(source_id, level, place, hash) of all nodes, leaves at level 0."""
    out = []
    for k, stage in enumerate(stages):
        each = stage.select("source_id", "block", F.posexplode("levels").alias("up", "hashes"))
        # The top of a block is the next stage's leaf, which that stage brings unless there is none.
        each = each.where("up > 0") if k else each
        each = each.select("source_id", (F.col("up") + k * HEIGHT).alias("level"), "block", "up", F.posexplode("hashes").alias("at", "hash"))
        out.append(each.select("source_id", "level", (F.col("block") * F.expr(f"shiftright({SIZE}L, up)") + F.col("at")).alias("place"), "hash"))
    return _union(out)


def stage_proofs(stages: list[DataFrame]) -> DataFrame:
    """(source_id, place, hash, proof, root) of each leaf: steps inside its block, then those of the block's root."""
    above = None
    for stage in reversed(stages):
        dealt = lambda t: F.transform(F.get(t, F.lit(0)), lambda h, i: F.struct(i.cast("long").alias("at"), h.alias("hash"), I.proof_at(t, i).alias("proof"), _top(t).alias("root")))
        own = stage.select("source_id", "total", "block", F.explode(I.let(F.col("levels"), dealt)).alias("x")).select("source_id", "total", "block", (F.col("block") * SIZE + F.col("x.at")).alias("place"), "x.hash", "x.proof", "x.root")
        small = own.where(F.col("total") <= SIZE).select("source_id", "place", "hash", "proof", "root")
        if above is not None:
            up = above.select("source_id", F.col("place").alias("block"), F.col("proof").alias("more"), F.col("root").alias("whole"))
            big = own.where(F.col("total") > SIZE).join(up, ["source_id", "block"])
            small = small.unionByName(big.select("source_id", "place", "hash", F.concat("proof", "more").alias("proof"), F.col("whole").alias("root")))
        above = small
    return above


def sibling_steps(rows: DataFrame) -> DataFrame:
    """(source_id, level, place, step) of each node but the roots: its sibling at place xor 1, by a join of rows with rows.

    For trees whose rows lie in a table; a last node without a sibling pairs with itself.
    """
    other = rows.select("source_id", "level", F.col("place").bitwiseXOR(F.lit(1)).alias("place"), F.col("hash").alias("other"))
    below = rows.join(rows.where("place = 0").groupBy("source_id").agg(F.max("level").alias("top")), "source_id").where("level < top")
    side = F.when(F.col("place") % 2 == 0, "right:").otherwise("left:")
    return below.join(other, ["source_id", "level", "place"], "left").select("source_id", "level", "place", F.concat(side, F.coalesce("other", "hash")).alias("step"))


# ---------------------------------------------------------------- kept trees


def save_forest(stages: list[DataFrame], path: str) -> list[DataFrame]:
    """The blocks of each stage in a folder, and reread from there; each stage is built from the one that was written."""
    out: list[DataFrame] = []
    for k in range(len(stages)):
        (stages[0] if not k else blocks(_next(out[-1]))).sortWithinPartitions("source_id", "block").write.parquet(f"{path}/stage-{k}")
        out.append(stages[0].sparkSession.read.parquet(f"{path}/stage-{k}"))
    return out


def open_forest(spark: SparkSession, path: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/stage-{k}") for k in range(STAGES)]


def _rehashed(levels: Column, changes: Column) -> Column:
    """struct<levels, hashed>: the levels of a block after changes (map of place in the block to hash), hashing the paths above these alone."""
    first = F.transform(F.get(levels, F.lit(0)), lambda h, i: F.coalesce(F.element_at(changes, i), h))
    start = F.struct(F.array(first).alias("levels"), F.map_keys(changes).alias("at"), F.lit(0).cast("long").alias("hashed"))

    def up(s: Column, old: Column) -> Column:
        below = F.element_at(s["levels"], -1)
        at = F.array_distinct(F.transform(s["at"], lambda i: F.shiftright(i, 1)))
        new = F.transform(old, lambda h, i: F.when(F.array_contains(at, i), I.pair_hash(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.get(below, 2 * i)))).otherwise(h))
        return F.struct(F.concat(s["levels"], F.array(new)).alias("levels"), at.alias("at"), (s["hashed"] + F.size(at)).alias("hashed"))

    return F.aggregate(F.slice(levels, F.lit(2), F.size(levels)), start, up, lambda s: F.struct(s["levels"].alias("levels"), s["hashed"].alias("hashed")))


def update_forest(stages: list[DataFrame], changes: DataFrame, path: str) -> tuple[list[DataFrame], int]:
    """(the blocks after leaves were replaced, number of nodes hashed); changes: source_id, place, hash, one row a leaf.

    Only blocks with a changed leaf are read into hashing, and there only the paths from changed leaves: at most changes
    times depth nodes. Blocks without one are copied. Places beyond the leaves of a source change nothing.
    """
    spark, out, hashed = changes.sparkSession, [], 0
    now = changes.select("source_id", "place", "hash")
    for k, stage in enumerate(stages):
        at = F.struct((F.col("place") % SIZE).cast("int").alias("at"), "hash")
        grouped = now.groupBy("source_id", F.floor(F.col("place") / SIZE).alias("block")).agg(F.map_from_entries(F.collect_list(at)).alias("changes"))
        joined = stage.join(grouped, ["source_id", "block"], "left")
        size = F.size(F.get("levels", F.lit(0)))
        inside = F.map_filter("changes", lambda at, _: at < size)
        # A block is written with both, the new levels and what of it was hashed.
        new = F.when(F.size(inside) > 0, _rehashed(F.col("levels"), inside)).otherwise(F.struct(F.col("levels"), F.lit(0).cast("long").alias("hashed")))
        joined.select("source_id", "block", "total", "leaf_count", new.alias("x")).select("source_id", "block", "total", "leaf_count", "x.levels", "x.hashed").write.parquet(f"{path}/stage-{k}")
        done = spark.read.parquet(f"{path}/stage-{k}")
        hashed += done.agg(F.sum("hashed")).first()[0] or 0
        out.append(done.drop("hashed"))
        now = done.where((F.col("hashed") > 0) & (F.col("total") > SIZE)).select("source_id", F.col("block").alias("place"), _top(F.col("levels")).alias("hash"))
    return out, hashed
