"""Exact dedup by an extendible-hash index on shared files; DataFrame functions only.

1. The pseudo-keys (64-bit hashes of the normalised texts) are counted first, without texts. From their loads the
   directory grows: it starts with 2^d buckets, and while a bucket holds more keys than its capacity, it is split by
   one more bit of the key (extendible hashing, Fagin et al., 1979). Each round reads only keys of overfull buckets.
2. Every text finds its bucket through the directory. Copies are combined within a task first, so a group that holds a
   third of all rows sends one entry a task; these are dealt over a few shares, and then to the tasks that own the
   buckets. An owner chains the entries of a key and compares their bytes: equal texts become one entry of the chain,
   texts whose keys collide stay apart. Bucket, key and place in the chain are written to the shared folder.
3. Every document finds its bucket by the directory again, and there its entry by key and digest. A text that finds
   no bucket, or no entry in it, is an error. The hot side is split by adaptive execution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm.shared import Workspace

#: Texts of a bucket, unless a table has so many that this would make more than half of BROADCAST_BUCKETS. Buckets are what
#: owners are dealt, so small ones spread evenly.
CAPACITY = 4096
#: A directory of at most so many buckets (about 10 MB) is broadcast; beyond that it is joined by key range.
BROADCAST_BUCKETS = 1 << 18
#: Shares over which the combined entries of one text are dealt before they go to its owner.
_SHARES = 8


def normalized(text: str | Column) -> Column:
    """White space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _key(hash_bits: int, norm: str = "norm") -> Column:
    return F.xxhash64(norm) if hash_bits == 64 else F.shiftrightunsigned(F.xxhash64(norm), 64 - hash_bits)


def _prefix(depth: Column | int, hash_bits: int, key: str = "h") -> Column:
    """The first ``depth`` bits of the key."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col(key), (F.lit(hash_bits) - depth).cast("int")))


def directory(keys: DataFrame, work: Workspace, capacity: int | None, initial_depth: int | None, hash_bits: int) -> DataFrame:
    """(prefix, depth, load) of each bucket that holds keys. keys: h, each key once.

    Splitting ends at the latest with buckets of one key, so no bucket stays overfull.
    """
    n = max(keys.count(), 1)
    capacity = max(CAPACITY, 2 * n // BROADCAST_BUCKETS) if capacity is None else capacity
    depth = max(0, math.ceil(math.log2(n / capacity))) if initial_depth is None else initial_depth
    depth, found = min(depth, hash_bits), None
    while True:
        loads = keys.groupBy(_prefix(depth, hash_bits).alias("prefix")).agg(F.count("*").alias("load"))
        loads, _ = work.save(loads.withColumn("depth", F.lit(depth)), "loads")
        full = (F.col("load") > capacity) & (F.col("depth") < hash_bits)
        found = loads.where(~full) if found is None else found.unionByName(loads.where(~full))
        overfull = loads.where(full).select(F.col("prefix").alias("of"))
        if overfull.isEmpty():
            return work.save(found, "directory")[0]
        keys, _ = work.save(keys.join(overfull, _prefix(depth, hash_bits) == F.col("of"), "left_semi"), "overfull")
        depth += 1


def place(rows: DataFrame, buckets: DataFrame, hash_bits: int, broadcast_buckets: int = BROADCAST_BUCKETS, key: str = "h", name: str = "bucket") -> DataFrame:
    """rows with the bucket that the directory gives for their key; a key without a bucket is an error."""
    seen = buckets.agg(F.min("depth").alias("least"), F.count("*").alias("n")).first()
    least = seen.least or 0  # all buckets of one range of this depth are compared with a key
    start = F.call_function("shiftrightunsigned", F.col("prefix"), F.col("depth") - least) if least else F.lit(0).cast("long")
    entry = buckets.select(start.alias("__range"), F.col("prefix").alias("__prefix"), F.col("depth").alias("__depth"))
    entry = F.broadcast(entry) if seen.n <= broadcast_buckets else entry
    same = (F.col("__of") == F.col("__range")) & (_prefix(F.col("__depth"), hash_bits, key) == F.col("__prefix"))
    out = rows.withColumn("__of", _prefix(least, hash_bits, key)).join(entry, same, "left")
    lost = F.raise_error(F.concat(F.lit("the directory has no bucket for key "), F.col(key).cast("string"))).cast("string")
    found = F.when(F.col("__depth").isNull(), lost).otherwise(F.concat_ws(":", F.col("__depth").cast("string"), F.col("__prefix").cast("string")))
    return out.withColumn(name, found).drop("__of", "__range", "__prefix", "__depth")


def build_index(docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, initial_depth: int | None = None, hash_bits: int = 64, broadcast_buckets: int = BROADCAST_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(index, directory). index: bucket, h, chain (place among the texts of a key), text_sha256, keep_id, group_size."""
    norm = docs.select(F.col(id_col).alias("id"), normalized(text_col).alias("norm"))
    keyed = norm.select("id", "norm", _key(hash_bits).alias("h"))
    keys, _ = work.save(keyed.select("h").distinct(), "keys")
    buckets = directory(keys, work, capacity, initial_depth, hash_bits)
    placed = place(keyed, buckets, hash_bits, broadcast_buckets).withColumn("share", F.spark_partition_id() % _SHARES)
    combined = placed.groupBy("bucket", "h", "norm", "share").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = combined.repartition("bucket").groupBy("bucket", "h", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = owned.select("bucket", "h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256"))
    index, _ = work.save(entries.withColumn("chain", chain), "index")
    return index, buckets


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index_options: int) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept and text_sha256.

    The row with the least id of a group of equal normalised texts stays. Null texts equal empty ones. A null id is
    above every other: keep_id is null only where all ids of a group are. Rows that share the least id of their
    group are all marked as kept. Texts of any length are compared whole. Columns of docs with one of the new names
    are replaced. No rows give no rows.
    """
    work = Workspace(docs.sparkSession, "exact-dedup")
    hash_bits = index_options.get("hash_bits", 64)
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    index, buckets = build_index(docs, work, id_col, text_col, **index_options)
    keyed = docs.withColumn("__norm", normalized(text_col)).withColumn("__h", _key(hash_bits, "__norm"))
    keyed = keyed.withColumn("__sha", F.sha2("__norm", 256)).drop("__norm")
    placed = place(keyed, buckets, hash_bits, index_options.get("broadcast_buckets", BROADCAST_BUCKETS), "__h", "__bucket")
    entry = index.select(F.col("bucket").alias("__bucket"), F.col("h").alias("__h"), F.col("text_sha256").alias("__sha"), "keep_id", "group_size")
    out = placed.join(entry, ["__bucket", "__h", "__sha"], "left")
    lost = F.raise_error(F.concat(F.lit("the index has no entry for text "), F.col("__sha"))).cast("long")
    out = out.withColumn("group_size", F.coalesce("group_size", lost)).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    return out.withColumnRenamed("__sha", "text_sha256").drop("__bucket", "__h")
