"""Integrity of evidence: trees per source, proofs, tamper checks and the verification ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.functions import integrity as I
from provenia.operators import merkle

_LADDER = ("L0", "L1", "L2", "L3", "L4")


def roots(nodes: DataFrame) -> DataFrame:
    """(source_id, root) of each source's tree; leaves in order of passages."""
    return merkle.roots(merkle.forest(nodes))


def leaf_proofs(nodes: DataFrame) -> DataFrame:
    """(source_id, sha256, proof, root) of each different leaf of each source; equal leaves have the proof of the first."""
    rows = merkle.stage_proofs(merkle.forest(nodes))
    first = rows.groupBy("source_id", F.col("hash").alias("sha256")).agg(F.min_by(F.struct("proof", "root"), "place").alias("x"))
    return first.select("source_id", "sha256", "x.proof", "x.root")


def proofs(nodes: DataFrame) -> DataFrame:
    """Passages with the proof from their hash to the root of their source."""
    return nodes.join(leaf_proofs(nodes), ["source_id", "sha256"])


def verify_nodes(nodes: DataFrame, registered: DataFrame) -> DataFrame:
    """Passages with hash_ok (text hashes to the stored hash), proof_ok and valid, against the trees of ``registered``."""
    rows = nodes.join(leaf_proofs(registered), ["source_id", "sha256"], "left")
    good = F.coalesce(I.walk(F.col("sha256"), F.col("proof")) == F.col("root"), F.lit(False))
    rows = rows.withColumn("hash_ok", F.sha2("text", 256) == F.col("sha256")).withColumn("proof_ok", good)
    return rows.withColumn("valid", F.col("hash_ok") & F.col("proof_ok"))


def registry_match(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """claims (node_hash, proof, root) with valid, computed_hash and verified_sources: every source of that root."""
    sources = registry.groupBy("root").agg(F.array_sort(F.collect_set("source_id")).alias("verified_sources"))
    rows = claims.withColumn("computed_hash", I.walk(F.col("node_hash"), F.col("proof"))).join(sources, "root", "left")
    rows = rows.withColumn("registry_verified", F.col("verified_sources").isNotNull())
    rows = rows.withColumn("verified_sources", F.coalesce("verified_sources", F.array().cast("array<string>")))
    return rows.withColumn("valid", (F.col("computed_hash") == F.col("root")) & F.col("registry_verified"))


def missing_fields(fields: list[str]) -> F.Column:
    """Names of the fields that are null or empty; an empty list passes."""
    return F.array_compact(F.array(*(F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in fields)))


def ladder(evidence: DataFrame, nodes: DataFrame, registry: DataFrame, rendered: DataFrame) -> DataFrame:
    """evidence with the five rungs, the first failing one and the overall verdict.

    L0 all fields there; L1 passage exists; L2 stored hash equal; L3 proof leads to a registered root; L4 the citation
    renders equal. Any failure is rejected, else pending_audit: a person approves. Three joins for any number of items.
    """
    # Proofs are walked before any join, which then moves a digest of each; they stay where the caller selects them.
    rows = evidence.withColumn("walked", I.walk(F.col("sha256"), F.col("merkle_proof")))
    rows = rows.join(nodes.select("node_id", F.col("sha256").alias("stored")), "node_id", "left")
    rows = rows.join(registry.select("source_id", "root").dropDuplicates(["source_id"]), "source_id", "left")
    rows = rows.join(rendered.select(F.col("id").alias("citation_key"), F.col("citation").alias("want")), "citation_key", "left")
    no = F.lit(False)
    rungs = [
        F.size(missing_fields(["node_id", "source_id", "sha256", "citation_key", "citation_rendered"])) == 0,
        F.col("stored").isNotNull(),
        F.coalesce(F.col("stored") == F.col("sha256"), no),
        F.coalesce(F.col("walked") == F.col("root"), no),
        F.coalesce(F.col("want") == F.col("citation_rendered"), no),
    ]
    first = F.coalesce(*(F.when(~ok, F.lit(name)) for name, ok in zip(_LADDER, rungs, strict=True)))
    rows = rows.withColumn("failed_at", first)
    return rows.withColumn("overall", F.when(F.col("failed_at").isNull(), "pending_audit").otherwise("rejected")).drop("stored", "root", "want", "walked")
