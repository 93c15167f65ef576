"""Hashes, Merkle trees and keyed digests as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it inside other lambdas.

    The optimizer merges projections and would compute such a value for every element of the outer array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, start: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """start and every running value of a fold, as an array.

    Runs in blocks: appending to one array copies it at each step, which is quadratic; here only blocks are appended to.
    """
    size = F.size(values)
    count = F.ceil(size / F.lit(block)).cast("int")
    none = F.slice(F.array(F.array(start)), F.lit(1), F.lit(0))
    begins = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def run(now: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(now), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def append(acc: Column, k: Column) -> Column:
        part = F.slice(values, k * block + 1, F.lit(block))
        return let(run(acc["now"], part), lambda r: F.struct(F.element_at(r, -1).alias("now"), F.concat(acc["done"], F.array(F.slice(r, F.lit(2), F.size(r) - 1))).alias("done")))

    blocks = F.aggregate(begins, F.struct(start.alias("now"), none.alias("done")), append, lambda acc: acc["done"])
    return F.concat(F.array(start), F.flatten(blocks))


def pair_hash(left: Column, right: Column) -> Column:
    """SHA-256 of two hex digests joined as text."""
    return F.sha2(F.concat(left, right), 256)


def next_level(level: Column) -> Column:
    """Parents of a level; an odd last node pairs with itself."""
    n = F.size(level)
    place = F.sequence(F.lit(0), F.greatest(F.ceil(n / 2).cast("int") - 1, F.lit(0)))
    return F.transform(place, lambda i: pair_hash(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.get(level, 2 * i))))


def levels_up(leaves: Column, steps: Column) -> Column:
    """Leaves and the ``steps`` levels above them; a single node pairs with itself."""
    each = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(each, F.array(leaves), lambda acc, _: F.concat(acc, F.array(next_level(F.element_at(acc, -1)))))


def levels(leaves: Column) -> Column:
    """All levels of the tree, leaves first; null without leaves."""
    steps = F.when(F.size(leaves) > 1, F.ceil(F.log2(F.size(leaves).cast("double"))).cast("int")).otherwise(0)
    return F.when(F.size(leaves) > 0, levels_up(leaves, steps))


def root(leaves: Column) -> Column:
    """Root digest; null without leaves."""
    return F.get(F.element_at(levels(leaves), -1), F.lit(0))


def proof_at(tree: Column, place: Column) -> Column:
    """Steps ``left:x`` or ``right:x`` from the leaf at a place to the root."""
    inner = F.when(F.size(tree) > 1, F.slice(tree, F.lit(1), F.size(tree) - 1)).otherwise(F.array().cast("array<array<string>>"))

    def step(level: Column, depth: Column) -> Column:
        i = F.floor(place / F.pow(F.lit(2.0), depth)).cast("int")
        sibling = F.when(i % 2 == 0, F.coalesce(F.get(level, i + 1), F.get(level, i))).otherwise(F.get(level, i - 1))
        return F.concat(F.when(i % 2 == 0, F.lit("right:")).otherwise(F.lit("left:")), sibling)

    return F.transform(inner, step)


def proof(tree: Column, leaf: Column) -> Column:
    """The proof of a leaf by its first place in level 0; null if it is no leaf."""
    place = (F.array_position(F.get(tree, F.lit(0)), leaf) - 1).cast("int")
    return F.when(place >= 0, proof_at(tree, place))


def walk(leaf: Column, steps: Column) -> Column:
    """Digest at the end of a proof; a step without a side is a right sibling."""

    def up(current: Column, step: Column) -> Column:
        other = F.regexp_replace(step, "^(left|right):", "")
        return F.when(step.startswith("left:"), pair_hash(other, current)).otherwise(pair_hash(current, other))

    return F.aggregate(steps, leaf, up)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in hex of a text (UTF-8) under a fixed key."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def link(previous: Column, message: Column) -> Column:
    """The next link of a hash chain: H(message ':' link before)."""
    return F.sha2(F.concat_ws(":", message, previous), 256)


def chain(genesis: Column, messages: Column) -> Column:
    """All links of a hash chain, genesis first."""
    return scan(messages, genesis, link)


def chain_tip(genesis: Column, messages: Column) -> Column:
    """The last link alone, without keeping the others."""
    return F.aggregate(messages, genesis, link)
