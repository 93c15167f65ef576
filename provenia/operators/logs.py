"""Memory, claims, audits, signatures and hash-chained trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.functions import integrity as I


def memory_search(memory: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """Entries by how many words of the query their text contains; words repeat and match inside words.

    An empty query matches all. Equal scores keep the order of threads and turns.
    """
    text = F.lower(F.concat_ws(" ", "query", "response", "tag"))
    words = F.split(F.lit(query.lower()), r"(?U)\s+")
    scored = memory.withColumn("score", F.size(F.filter(words, lambda w: F.contains(text, w)))).where("score > 0")
    return scored if limit is None else scored.orderBy(F.desc("score"), "thread_id", "turn").limit(limit)


def retrieve_tier(memory: DataFrame, query: str, tier: str = "") -> DataFrame:
    """Entries of a tier ('' for episodic and long_term) that contain the phrase or one of its words."""
    words = F.split(F.lit(query.lower()), r"(?U)\s+")
    text = F.lower("content")
    of = F.col("tier").isin("episodic", "long_term") if not tier else F.col("tier") == tier
    return memory.where(of & (F.contains(text, F.lit(query.lower())) | F.exists(words, lambda w: F.contains(text, w))))


def consolidate(memory: DataFrame) -> DataFrame:
    """Episodic entries that go to long-term memory: of each thread and hash the first, unless it is there already."""
    first = Window.partitionBy("thread_id", "sha256").orderBy("turn", "entry_id")
    fresh = memory.where("tier = 'episodic'").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return fresh.join(memory.where("tier = 'long_term'").select("thread_id", "sha256"), ["thread_id", "sha256"], "left_anti")


def routed(entries: DataFrame) -> DataFrame:
    """entries (entry_id, tier, content, key, thread_id) as they go to a tiered memory, with status, hash and defaults.

    corpus is read-only and refuses; working is acknowledged and not kept; any other tier stores.
    """
    status = F.when(F.col("tier") == "corpus", "rejected").when(F.col("tier") == "working", "acknowledged").otherwise("stored")
    key, thread = F.coalesce(F.nullif("key", F.lit("")), "entry_id"), F.coalesce(F.nullif("thread_id", F.lit("")), F.lit("default"))
    return entries.withColumns({"status": status, "key": key, "thread_id": thread, "sha256": F.sha2("content", 256)})


def saved(messages: DataFrame) -> DataFrame:
    """Entries of the plain memory from (at, content, tags): the content is the query, and tags are kept as evidence.

    So a search sees the content and not the tags.
    """
    stamped = F.sha2(F.concat_ws("|", F.col("at").cast("string"), "content", F.lit("")), 256)
    return messages.select("*", F.col("content").alias("query"), F.lit("").alias("response"), F.col("tags").alias("evidence"), F.lit("").alias("tag"), stamped.alias("sha256"))


def alive(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows (with at) but for those whose key was deleted (key, at) after they came."""
    gone = deleted.groupBy(F.col(key).alias("__gone")).agg(F.max("at").alias("__when"))
    return rows.join(gone, (F.col(key) == F.col("__gone")) & (F.col("at") < F.col("__when")), "left_anti")


def latest(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The newest row of each key (an upsert log read back); pre-aggregated before the shuffle."""
    others = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*by)).alias("r"))
    return newest.select(key, "r.*")


def signature(message: Column, key: bytes) -> Column:
    return I.hmac_sha256(message, key)


def tool_signature(name: Column, definition: Column, key: bytes) -> Column:
    """Base64 signature of a tool's name and definition."""
    return F.base64(F.unhex(I.hmac_sha256(F.concat_ws(":", name, F.sha2(definition, 256)), key)))


def receipt(tool: Column, given: Column, got: Column, key: bytes) -> Column:
    """Base64 signature of a call: tool, input hash, output hash."""
    return F.base64(F.unhex(I.hmac_sha256(F.concat_ws(":", tool, F.sha2(given, 256), F.sha2(got, 256)), key)))


def sessions(events: DataFrame) -> DataFrame:
    """(session_id, messages in order of time, genesis) of each session."""
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "type", "tool_name")))
    grouped = events.groupBy("session_id").agg(ordered.alias("events"))
    message = lambda e: F.sha2(F.concat_ws(":", e["event_id"].cast("string"), e["type"], e["tool_name"]), 256)
    genesis = F.sha2(F.concat_ws(":", F.col("session_id").cast("string"), F.date_format(F.get("events", F.lit(0))["ts"], "yyyy-MM-dd HH:mm:ss")), 256)
    return grouped.select("session_id", "events", F.transform("events", message).alias("messages"), genesis.alias("genesis"))


def signed_trail(messages: DataFrame, key: bytes) -> DataFrame:
    """messages (session_id, ts, event_id, message) with entry, their place in the session, message_hash and signature."""
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    return messages.withColumns({"entry": F.row_number().over(order).cast("long"), "message_hash": F.sha2("message", 256), "signature": signature(F.col("message"), key)})


def audit_chain(events: DataFrame) -> DataFrame:
    """(session_id, n, start_hash, current_hash) of each session's chain."""
    s = sessions(events)
    return s.select("session_id", F.size("messages").cast("long").alias("n"), F.col("genesis").alias("start_hash"), I.chain_tip(F.col("genesis"), F.col("messages")).alias("current_hash"))


def trail(events: DataFrame) -> DataFrame:
    """(session_id, start_hash, seq, message_hash, previous_hash): the entries of each session's chain.

    Each link needs the one before, so the links of a session are formed by one task.
    """
    s = sessions(events)
    entry = lambda links: F.transform(
        "messages", lambda m, i: F.struct(i.cast("long").alias("seq"), m.alias("message_hash"), F.get(links, i).alias("previous_hash"))
    )
    dealt = F.explode(I.let(I.chain(F.col("genesis"), F.col("messages")), entry)).alias("e")
    return s.select("session_id", F.col("genesis").alias("start_hash"), dealt).select("session_id", "start_hash", "e.*")


def verify_chain(entries: DataFrame) -> DataFrame:
    """(session_id, valid, broken_seq): the first entry whose previous_hash is not the recomputed link before it.

    entries as in ``trail``, numbered from 0 without gaps. Each entry forms one link, from its own previous_hash, and the next
    entry must hold it; the first must hold the start. Up to the first that does not, these links are those of the
    chain, so the least number is where it breaks, and no session is walked. An entry whose predecessor is missing
    breaks it too. A change of the last message alone is not seen, since no entry follows it.
    """
    made = entries.select(F.col("session_id").alias("s"), (F.col("seq") + 1).alias("n"), I.link(F.col("previous_hash"), F.col("message_hash")).alias("link"))
    pairs = entries.join(made, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("seq") == F.col("n")), "left")
    want = F.when(F.col("seq") == 0, F.col("start_hash")).otherwise(F.col("link"))
    out = pairs.groupBy("session_id").agg(F.min(F.when(~want.eqNullSafe(F.col("previous_hash")), F.col("seq"))).alias("broken_seq"))
    return out.select("session_id", F.col("broken_seq").isNull().alias("valid"), "broken_seq")


def counted(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in an order, with total, the number of all; the total is one row, joined to a few."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(limit).join(F.broadcast(total))
