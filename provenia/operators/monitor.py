"""Agent monitor: transitions, invariants, liveness; permissions, quotas and ceilings.

Sessions are folded as a parallel prefix: a kind of event is a map of states to states, a block of events the composition
of its maps, and blocks of blocks likewise. Once the state before a block is known, the block is replayed by itself, so a
session is dealt out over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.functions.integrity import let, scan
from provenia.streaming.place import fresh_folder

#: Transition table: event, states it leaves, state it leads to; anything else keeps the state. Fixed values.
TRANSITIONS = [
    ("user_message", ("idle", "done", "error"), "plan"),
    ("tool_call", ("plan", "act"), "act"),
    ("tool_result", ("act",), "verify"),
    ("commit", ("verify", "commit"), "commit"),
    ("subagent_spawn", ("plan", "act"), "act"),
    ("error", None, "error"),
]

#: Tools that only read. Fixed values.
READ_ONLY_TOOLS = [
    "cite_search", "cite_verify", "cite_render", "cite_node_lookup", "cite_tree", "cite_argument_query", "cite_memory_save",
    "audit_retrieve", "search_memory", "tree_load", "tree_traverse", "csl_render", "node_lookup",
]

#: Tools whose results are evidence. Fixed values.
EVIDENCE_TOOLS = ["search_documents", "search_claims", "cite_search", "cite_search_claims"]

RISK_TIERS = ["read", "workspace", "network", "system"]

#: Permission table: tools by tier; network needs approval, system approval and a sandbox. Fixed values.
TOOLS = {
    "read": [
        "search_documents", "cite_search", "search_claims", "cite_search_claims", "search_memory", "cite_search_memory",
        "tree_load", "cite_tree", "tree_traverse", "cite_tree_traverse", "csl_render", "cite_render", "node_lookup",
        "cite_node_lookup", "merkle_verify", "cite_verify", "ag_query_claims", "cite_argument_query",
        "ag_query_contradictions", "audit_retrieve", "cite_audit_retrieve", "memory_retrieve_tier",
        "cite_memory_retrieve_tier", "crypto_audit_trail", "cite_crypto_audit_trail",
    ],
    "workspace": [
        "index_claim", "cite_index_claim", "memory_save", "cite_memory_save", "memory_store_tier",
        "cite_memory_store_tier", "memory_consolidate", "cite_memory_consolidate", "memory_summarize", "merkle_compute",
        "cite_merkle_compute", "audit_save", "cite_audit_save", "crypto_sign", "cite_crypto_sign", "crypto_verify",
        "cite_crypto_verify", "safeharness_check", "cite_safeharness_check", "safeharness_sanitize",
        "cite_safeharness_sanitize",
    ],
    "network": [
        "bibliographic_verify", "cite_bibliographic_verify", "index_document", "cite_ingest", "tantivy_search",
        "cite_tantivy_search",
    ],
    "system": [
        "delete_document", "cite_delete_document", "ag_write_edge", "tantivy_index", "cite_tantivy_index",
        "regex_search", "cite_regex_search",
    ],
}


def next_state(state: Column, event: Column) -> Column:
    out = state
    for name, leaves, to in reversed(TRANSITIONS):
        fires = event == name if leaves is None else (event == name) & state.isin(*leaves)
        out = F.when(fires, F.lit(to)).otherwise(out)
    return out


#: An invariant: its name, error or warning, and the steps (state before, event, tool, state after) that break it.
Invariant = tuple[str, str, Callable[[Column, Column, Column, Column], Column]]

INVARIANTS: list[Invariant] = [
    ("VERIFY_BEFORE_COMMIT", "error", lambda prev, event, tool, new: (new == "commit") & (prev != "verify")),
    ("PLAN_BEFORE_ACT", "error", lambda prev, event, tool, new: (new == "act") & ~prev.isin("plan", "act")),
    ("NO_UNGRANTED_TOOL", "error", lambda prev, event, tool, new: (event == "tool_call") & new.isin("verify", "commit") & ~F.coalesce(tool.isin(*READ_ONLY_TOOLS), F.lit(False))),
    ("MERKLE_BEFORE_OUTPUT", "warning", lambda prev, event, tool, new: (event == "tool_call") & tool.isin(*EVIDENCE_TOOLS) & (new == "commit")),
]


def violations(prev: Column, event: Column, tool: Column, new: Column, invariants: list[Invariant] = INVARIANTS) -> Column:
    """array<struct<invariant, severity>> that a step breaks; LIVENESS is always met here and judged after the fact."""
    return F.array_compact(F.array(*(F.when(broken(prev, event, tool, new), F.struct(F.lit(n).alias("invariant"), F.lit(s).alias("severity"))) for n, s, broken in invariants)))


#: All states, the first one to begin with.
STATES = ("idle", *dict.fromkeys(to for _, _, to in TRANSITIONS), "done")
#: A block holds 2^BITS events, and a block of blocks as many of these.
BITS = 10


def step(state: str, event: str | None) -> str:
    """The transition in plain Python."""
    for name, leaves, to in TRANSITIONS:
        if event == name and (leaves is None or state in leaves):
            return to
    return state


def _numbers(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def _map_of(event: Column) -> Column:
    """The map of states to states, by number, of a kind of event; other kinds and null change nothing."""
    maps = [x for name, _, _ in TRANSITIONS for x in (F.lit(name), _numbers([STATES.index(step(s, name)) for s in STATES]))]
    return F.coalesce(F.try_element_at(F.create_map(*maps), event), _numbers(list(range(len(STATES)))))


def _after(first: Column, then: Column) -> Column:
    """Two maps, one after the other."""
    return F.transform(first, lambda s: F.get(then, s))


def _blocks(events: DataFrame) -> DataFrame:
    """(session_id, block, events) in order of sessions and time, 2^BITS events at most.

    Rows are sorted over all tasks and numbered in a table of its own, since their numbers are read twice.
    """
    order = ["session_id", "ts", "event_id", "type", "tool_name"]
    path = fresh_folder(events.sparkSession, "trace")
    events.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = events.sparkSession.read.parquet(path)
    return rows.groupBy("session_id", F.shiftright("row", BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("row", "event_id", "type", "tool_name"))).alias("events"))


def _prefixes(parts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """(keys, map, n, items): what all parts (map, n) of a group do together; items, for each part: map and n of all before it."""
    grouped = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(part).alias("part"), "map", "n"))).alias("x"))
    start = F.struct(_numbers(list(range(len(STATES)))).alias("map"), F.lit(0).cast("long").alias("n"))
    running = scan(F.col("x"), start, lambda s, x: F.struct(_after(s["map"], x["map"]).alias("map"), (s["n"] + x["n"]).alias("n")))
    items = lambda r: F.struct(F.transform("x", lambda x, i: F.struct(x["part"].alias("part"), F.get(r, i).alias("before"))).alias("items"), F.element_at(r, -1).alias("all"))
    return grouped.select(*keys, let(running, items).alias("p")).select(*keys, "p.all.map", "p.all.n", "p.items")


def _starts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_id, state after all events, n); and (session_id, block, state before it, seq of its first event)."""
    composed = F.aggregate("events", _numbers(list(range(len(STATES)))), lambda s, e: _after(s, _map_of(e["type"])))
    sized = blocks.select("session_id", "block", F.shiftright("block", BITS).alias("upper"), F.size("events").cast("long").alias("n"), composed.alias("map"))
    upper = _prefixes(sized, ["session_id", "upper"], "block")
    whole = _prefixes(upper, ["session_id"], "upper")
    names = F.array(*map(F.lit, STATES))
    tops = whole.select("session_id", F.explode("items").alias("i")).select(F.col("session_id").alias("s"), F.col("i.part").alias("u"), F.col("i.before").alias("above"))
    each = upper.select("session_id", "upper", F.explode("items").alias("i")).join(tops, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("upper") == F.col("u")))
    state = F.get(F.col("i.before.map"), F.get("above.map", F.lit(0)))
    starts = each.select(F.col("session_id").alias("s"), F.col("i.part").alias("b"), F.get(names, state).alias("state"), (F.col("above.n") + F.col("i.before.n")).alias("first"))
    return whole.select("session_id", F.get(names, F.get("map", F.lit(0))).alias("state"), "n"), starts


def final_states(events: DataFrame) -> DataFrame:
    """(session_id, state) after all events of each session, in order of time.

    Steps that an invariant rejects keep the state and are self-loops, so the plain fold has the same end.
    """
    return _starts(_blocks(events))[0].select("session_id", "state")


def trace(events: DataFrame, invariants: list[Invariant] = INVARIANTS) -> DataFrame:
    """One row per event: session_id, seq, event_id, type, tool_name, prev_state, next_state, violated, allowed.

    Each block is replayed from its true first state.
    """
    blocks = _blocks(events)
    begun = blocks.join(_starts(blocks)[1], F.col("session_id").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    states = scan(F.transform("events", lambda e: e["type"]), F.col("state"), next_state)

    def steps(states: Column) -> Column:
        return F.transform(
            "events",
            lambda e, i: F.struct(
                (F.col("first") + i).alias("seq"), e["event_id"].alias("event_id"), e["type"].alias("type"), e["tool_name"].alias("tool_name"),
                F.get(states, i).alias("prev_state"), F.get(states, i + 1).alias("next_state"),
            ),
        )

    rows = begun.select("session_id", F.explode(let(states, steps)).alias("x")).select("session_id", "x.*")
    rows = rows.withColumn("v", violations(F.col("prev_state"), F.col("type"), F.col("tool_name"), F.col("next_state"), invariants))
    return rows.select("*", F.array_join(F.transform("v", lambda x: x["invariant"]), ";").alias("violated"), (~F.exists("v", lambda x: x["severity"] == "error")).alias("allowed")).drop("v")


def unfinished_plans(steps: DataFrame) -> DataFrame:
    """(session_id, live): whether the last plan is followed by done."""
    last = lambda s: F.coalesce(F.max(F.when(F.col("next_state") == s, F.col("seq"))), F.lit(-1))
    return steps.groupBy("session_id").agg((last("plan") <= last("done")).alias("live"))


def unverified_commits(steps: DataFrame) -> DataFrame:
    """Commits with an evidence call since the last verification: session_id, event_id."""
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    call = F.max(F.when((F.col("type") == "tool_call") & F.col("tool_name").isin(*EVIDENCE_TOOLS), F.col("seq"))).over(before)
    checked = F.max(F.when(F.col("next_state") == "verify", F.col("seq"))).over(before)
    rows = steps.withColumn("call", call).withColumn("checked", F.coalesce(checked, F.lit(-1)))
    return rows.where((F.col("type") == "commit") & (F.col("call") > F.col("checked"))).select("session_id", "event_id")


def permission_table(spark, quotas: dict[str, int] | None = None) -> DataFrame:  # noqa: ANN001
    """tool_name, risk_tier, tier, requires_approval, sandbox_required, max_calls (null: no quota); a row a tool, so broadcast."""
    rows = [(t, tier, RISK_TIERS.index(tier), tier in ("network", "system"), tier == "system", (quotas or {}).get(t)) for tier, tools in TOOLS.items() for t in tools]
    return F.broadcast(spark.createDataFrame(rows, "tool_name string, risk_tier string, tier int, requires_approval boolean, sandbox_required boolean, max_calls int"))


def permission_check(calls: DataFrame, permissions: DataFrame, ceiling: str = "system") -> DataFrame:
    """calls (session_id, event_id, ts, tool_name) with decision and call_number.

    In order: unknown tool, tier above the ceiling, approval needed, quota used up, else allowed. Only allowed calls
    count against the quota; as the other grounds do not depend on it, these are numbered first.
    """
    rows = calls.join(permissions, "tool_name", "left")
    ground = F.when(F.col("risk_tier").isNull(), "unknown_tool").when(F.col("tier") > RISK_TIERS.index(ceiling), "above_ceiling").when(F.col("requires_approval"), "requires_approval")
    rows = rows.withColumn("ground", ground)
    order = Window.partitionBy("session_id", "tool_name", F.col("ground").isNull()).orderBy("ts", "event_id")
    rows = rows.withColumn("call_number", F.when(F.col("ground").isNull(), F.row_number().over(order)))
    over = F.col("max_calls").isNotNull() & (F.col("call_number") > F.col("max_calls"))
    return rows.withColumn("decision", F.coalesce("ground", F.when(over, "quota_exceeded"), F.lit("allow")))


def ceilings(anomalies: DataFrame) -> DataFrame:
    """(session_id, anomalies, ceiling): from the third anomaly on, each takes floor(n / 3) tiers off, down to read."""
    n = F.col("anomalies")
    lost = F.when(n < 3, 0).otherwise(F.aggregate(F.sequence(F.lit(3), F.greatest(n, F.lit(3)).cast("int")), F.lit(0), lambda acc, k: acc + F.floor(k / 3).cast("int")))
    tier = F.greatest(F.lit(len(RISK_TIERS) - 1) - lost, F.lit(0))
    return anomalies.select("session_id", "anomalies", F.get(F.array(*map(F.lit, RISK_TIERS)), tier.cast("int")).alias("ceiling"))


def pre_checks(calls: DataFrame, permissions: DataFrame) -> DataFrame:
    """calls (session_id, event_id, ts, tool_name, modified) with decision and the ceiling under which it fell.

    modified: whether the arguments had to be changed. An allowed call with such arguments is an anomaly; from the
    third on, each takes floor(n / 3) tiers off the session's ceiling, and a call that was allowed before may lie above
    it afterwards. Quotas count allowed calls. So each session is folded in order of time: a running value of ceiling,
    anomalies and calls of each tool with a quota.
    """
    known = calls.join(permissions, "tool_name", "left")
    fields = ("ts", "event_id", "tool_name", "modified", "tier", "requires_approval", "max_calls")
    grouped = known.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("calls"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    start = F.struct(F.lit(len(RISK_TIERS) - 1).alias("ceiling"), F.lit(0).alias("anomalies"), none.alias("used"), F.lit("").alias("decision"))

    def step(s: Column, c: Column) -> Column:
        used = F.coalesce(F.try_element_at(s["used"], c["tool_name"]), F.lit(0))
        ground = F.when(c["tier"].isNull(), "unknown_tool").when(c["tier"] > s["ceiling"], "above_ceiling").when(c["requires_approval"], "requires_approval")
        ground = ground.when(c["max_calls"].isNotNull() & (used >= c["max_calls"]), "quota_exceeded").otherwise("allow")

        def after(decision: Column) -> Column:
            fine = decision == "allow"
            odd = s["anomalies"] + (fine & c["modified"]).cast("int")
            lower = F.greatest(s["ceiling"] - F.floor(odd / 3).cast("int"), F.lit(0))
            others = F.map_filter(s["used"], lambda k, _: k != c["tool_name"])
            counted = F.map_concat(others, F.create_map(c["tool_name"], used + 1))
            return F.struct(
                F.when(fine & c["modified"], lower).otherwise(s["ceiling"]).alias("ceiling"), odd.alias("anomalies"),
                F.when(fine & c["max_calls"].isNotNull(), counted).otherwise(s["used"]).alias("used"), decision.alias("decision"),
            )

        return let(ground, after)

    def dealt(states: Column) -> Column:
        tiers = F.array(*map(F.lit, RISK_TIERS))
        return F.transform(
            "calls", lambda c, i: F.struct(c["event_id"].alias("event_id"), F.get(states, i + 1)["decision"].alias("decision"), F.get(tiers, F.get(states, i)["ceiling"]).alias("ceiling"))
        )

    return grouped.select("session_id", F.explode(let(scan(F.col("calls"), start, step), dealt)).alias("c")).select("session_id", "c.*")


def result_shape(tool: Column, result: Column) -> Column:
    """Whether a tool's result (a JSON text) has the shape that its callers need; a text that is no JSON has none.

    merkle_verify: a boolean valid; csl_render: a string output; searches and argument queries: an array results.
    """
    parsed = F.try_parse_json(result)

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), F.lit(""))

    listed = tool.startswith("search_") | tool.isin("ag_query_claims", "ag_query_contradictions")
    return F.when(tool == "merkle_verify", kind("$.valid") == "BOOLEAN").when(tool == "csl_render", kind("$.output") == "STRING").when(listed, kind("$.results").startswith("ARRAY")).otherwise(F.lit(True))
