"""The tools of the engine by name: searches, checks and the calls that change state.

``call`` answers like a tool server: the name may carry the prefix ``cite_``, and any error becomes a structured result.
Calls that read give a DataFrame; those that write, or judge one thing, give a dict.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import posixpath
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.functions import integrity as I
from provenia.functions.text import ROLES, citation, doi_key, first_field, in_text, redact
from provenia.operators import evidence, index, logs, monitor, patterns, search, workspace
from provenia.sources.store import Store, new_id
from provenia.sources.tables import read_json_corpus

HOUR = 3_600_000_000_000


class ToolError(Exception):
    def __init__(self, code: str, message: str, next_action: str = "") -> None:
        super().__init__(message)
        self.code, self.message, self.next_action = code, message, next_action


def limit_of(value: object, default: int = 10) -> int:
    """A limit argument: nothing, zero and '' mean the default; a negative or non-numeric one is an error."""
    try:
        n = int(value or default)
    except (TypeError, ValueError):
        n = -1
    if n < 0:
        raise ToolError("INVALID_ARGUMENT", f"limit: {value!r}", "Give a whole number.")
    return n


def slug(value: str) -> str:
    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", value or ""):
        raise ToolError("INVALID_ARGUMENT", f"id: {value!r}", "Use lower-case letters, digits, - and _.")
    return value


def source_fields(csl: DataFrame) -> DataFrame:
    """Records of a JSON corpus in the columns that the engine reads."""
    year = F.get(F.get("issued.date-parts", F.lit(0)), F.lit(0))
    return csl.select(F.col("key").alias("id"), "title", "author", year.alias("year"), F.col("container-title").alias("container"), first_field(F.col("DOI")).alias("doi"), "merkle_root")


@dataclass
class Engine:
    """nodes and sources: a corpus to start from, as of sources.tables and source_fields; the store adds to it.

    catalogue (doi, title, and the service's http_status if it has one) stands for a bibliographic service; without one,
    records are unavailable. outlines: trees of outside tools, see tables.read_outlines; sources without one have the
    tree of their passages. permissions, invariants: see monitor. key: the master key of signatures, from which each
    session's own is derived; without one nothing is signed. ingest_root: files outside it are not read.
    """

    spark: SparkSession
    store: Store
    nodes_base: DataFrame | None = None
    sources_base: DataFrame | None = None
    catalogue: DataFrame | None = None
    permissions: DataFrame | None = None
    outlines: DataFrame | None = None
    invariants: list[monitor.Invariant] = field(default_factory=lambda: list(monitor.INVARIANTS))
    key: bytes | None = None
    ingest_root: str | None = None
    _index: index.SearchIndex | None = None
    _patterns: patterns.PatternIndex | None = None

    # ------------------------------------------------------------ relations
    def _alive(self, log: str, base: DataFrame | None, source: str) -> DataFrame:
        """Rows of the base and the log but for those of sources deleted after they came."""
        rows = self.store.read(log)
        if base is not None:
            rows = rows.unionByName(base.withColumn("at", F.lit(0).cast("long")), allowMissingColumns=True)
        return logs.alive(rows, self.store.read("deleted").withColumnRenamed("source_id", source), source)

    def nodes(self) -> DataFrame:
        return self._alive("nodes", self.nodes_base, "source_id").drop("at")

    def sources(self) -> DataFrame:
        return logs.latest(self._alive("sources", self.sources_base, "id"), "id", ["at"]).drop("at")

    def approved(self) -> DataFrame | None:
        """Sources of the active paper; None without one, which scopes nothing."""
        paper = self.active()
        return None if paper is None else self._paper_sources(paper)

    def active(self) -> str | None:
        row = self.store.newest("active", "state").first()
        return row.paper_id if row else None

    def _paper_sources(self, paper: str) -> DataFrame:
        """A paper made anew starts without sources."""
        made, added = (self.store.read(log).where(F.col("paper_id") == paper) for log in ("papers", "paper_sources"))
        return workspace.paper_sources(made, added)

    def _allowed(self, source_id: str) -> None:
        scope = self.approved()
        if scope is not None and scope.where(F.col("source_id") == source_id).isEmpty():
            raise ToolError("SOURCE_NOT_APPROVED", f"{source_id} is no source of the active paper", "Add it with paper_add_source.")

    def _scoped(self, rows: DataFrame) -> DataFrame:
        scope = self.approved()
        return rows if scope is None else search.in_scope(rows, scope)

    # ------------------------------------------------------------ documents
    def build_index(self) -> index.SearchIndex:
        """Index all passages; searches use it, and documents that come or go are added to it or deleted from it."""
        self._index = index.build_index(search.with_titles(self.nodes(), self.sources()), f"{self.store.root}/index/{new_id()}")
        return self._index

    def _hits(self, query: str, limit: int) -> DataFrame:
        """The best passages over text, title and section, through the index if there is one."""
        if self._index is not None:
            return search.fetched(self._index.search(query, limit))
        return search.fetched(search.ranked_search(search.with_titles(self.nodes(), self.sources()), query, limit, fields=search.FIELDS))

    def search_documents(self, query: str, limit: object = 10) -> DataFrame:
        """The scope applies after the best hits are taken, so there may be fewer than the limit."""
        hits = self._scoped(self._hits(query, limit_of(limit)))
        return search.cited(hits, search.of_sources(self.nodes(), hits), self.sources())

    def regex_search(self, pattern: str, source_id: str | None = None, limit: object = 10, context_chars: object = 120) -> DataFrame:
        if self._patterns is not None:
            return self._scoped(self._patterns.search(pattern, source_id, limit_of(limit), limit_of(context_chars, 120)))
        return self._scoped(search.regex_search(self.nodes(), pattern, source_id, limit_of(limit), limit_of(context_chars, 120)))

    def build_pattern_index(self) -> patterns.PatternIndex:
        """Index all passages by trigrams; searches by pattern use it until documents come or go."""
        self._patterns = patterns.build_pattern_index(self.nodes(), f"{self.store.root}/patterns/{new_id()}")
        return self._patterns

    def node_lookup(self, node_id: str) -> DataFrame:
        found = self.nodes().where(F.col("node_id") == node_id).limit(1)
        row = found.select("source_id").first()
        if row:
            self._allowed(row.source_id)
        return found

    def index_document(self, path: str, metadata: dict | None = None, force: bool = False) -> dict:
        """Ingest a text file: one passage for each line that is not blank. The source's id is the file's base name."""
        self._inside(path)
        name = re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])
        rows = _lines(self.spark.read.text(path, wholetext=True).select(F.lit(name).alias("source_id"), "value"))
        said = {c: F.lit((metadata or {}).get(c)) for c in ("title", "year", "container", "doi")}
        author = self.spark.createDataFrame([((metadata or {}).get("author") or [],)], "author array<struct<family:string,given:string>>")
        self._ingest(rows, self.spark.range(1).select(F.lit(name).alias("id"), *(v.alias(c) for c, v in said.items())).join(F.broadcast(author)))  # one row
        return {"status": "ingested", "source_id": name}

    def index_documents(self, folder: str, pattern: str = "*.txt") -> dict:
        """Ingest all text files of a folder in a few jobs, as index_document does one; a source for each base name."""
        self._inside(folder)
        files = self.spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
        base = F.url_decode(F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1))
        files = files.select(F.regexp_replace(base, r"\.[^.]*$", "").alias("source_id"), "value")
        records = files.select(F.col("source_id").alias("id")).distinct()
        return {"status": "ingested", "sources": self._ingest(_lines(files), records)}

    def index_corpus(self, root: str) -> dict:
        """Ingest a corpus of JSON documents (see tables.read_json_corpus): its passages and its records."""
        self._inside(root)
        found = read_json_corpus(self.spark, root)
        year = F.get(F.get("issued.date-parts", F.lit(0)), F.lit(0))
        records = found.csl.select("id", "title", year.alias("year"), F.col("container-title").alias("container"), F.col("DOI").alias("doi"), "author")
        return {"status": "ingested", "sources": self._ingest(found.nodes, records)}

    def _inside(self, path: str) -> None:
        clean = posixpath.normpath(path)
        if self.ingest_root is not None and not f"{clean}/".startswith(posixpath.normpath(self.ingest_root) + "/"):
            raise ToolError("INVALID_ARGUMENT", f"path: {path!r} lies outside {self.ingest_root}", "Give a file below the ingest root.")

    def _ingest(self, nodes: DataFrame, records: DataFrame) -> int:
        """Passages and records (id and any of a source's columns) in place of older editions; the index takes them in. Returns how many records."""
        ids = records.select(F.col("id").alias("source_id")).distinct()
        self.store.append("deleted", ids.withColumn("at", F.lit(self.store.now())))  # older editions give way
        self.store.append("nodes", nodes.withColumn("at", F.lit(self.store.now())))
        rooted = records.join(evidence.roots(nodes).select(F.col("source_id").alias("id"), F.col("root").alias("merkle_root")), "id", "left")
        blank = self.store.read("sources").limit(0).drop("at")
        self.store.append("sources", blank.unionByName(rooted, allowMissingColumns=True).withColumn("at", F.lit(self.store.now())))
        self._patterns = None
        if self._index is not None:
            titled = search.with_titles(nodes, self.sources().join(ids.withColumnRenamed("source_id", "id"), "id", "left_semi"))
            self._index = self._index.delete(ids).add(titled).merged()
        return ids.count()

    def delete_document(self, source_id: str) -> dict:
        self._allowed(source_id)
        if self.sources().where(F.col("id") == source_id).isEmpty() and self.nodes().where(F.col("source_id") == source_id).isEmpty():
            return {"status": "not_found", "source_id": source_id}
        self.store.append("deleted", [{"source_id": source_id}])
        self._patterns = None
        if self._index is not None:
            self._index = self._index.delete([source_id])
        return {"status": "deleted", "source_id": source_id}

    def _outline(self, source_id: str) -> DataFrame | None:
        if self.outlines is None or self.outlines.where(F.col("source_id") == source_id).isEmpty():
            return None
        return self.outlines.where(F.col("source_id") == source_id)

    def tree_load(self, source_id: str, depth: int | None = None) -> DataFrame:
        self._allowed(source_id)
        outline = self._outline(source_id)
        tree = workspace.document_tree(self.nodes().where(F.col("source_id") == source_id)) if outline is None else outline
        return tree if depth is None else tree.where(F.col("depth") <= depth)

    def tree_traverse(self, source_id: str, path: str = "/") -> DataFrame:
        self._allowed(source_id)
        outline = self._outline(source_id)
        return workspace.traverse(self.tree_load(source_id), path) if outline is None else workspace.outline_at(outline, source_id, path)

    # ------------------------------------------------------------ claims, memory, audits, signatures
    def index_claim(self, claim_text: str, source_id: str = "default", metadata: dict | None = None) -> dict:
        more = metadata or {}
        row = {"claim_id": new_id("claim-"), "source_id": source_id, "claim_text": claim_text, "polarity": more.get("polarity"), "entities": more.get("entities")}
        self.store.append("claims", [row])
        return {"status": "indexed", "claim_id": row["claim_id"]}

    def ag_query_claims(self, claim_id: str | None = None, source_id: str = "default", limit: object = 10) -> DataFrame:
        rows = self.store.read("claims").where(F.col("source_id") == (source_id or "default"))
        rows = rows if claim_id is None else rows.where(F.col("claim_id") == claim_id)
        return rows.orderBy("at", "claim_id").limit(limit_of(limit))

    def search_claims(self, query: str = "", limit: object = 10) -> DataFrame:
        """The query is not read, as in the tool of that name; claims of the default source."""
        return self.ag_query_claims(limit=limit)

    def ag_query_contradictions(self, claim_id: str | None = None, limit: object = 10) -> DataFrame:
        """Always empty: contradictions are not recorded."""
        return self.store.read("claims").limit(0)

    def argument_query(self, claim_id: str | None = None, find_contradictions: bool = False) -> DataFrame:
        return self.ag_query_contradictions(claim_id) if find_contradictions else self.ag_query_claims(claim_id)

    def _remember(self, tier: str, thread: str, content: str, query: str, response: str, tags: list[str] | None, evidence: list[str] | None) -> dict:
        at = self.store.now()
        row = {"entry_id": new_id(), "thread_id": thread, "turn": at, "at": at, "tier": tier, "query": query, "response": response, "content": content, "tag": " ".join(tags or []), "evidence": evidence}
        text = content if tier else f"{at}|{query}|{response}"
        rows = self.spark.createDataFrame([(text,)], "hashed string").withColumn("sha256", F.sha2("hashed", 256))
        self.store.append("memory", [row | {"sha256": rows.first().sha256}])
        return {"status": "saved", "entry_id": row["entry_id"]}

    def memory_save(self, content: str, tags: list[str] | None = None, metadata: dict | None = None) -> dict:
        """The content is the entry's query, and the tags go to its evidence: search_memory does not see them."""
        return self._remember("", (metadata or {}).get("thread_id", "default"), content, content, "", None, tags)

    def search_memory(self, query: str, thread_id: str | None = None, limit: object = 10) -> DataFrame:
        """With total, the number of all entries that match."""
        rows = self.store.read("memory").where("tier = ''")
        found = logs.memory_search(rows if thread_id is None else rows.where(F.col("thread_id") == thread_id), query, None)
        return logs.counted(found, [F.desc("score"), F.col("thread_id"), F.col("turn")], limit_of(limit))

    def memory_store_tier(self, content: str, tier: str, key: str | None = None, tags: list[str] | None = None, thread_id: str = "default", source_ids: list[str] | None = None) -> dict:
        """corpus is read-only and refuses; working is acknowledged but not kept."""
        if tier == "corpus":
            return {"status": "rejected", "tier": tier}
        if tier == "working":
            return {"status": "acknowledged", "tier": tier}
        out = self._remember(slug(tier), thread_id, content, "", "", tags, source_ids)
        return out | {"tier": tier, "key": key or out["entry_id"]}

    def memory_retrieve_tier(self, query: str, tier: str = "", limit: object = 10) -> DataFrame:
        """With total, the number of all entries that match."""
        rows = logs.retrieve_tier(self.store.read("memory").where("tier <> ''"), query, tier)
        return logs.counted(rows, [F.col("at"), F.col("entry_id")], limit_of(limit))

    def memory_discard(self, entry_id: str, reason: str = "") -> dict:
        """Entries of the corpus cannot be discarded; of others the discard is acknowledged, and the log keeps them."""
        kept = entry_id.startswith("corpus-")
        return {"discarded": not kept, "reason": f"{entry_id}: the corpus is read-only" if kept else f"{entry_id}: {reason}"}

    def memory_consolidate(self, thread_id: str | None = None) -> dict:
        rows = self.store.read("memory")
        fresh = logs.consolidate(rows if thread_id is None else rows.where(F.col("thread_id") == thread_id))
        before = self.store.read("memory").where("tier = 'long_term'").count()
        self.store.append("memory", fresh.withColumn("tier", F.lit("long_term")).withColumn("at", F.lit(self.store.now())))
        return {"status": "consolidated", "moved": self.store.read("memory").where("tier = 'long_term'").count() - before}

    def audit_save(self, audit_id: str, verdict: str, reasoning: str = "", evidence_hashes: list[str] | None = None, query: str = "") -> dict:
        self.store.append("audits", [{"audit_id": slug(audit_id), "verdict": verdict, "reasoning": reasoning, "evidence_hashes": evidence_hashes or [], "query": query}])
        return {"status": "saved", "audit_id": audit_id}

    def audit_retrieve(self, audit_id: str) -> DataFrame:
        found = logs.latest(self.store.read("audits").where(F.col("audit_id") == audit_id), "audit_id", ["at"])
        if found.isEmpty():
            raise ToolError("AUDIT_NOT_FOUND", f"no audit {audit_id}", "Save it with audit_save.")
        return found

    def _one(self, **columns: F.Column) -> dict:
        return self.spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict(recursive=True)

    def _key(self, session_id: str) -> bytes:
        if not self.key:
            raise ToolError("KEY_MISSING", "there is no master key", "Give the engine a key of your own.")
        return hmac.digest(self.key, session_id.encode(), hashlib.sha256)

    def crypto_sign(self, message: str, session_id: str) -> dict:
        out = self._one(message_hash=F.sha2(F.lit(message), 256), signature=logs.signature(F.lit(message), self._key(session_id)))
        self.store.append("signatures", [out | {"session_id": session_id}])
        return out

    def crypto_verify(self, message: str, signature: str, session_id: str = "") -> dict:
        return self._one(valid=logs.signature(F.lit(message), self._key(session_id)) == signature)

    def crypto_audit_trail(self, session_id: str) -> DataFrame:
        return self.store.read("signatures").where(F.col("session_id") == session_id).orderBy("at")

    # ------------------------------------------------------------ integrity and citations
    def merkle_compute(self, payload: str) -> dict:
        return self._one(hash=F.sha2(F.lit(payload), 256), root=F.sha2(F.lit(payload), 256))

    def merkle_verify(self, node_hash: str = "", proof: list[str] | None = None, root: str = "", node_id: str | None = None) -> dict:
        """A proof against the registered roots; node_id stands for a passage's hash and its source's root."""
        forest = evidence.roots(self.nodes())
        if node_id is not None:
            node = self.nodes().where(F.col("node_id") == node_id).join(forest.select("source_id", "root"), "source_id").select("sha256", "root").first()
            if node is None:
                return {"valid": False, "error": f"no passage {node_id}"}
            node_hash, root = node.sha256, node.root
        claim = self.spark.createDataFrame([(node_hash, proof or [], root)], "node_hash string, proof array<string>, root string")
        found = evidence.registry_match(claim, forest.where(F.col("root") == root))
        return found.select("valid", "computed_hash", "registry_verified", "verified_sources").first().asDict()

    def csl_render(self, citation_key: str, style: str = "apa") -> dict:
        rows = self.sources().where(F.col("id") == citation_key)
        row = rows.select(citation(style, *map(F.col, ("author", "year", "title", "container"))).alias("output"), in_text(style, F.col("id"), F.col("author"), F.col("year")).alias("in_text")).first()
        return row.asDict() if row else {"output": f"[{citation_key}] Citation key not found in corpus", "in_text": f"[{citation_key}]", "note": "unknown key"}

    def render(self, citation_key: str, style: str = "chicago-author-date") -> dict:
        return self.csl_render(citation_key, style)

    def bibliographic_verify(self, citation_key: str) -> dict:
        rows = self.sources().where(F.col("id") == citation_key).select(F.col("id").alias("key"), "doi", "title")
        catalogue = self.catalogue if self.catalogue is not None else self.spark.createDataFrame([], "doi string, title string")
        status = F.lit(200 if self.catalogue is not None else None).cast("int")
        if "http_status" in catalogue.columns:  # what the service answered to this record's DOI, else that it was there
            answer = catalogue.select(doi_key(F.col("doi")).alias("k"), "http_status").groupBy("k").agg(F.first("http_status").alias("http_status"))
            rows = rows.withColumn("k", doi_key(F.coalesce("doi", F.lit("")))).join(answer, "k", "left").drop("k")
            status = F.coalesce("http_status", status)
        row = workspace.bibliographic_status(rows.withColumn("http_status", status), catalogue).first()
        return {"key": citation_key, "status": row.status if row else "unresolvable", "method": row.method if row else None}

    # ------------------------------------------------------------ safety
    def safeharness_sanitize(self, input: dict, tool_name: str = "") -> dict:  # noqa: A002
        """Text arguments redacted and cut, also those of inner objects; lists stay. All of them in one job.

        Each text gets a mark of where it came from beside it, which says whether anything was changed up to there.
        """
        texts: list[str] = []

        def gather(v: object) -> None:
            for x in v.values() if isinstance(v, dict) else ():
                gather(x) if isinstance(x, dict) else texts.append(x) if isinstance(x, str) else None

        gather(input)
        rows = redact(self.spark.createDataFrame([*enumerate(texts)], "k int, t string"), "t").collect() if texts else []
        done = iter(sorted(rows))
        hits, at = 0, self.store.now()

        def put(v: dict) -> dict:
            nonlocal hits
            out: dict = {}
            for k, x in v.items():
                if isinstance(x, dict):
                    out[k] = put(x)
                elif isinstance(x, str):
                    row = next(done)
                    hits += row.modifications
                    out[k] = row.t
                    out[f"_{k}_provenance"] = {"source_id": tool_name, "trust_level": "unverified", "sanitized": hits > 0, "timestamp": at}
                else:
                    out[k] = x
            return out

        return {"input": put(input), "modifications": hits, "sanitized": hits > 0}

    def _permissions(self) -> DataFrame:
        return self.permissions if self.permissions is not None else monitor.permission_table(self.spark)

    def ceiling(self, session_id: str = "default") -> str:
        """The highest tier that a session may still use: anomalies lower it."""
        past = self.store.read("calls").where((F.col("session_id") == session_id) & F.col("anomaly"))
        return monitor.ceilings(past.agg(F.count("*").alias("anomalies")).withColumn("session_id", F.lit(session_id))).first().ceiling

    def _decide(self, tool_name: str, session_id: str) -> tuple[str, str]:
        """(decision, tier) on a session's next call; allowed calls before it count against the quota."""
        row = self._permissions().where(F.col("tool_name") == tool_name).first()
        if row is None:
            return "unknown_tool", "system"
        if row.tier > monitor.RISK_TIERS.index(self.ceiling(session_id)):
            return "above_ceiling", row.risk_tier
        if row.requires_approval:
            return "requires_approval", row.risk_tier
        used = self.store.read("calls").where((F.col("session_id") == session_id) & (F.col("tool_name") == tool_name) & (F.col("decision") == "allow"))
        if row.max_calls is not None and used.count() >= row.max_calls:
            return "quota_exceeded", row.risk_tier
        return "allow", row.risk_tier

    def safeharness_check(self, tool_name: str, args: dict | None = None, session_id: str = "default") -> dict:
        """Judge a call before it is made, and remember it: quotas, anomalies and the ceiling go on from call to call."""
        decision, tier = self._decide(tool_name, session_id)
        out = {"allowed": decision == "allow", "decision": decision, "risk_tier": tier}
        if decision == "allow":
            out |= self.safeharness_sanitize(args or {}, tool_name)
        self.store.append("calls", [{"session_id": session_id, "tool_name": tool_name, "decision": decision, "anomaly": bool(out.get("sanitized"))}])
        return out

    def report_anomaly(self, tool_name: str, session_id: str = "default") -> str:
        """Note an anomaly that was seen after a call; the ceiling from now on."""
        self.store.append("calls", [{"session_id": session_id, "tool_name": tool_name, "decision": "reported", "anomaly": True}])
        return self.ceiling(session_id)

    def checkpoint(self, tool_name: str, args: dict) -> dict:
        """Note the state before a call that writes."""
        n = self.store.read("checkpoints").count() + 1
        row = {"checkpoint_id": f"ckpt-{n}-{self.store.now()}", "tool_name": tool_name, "input_hash": hashlib.sha256(json.dumps(args, sort_keys=True, default=str).encode()).hexdigest(), "rollback_available": True}
        self.store.append("checkpoints", [row])
        return row

    # ------------------------------------------------------------ the monitor, and hooks around calls
    def monitor_trace(self, session_id: str) -> DataFrame:
        """Steps of a session since its last reset."""
        rows = self.store.read("agent_events").where(F.col("session_id") == session_id)
        reset = F.broadcast(rows.where("type = 'reset'").agg(F.coalesce(F.max("at"), F.lit(-1)).alias("reset")))  # one row
        rows = rows.join(reset, F.col("at") > F.col("reset"))
        return monitor.trace(rows.select("session_id", F.col("at").alias("event_id"), F.col("at").alias("ts"), "type", "tool_name"), self.invariants)

    def monitor_state(self, session_id: str) -> str:
        last = self.monitor_trace(session_id).agg(F.max_by("next_state", "seq").alias("state")).first()
        return last.state or "idle"

    def monitor_event(self, session_id: str, kind: str, tool_name: str = "") -> dict:
        """One more event; the step that it takes. A step that an error forbids leaves the state as it was."""
        self.store.append("agent_events", [{"session_id": session_id, "type": kind, "tool_name": tool_name}])
        return self.monitor_trace(session_id).orderBy(F.desc("seq")).first().asDict()

    def monitor_reset(self, session_id: str) -> None:
        self.store.append("agent_events", [{"session_id": session_id, "type": "reset", "tool_name": ""}])

    def _chained(self, session_id: str, kind: str, tool_name: str, payload: object) -> str:
        """Add to the session's hash chain; the new link."""
        said = json.dumps(payload, sort_keys=True, default=str)
        past = self.store.read("trail").where(F.col("session_id") == session_id).agg(F.max_by(F.struct("previous_hash", "message_hash"), "at").alias("last")).first().last
        link = lambda before, message: hashlib.sha256(f"{message}:{before}".encode()).hexdigest()
        before = link(past.previous_hash, past.message_hash) if past else hashlib.sha256(session_id.encode()).hexdigest()
        message = hashlib.sha256(f"{kind}:{tool_name}:{said}".encode()).hexdigest()
        self.store.append("trail", [{"session_id": session_id, "kind": kind, "tool_name": tool_name, "message_hash": message, "previous_hash": before}])
        return link(before, message)

    def before_call(self, tool_name: str, args: dict | None = None, session_id: str = "default") -> dict:
        """Before a host runs a tool: arguments cleaned, the monitor's step taken, the request chained; may refuse."""
        clean = self.safeharness_sanitize(args or {}, tool_name)["input"]
        step = self.monitor_event(session_id, "tool_call", tool_name)
        if not step["allowed"]:
            raise ToolError("BLOCKED", f"{tool_name}: {step['violated']}", "Verify, or plan, before this call.")
        self._chained(session_id, "request", tool_name, clean)
        return clean

    def after_call(self, tool_name: str, args: dict, output: str, session_id: str = "default") -> dict:
        """After a host ran a tool: its result's shape checked, the response chained and signed, evidence in it judged."""
        shaped = self._one(ok=monitor.result_shape(F.lit(tool_name), F.lit(output)))["ok"]
        if not shaped:
            self.report_anomaly(tool_name, session_id)
        self._chained(session_id, "response", tool_name, output[:100])
        given = json.dumps(args, sort_keys=True, default=str)
        receipt = self._one(r=logs.receipt(F.lit(tool_name), F.lit(given), F.lit(output), self._key(session_id)))["r"]
        return {"shape_ok": shaped, "receipt": receipt, "evidence": self._judged(output)}

    def _judged(self, output: str) -> str | None:
        """Overall verdict on the items of a result that carry a proof; None if none do."""
        try:
            found = json.loads(output)
        except ValueError:
            return None
        items = [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict) and "merkle_proof" in x and "sha256" in x]
        if not items:
            return None
        names = ("node_id", "source_id", "sha256", "citation_key", "citation_rendered")
        rows = self.spark.createDataFrame([(*(x.get(n) for n in names), x["merkle_proof"]) for x in items], ", ".join(f"{n} string" for n in names) + ", merkle_proof array<string>")
        nodes = self.nodes()
        rendered = self.sources().select("id", citation("apa", *map(F.col, ("author", "year", "title", "container"))).alias("citation"))
        bad = evidence.ladder(rows, nodes, evidence.roots(nodes), rendered).where("overall = 'rejected'")
        return "pending_audit" if bad.isEmpty() else "rejected"

    def compacting(self, session_id: str = "default") -> list[str]:
        """What a host should keep when it shortens a session."""
        out = ["Keep citation keys, proofs and verdicts; drop no evidence whose hash cannot be checked again."]
        steps = self.monitor_trace(session_id)
        if not monitor.unfinished_plans(steps).where("not live").isEmpty():
            out.append("A plan was begun and not brought to an end.")
        n = self.store.read("trail").where(F.col("session_id") == session_id).count()
        if n:
            out.append(f"Audit trail of session {session_id}: {n} entries.")
        return out

    # ------------------------------------------------------------ papers, sessions, workflows
    def paper_create(self, paper_id: str, title: str, question: str) -> dict:
        self.store.append("papers", [{"paper_id": slug(paper_id), "title": title.strip(), "question": question.strip()}])
        return {"status": "created", "paper_id": paper_id}

    def _paper(self, paper_id: str | None) -> str:
        name = paper_id or self.active()
        if name is None or self.store.read("papers").where(F.col("paper_id") == name).isEmpty():
            raise ToolError("PAPER_NOT_FOUND", f"paper: {name}", "Make it with paper_create and choose it with paper_use.")
        return name

    def paper_add_source(self, paper_id: str, source_id: str, role: str = "unknown") -> dict:
        if role not in ROLES:
            raise ToolError("INVALID_ARGUMENT", f"role: {role!r}", f"One of {', '.join(ROLES)}.")
        if self.nodes().where(F.col("source_id") == source_id).isEmpty() and self.sources().where(F.col("id") == source_id).isEmpty():
            raise ToolError("SOURCE_NOT_FOUND", f"no source {source_id}", "Ingest it with index_document.")
        self.store.append("paper_sources", [{"paper_id": self._paper(paper_id), "source_id": source_id, "role": role}])
        return {"status": "added", "paper_id": paper_id, "source_id": source_id, "role": role}

    def paper_use(self, paper_id: str) -> dict:
        self.store.append("active", [{"state": "paper", "paper_id": self._paper(paper_id)}])
        return {"status": "active", "paper_id": paper_id}

    def paper_status(self) -> dict:
        name = self.active()
        if name is None:
            return {"status": "no_active_paper"}
        row = logs.latest(self.store.read("papers").where(F.col("paper_id") == name), "paper_id", ["at"]).first()
        return {"status": "active", "paper_id": name, "title": row.title, "question": row.question, "sources": self._paper_sources(name).count()}

    def paper_audit(self, paper_id: str | None = None) -> dict:
        name = self._paper(paper_id)
        known = self.sources().select(F.col("id").alias("source_id")).unionByName(self.nodes().select("source_id"))
        row = workspace.paper_audit(self._paper_sources(name), known).first()
        return row.asDict() if row else {"paper_id": name, "source_count": 0, "primary_count": 0, "missing_count": 0, "status": "incomplete"}

    def state_record_session(self, session_id: str, topics: list[str] | None = None, source_ids: list[str] | None = None, open_questions: list[str] | None = None) -> dict:
        self.store.append("sessions", [{"session_id": slug(session_id), "topics": topics or [], "source_ids": source_ids or [], "open_questions": open_questions or []}])
        return {"status": "recorded", "session_id": session_id}

    def _sessions(self, n: int) -> DataFrame:
        return self.store.newest("sessions", "session_id").orderBy(F.desc("at"), "session_id").limit(n)

    def state_wake_up(self, limit: object = 3) -> DataFrame:
        return self._sessions(min(limit_of(limit, 3), 20))

    def state_snapshot(self) -> dict:
        rows = self._sessions(20).collect()
        return {"sessions": len(rows), "latest": rows[0].asDict() if rows else None}

    def workflow_start(self, topic: str, limit: object = 20) -> dict:
        """Needs an active paper whose sources are all there, and at least one hit in them that verifies."""
        if not topic.strip():
            raise ToolError("INVALID_ARGUMENT", "topic is blank", "Give a topic.")
        audit = self.paper_audit()
        if audit["source_count"] == 0 or audit["missing_count"]:
            raise ToolError("SOURCES_INCOMPLETE", f"sources of {audit['paper_id']}: {audit['missing_count']} missing of {audit['source_count']}", "Complete them first.")
        hits = search.fetched(self._scoped(self._hits(topic, limit_of(limit, 20))))
        own = search.of_sources(self.nodes(), hits)
        n = evidence.verify_nodes(own.join(hits.select("node_id"), "node_id", "left_semi"), own).where("valid").count()
        if n == 0:
            raise ToolError("NO_VERIFIED_EVIDENCE", f"nothing verified on {topic!r}", "Add sources or change the topic.")
        at = self.store.now()
        row = {"workflow_id": new_id(), "topic": topic.strip(), "evidence_count": n, "stage": 0, "end": "open", "saved": at}
        self.store.append("workflows", [row])
        return {"status": "checkpoint", "workflow_id": row["workflow_id"], "stage": workspace.STAGES[0], "evidence_count": n}

    def workflow_resume(self, workflow_id: str, choice: str = "proceed") -> dict:
        """proceed (and any unknown choice) goes on and renews the hour to live; refine repeats; abort ends."""
        if not re.fullmatch(r"(?i)[a-f0-9-]{8,36}", workflow_id or ""):
            raise ToolError("INVALID_ARGUMENT", f"workflow_id: {workflow_id!r}", "Use the id of workflow_start.")
        row = logs.latest(self.store.read("workflows").where(F.col("workflow_id") == workflow_id), "workflow_id", ["at"]).first()
        now = self.store.now()
        if row is None or row.end != "open" or now - row.saved > HOUR:
            raise ToolError("WORKFLOW_NOT_FOUND", f"no open workflow {workflow_id}", "Start one with workflow_start.")
        new = row.asDict() | {"at": now}
        if choice == "abort":
            new["end"] = "aborted"
        elif choice != "refine":
            ahead = row.stage < len(workspace.STAGES) - 1
            new |= {"stage": row.stage + 1, "saved": now} if ahead else {"end": "completed"}
        self.store.append("workflows", [new])
        stage = workspace.STAGES[new["stage"]] if new["end"] == "open" else new["end"]
        return {"status": "checkpoint" if new["end"] == "open" else new["end"], "workflow_id": workflow_id, "stage": stage}

    # ------------------------------------------------------------ health
    def status(self) -> dict:
        nodes, sources = self.nodes().count(), self.sources().count()
        roots = evidence.roots(self.nodes()).count()
        papers = self.store.read("papers").select("paper_id").distinct().count()
        workflows = self.store.newest("workflows", "workflow_id").where("end = 'open'").count()
        state = "ok" if nodes and sources else "degraded" if nodes or sources else "not_initialized"
        return {"status": state, "nodes": nodes, "sources": sources, "merkle_roots": roots, "papers": papers, "active_paper": self.active(), "active_workflows": workflows}

    def doctor(self) -> dict:
        found = self.status()
        checks = {"corpus": found["status"] == "ok", "key": bool(self.key), "catalogue": self.catalogue is not None}
        return {"status": "ok" if all(checks.values()) else "degraded", "checks": checks}

    tantivy_search = search_documents
    tantivy_index = index_document

    def call(self, name: str, **args: object) -> dict | DataFrame:
        """A tool by name; errors are results."""
        tool = name.removeprefix("cite_")
        tool = {
            "search": "search_documents", "verify": "merkle_verify", "ingest": "index_document", "tree": "tree_load",
        }.get(tool, tool)
        try:
            if tool not in TOOL_NAMES and tool not in WRAPPERS:
                raise ToolError("UNKNOWN_TOOL", name, "See TOOL_NAMES.")
            return getattr(self, tool)(**args)
        except ToolError as e:
            return {"status": "error", "error_code": e.code, "message": e.message, "next_action": e.next_action, "error": e.message}
        except Exception as e:
            return {"status": "error", "error_code": "TOOL_FAILED", "message": str(e), "next_action": "", "error": str(e)}


#: Tools that a host calls under a prefix only; they choose another tool or other defaults.
def _lines(files: DataFrame) -> DataFrame:
    """Passages of text files (source_id, value): the lines that are not blank, as rows of the nodes log but for their time."""
    lines = files.select("source_id", F.posexplode(F.split("value", r"\r?\n")).alias("paragraph", "text")).where("trim(text) <> ''")
    return lines.select(
        F.concat(F.col("source_id"), F.lit(":p"), F.col("paragraph").cast("string")).alias("node_id"), "source_id", "text", F.sha2("text", 256).alias("sha256"),
        F.lit(None).cast("int").alias("page"), "paragraph", F.lit("/").alias("section_path"),
    )


WRAPPERS = ("render", "argument_query")

#: Names of all tools. Fixed values.
TOOL_NAMES = [
    "search_documents", "search_claims", "search_memory", "index_document", "index_claim", "delete_document",
    "ag_query_claims", "ag_query_contradictions", "merkle_compute", "merkle_verify", "csl_render",
    "bibliographic_verify", "node_lookup", "tree_load", "tree_traverse", "regex_search", "memory_save",
    "tantivy_search", "tantivy_index", "audit_save", "audit_retrieve", "memory_store_tier", "memory_retrieve_tier",
    "memory_consolidate", "crypto_sign", "crypto_verify", "crypto_audit_trail", "safeharness_check",
    "safeharness_sanitize", "status", "doctor", "paper_create", "paper_add_source", "paper_use", "paper_status",
    "paper_audit", "state_wake_up", "state_snapshot", "state_record_session", "workflow_start", "workflow_resume",
]
