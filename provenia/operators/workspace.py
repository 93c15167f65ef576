"""Papers, bibliographic checks, sessions, workflows and document trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.functions.text import citation, doi_key, title_key

STAGES = ["research", "outline", "draft", "review"]


def bibliographic_status(records: DataFrame, catalogue: DataFrame) -> DataFrame:
    """records (key, doi, title, http_status) with status, method, matched_title.

    catalogue: doi, title. http_status: what the service answered; null where it did not. A DOI decides if there is one, else the title; both by normal form. Without either, the
    record is unresolvable; 404 is not_found; any other status but 200 means that the catalogue was unavailable.
    """
    one = lambda k: Window.partitionBy(k).orderBy("title", "doi")
    by_doi = catalogue.withColumn("k", doi_key(F.col("doi"))).where("k <> ''").withColumn("n", F.row_number().over(one("k"))).where("n = 1")
    by_title = catalogue.withColumn("k", title_key(F.col("title"))).where("k <> ''").withColumn("n", F.row_number().over(one("k"))).where("n = 1")
    rows = records.withColumn("dk", F.nullif(doi_key(F.coalesce("doi", F.lit(""))), F.lit("")))
    rows = rows.withColumn("tk", F.when(F.col("dk").isNull(), F.nullif(title_key(F.coalesce("title", F.lit(""))), F.lit(""))))
    rows = rows.join(by_doi.select(F.col("k").alias("dk"), F.col("title").alias("doi_title")), "dk", "left")
    rows = rows.join(by_title.select(F.col("k").alias("tk"), F.col("title").alias("same_title")), "tk", "left")
    found = F.coalesce("doi_title", "same_title")
    status = F.when(F.col("dk").isNull() & F.col("tk").isNull(), "unresolvable").when(F.col("http_status") == 404, "not_found")
    status = status.when(F.col("http_status").isNull() | (F.col("http_status") != 200), "unavailable").when(found.isNotNull(), "verified").otherwise("not_found")
    method = F.when(F.col("dk").isNotNull(), "doi").when(F.col("tk").isNotNull(), "title")
    rows = rows.withColumn("status", status).withColumn("method", method)
    return rows.withColumn("matched_title", F.when(F.col("status") == "verified", found)).drop("dk", "tk", "doi_title", "same_title")


def cited_keys(asked: DataFrame, csl: DataFrame, style: str) -> DataFrame:
    """asked (with key) with output, the citation of each key; an unknown key is said to be."""
    line = citation(style, F.col("author"), F.col("year"), F.col("title"), F.col("container"))
    known = csl.select(F.col("id").alias("key"), line.alias("output"))
    missing = F.concat(F.lit("["), F.col("key"), F.lit("] Citation key not found in corpus"))
    return asked.join(known, "key", "left").withColumn("output", F.coalesce("output", missing))


def paper_sources(made: DataFrame, added: DataFrame) -> DataFrame:
    """(paper_id, source_id, role) of every paper: the last role of each source since the paper was last made.

    made: paper_id, at; added: paper_id, source_id, role, at.
    """
    since = made.groupBy("paper_id").agg(F.max("at").alias("since"))
    own = added.join(since, "paper_id").where(F.col("at") >= F.col("since"))
    return own.groupBy("paper_id", "source_id").agg(F.max_by("role", "at").alias("role"))


def paper_audit(papers: DataFrame, corpus: DataFrame) -> DataFrame:
    """Of each paper: source_count, primary_count, missing_count and status. papers: paper_id, source_id, role."""
    rows = papers.join(corpus.select("source_id").distinct().withColumn("there", F.lit(True)), "source_id", "left")
    out = rows.groupBy("paper_id").agg(
        F.count("*").alias("source_count"), F.count_if(F.col("role") == "primary").alias("primary_count"), F.count_if(F.col("there").isNull()).alias("missing_count")
    )
    return out.withColumn("status", F.when(F.col("missing_count") > 0, "incomplete").otherwise("complete"))


def recent(rows: DataFrame, key: str, by: list[str], n: int) -> DataFrame:
    """The n newest rows, after an older row of the same key has given way to a newer one."""
    newest = rows.groupBy(key).agg(F.max(F.struct(*by)).alias("at")).select(key, "at.*")
    return newest.orderBy(*(F.desc(c) for c in by), key).limit(n)


def workflow_states(choices: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """(workflow_id, stage, done) after all choices of each workflow, in order of time.

    proceed and any unknown choice lead to the next stage and renew the time to live; refine repeats the stage; abort
    and a choice after the time to live end the workflow. stage: the last one reached, or completed, aborted, expired.
    """
    ordered = F.sort_array(F.collect_list(F.struct("ms", "event_id", "choice")))
    start = F.struct(F.lit(0).alias("stage"), F.get("e", F.lit(0))["ms"].alias("saved"), F.lit("open").alias("end"))

    def step(s: Column, e: Column) -> Column:
        late = e["ms"] - s["saved"] > ttl_ms
        going = ~e["choice"].isin("refine", "abort")
        last = s["stage"] == len(STAGES) - 1
        end = F.when(late, "expired").when(e["choice"] == "abort", "aborted").when(going & last, "completed").otherwise("open")
        ahead = going & ~late & ~last
        new = F.struct((s["stage"] + F.when(ahead, 1).otherwise(0)).alias("stage"), F.when(ahead, e["ms"]).otherwise(s["saved"]).alias("saved"), end.alias("end"))
        return F.when(s["end"] == "open", new).otherwise(s)

    s = F.aggregate("e", start, step)
    rows = choices.groupBy("workflow_id").agg(ordered.alias("e")).withColumn("s", s)
    name = F.when(F.col("s.end") == "open", F.get(F.array(*map(F.lit, STAGES)), F.col("s.stage"))).otherwise(F.col("s.end"))
    return rows.select("workflow_id", name.alias("stage"), (F.col("s.end") != "open").alias("done"))


def document_tree(nodes: DataFrame) -> DataFrame:
    """Edges of the tree section > source > passage: path, parent, label, depth."""
    section = nodes.select(F.col("section_path").alias("path"), F.lit("/").alias("parent"), F.expr("substring(section_path, 2)").alias("label"), F.lit(1).alias("depth")).distinct()
    at = F.concat_ws("/", "section_path", "source_id")
    source = nodes.select(at.alias("path"), F.col("section_path").alias("parent"), F.col("source_id").alias("label"), F.lit(2).alias("depth")).distinct()
    leaf = nodes.select(F.concat_ws("/", at, "paragraph").alias("path"), at.alias("parent"), F.col("node_id").alias("label"), F.lit(3).alias("depth"))
    return section.unionByName(source).unionByName(leaf)


def traverse(tree: DataFrame, path: str) -> DataFrame:
    """Children of a path; a leaf itself; nothing where the path leads nowhere; '' and '/' give all."""
    path = "/" + path.strip("/")
    if path == "/":
        return tree
    children = tree.where(F.col("parent") == path)
    some = F.broadcast(children.select("parent").limit(1))  # one row at most
    return children.unionByName(tree.where(F.col("path") == path).join(some.withColumnRenamed("parent", "path"), "path", "left_anti").select(*tree.columns))


def active_workflows(states: DataFrame) -> DataFrame:
    """How many workflows are open (an expired one counts until it is asked for). states: see workflow_states."""
    return states.agg(F.count_if(~F.col("done")).alias("active_workflow_count"))


def _on_path(own: DataFrame, parts: list[str]) -> DataFrame:
    """The node to which names lead, as (enter, leave, depth) in one row or none; of siblings with a name the first counts."""
    named = [(F.col("depth") == k) & ((F.col("id") == p) | (F.col("label") == p) | (F.col("heading") == p)) for k, p in enumerate(parts, 1)]
    some = reduce(lambda a, b: a | b, named)
    first = own.where(some).groupBy("source_id", "parent", "depth").agg(F.min_by(F.struct("enter", "leave"), "position").alias("x"))
    first = first.select("source_id", "depth", "x.enter", "x.leave")
    # A node has one ancestor on each level, so it is reached if as many of them are as there are levels above it.
    ends, above = first.where(F.col("depth") == len(parts)), first.where(F.col("depth") < len(parts)).select("source_id", F.col("enter").alias("a"), F.col("leave").alias("z"))
    over = ends.join(above, "source_id", "left").groupBy("enter", "leave", "depth").agg(F.count_if((F.col("a") <= F.col("enter")) & (F.col("enter") <= F.col("z"))).alias("n"))
    return over.where(F.col("n") == len(parts) - 1).drop("n")


def outline_at(outline: DataFrame, source_id: str, path: str) -> DataFrame:
    """Children of the node that a path of ids, labels or headings leads to, or that node if it has none.

    '' and '/' give all nodes; a path that leads nowhere gives nothing. outline: see tables.read_outlines. Children are
    those of the next depth whose numbers lie between the node's; one job, whatever the length of the path.
    """
    own = outline.where(F.col("source_id") == source_id)
    parts = [p for p in path.split("/") if p]
    if not parts:
        return own
    here = _on_path(own, parts).select(F.col("enter").alias("__a"), F.col("leave").alias("__z"), F.col("depth").alias("__d"))
    below = (F.col("depth") == F.col("__d") + 1) & (F.col("enter") > F.col("__a")) & (F.col("enter") <= F.col("__z"))
    alone = (F.col("enter") == F.col("__a")) & (F.col("__a") == F.col("__z"))
    return own.join(F.broadcast(here), below | alone).select(*own.columns)  # one row at most


def outline_below(outline: DataFrame, source_id: str, path: str) -> DataFrame:
    """The node that a path leads to and all below it, by one range of numbers."""
    own = outline.where(F.col("source_id") == source_id)
    parts = [p for p in path.split("/") if p]
    if not parts:
        return own
    here = _on_path(own, parts).select(F.col("enter").alias("__a"), F.col("leave").alias("__z"))
    return own.join(F.broadcast(here), F.col("enter").between(F.col("__a"), F.col("__z"))).select(*own.columns)  # one row at most
