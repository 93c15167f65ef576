"""Relations of the evidence engine, from plain tables or from a folder of JSON documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "node_id string, source_id string, text string, sha256 string, page int, paragraph int, section_path string"
CSL_SCHEMA = (
    "id string, type string, title string, author array<struct<family:string,given:string>>, "
    "issued struct<`date-parts`:array<array<int>>>, URL string, `container-title` string, DOI string, "
    "merkle_root string, content_hash string, ingestion_timestamp string, source_type string"
)
MERKLE_SCHEMA = "algorithm string, leaf_count int, levels array<array<string>>, root string"


def or_default(column: str | Column, other: Column) -> Column:
    """The column, or ``other`` where it is null or empty."""
    return F.coalesce(F.nullif(F.col(column) if isinstance(column, str) else column, F.lit("")), other)


@dataclass(frozen=True)
class Corpus:
    """Passages, bibliography and Merkle trees of a corpus."""

    nodes: DataFrame
    csl: DataFrame
    merkle: DataFrame


def read_json_corpus(spark: SparkSession, root: str) -> Corpus:
    """Scan ``root/<dir>/{csl,document,merkle}.json``.

    Only folders with a csl.json count; names that begin with a dot do not. A file that does not parse loses its own
    rows and leaves those of the others: a record stays registered though its document is broken. Where several
    folders share a key, the last folder name wins in the registries, and passages accumulate. A missing root is empty.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    # One listing of the folders, which goes to the driver, for all three kinds of files.
    listed = spark.read.text(root, wholetext=True, pathGlobFilter="{csl,document,merkle}.json", recursiveFileLookup=True) if there else None

    def scan(name: str, schema: str) -> DataFrame:
        full = f"{schema}, _corrupt string"
        if not there:
            return spark.createDataFrame([], f"{full}, dir string")
        files = listed.where(F.col("_metadata.file_name") == f"{name}.json")
        parts = F.split(F.regexp_replace("_metadata.file_path", r"^[a-z]+:/+", "/"), "/")
        depth = len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/").split("/"))
        read = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        placed = files.select(F.url_decode(F.element_at(parts, -2)).alias("dir"), (F.size(parts) == depth + 2).alias("direct"), read.alias("r"))
        return placed.where(F.col("direct") & ~F.col("dir").startswith(".") & F.col("r._corrupt").isNull()).select("r.*", "dir")

    csl = scan("csl", CSL_SCHEMA).withColumn("key", or_default("id", F.col("dir")))
    last = Window.partitionBy("key").orderBy(F.desc("dir"))
    registry = csl.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "_corrupt")
    documents = scan("document", f"nodes array<struct<{NODE_SCHEMA.replace(' string', ':string').replace(' int', ':int')}>>").join(csl.select("dir"), "dir", "left_semi")
    trees = scan("merkle", MERKLE_SCHEMA).drop("_corrupt").join(csl.select("dir", "key"), "dir")
    merkle = trees.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "dir").withColumnRenamed("key", "source_id")
    return Corpus(documents.select(F.explode("nodes").alias("n")).select("n.*"), registry.drop("dir"), merkle)


class JsonCorpus:
    """A JSON corpus that is scanned once: ``load`` gives the same relations until ``reload`` reads the files again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._now = spark, root, None

    def load(self) -> Corpus:
        return self._now or self.reload()

    def reload(self) -> Corpus:
        old = self._now
        found = read_json_corpus(self.spark, self.root)
        self._now = Corpus(*(x.persist() for x in (found.nodes, found.csl, found.merkle)))
        for x in (old.nodes, old.csl, old.merkle) if old else ():
            x.unpersist()
        return self._now


OUTLINE_SCHEMA = "source_id string, path string, parent string, depth int, position int, id string, label string, heading string, summary string, page_range string, enter int, leave int"
_SAID = ("id", "label", "heading", "summary", "page_range")


def _as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def outline_rows(source_id: str, root: object) -> list[tuple]:
    """Rows of OUTLINE_SCHEMA of a tree, in order of their numbers: one walk without recursion."""
    rows: list[list] = []
    todo: list[tuple] = [(root, None, 0, 0)]
    while todo:
        node, parent, depth, position = todo.pop()
        if depth < 0:  # all below the row of this number has been seen
            rows[position][-1] = len(rows) - 1
            continue
        said = [_as_text(node.get(c)) if isinstance(node, dict) else None for c in _SAID]
        name = next((x for x in said[:3] if x is not None), str(position))
        path = "" if depth == 0 else f"{parent}/{name}"
        todo.append((None, None, -1, len(rows)))
        rows.append([source_id, path, parent, depth, position, *said, len(rows), None])
        children = node.get("children") if isinstance(node, dict) else None
        todo += [(c, path, depth + 1, k) for k, c in reversed(list(enumerate(children)))] if isinstance(children, list) else []
    return [tuple(r) for r in rows]


def read_outlines(spark: SparkSession, folder: str, suffix: str = ".json") -> DataFrame:
    """Nodes of outline trees that another tool wrote, one file ``<source_id><suffix>`` a source.

    A file holds {"root": node}, and a node any of id, label, heading, summary, page_range and children. Columns:
    source_id, path, parent, depth, position and these fields; the root's path is empty. enter numbers the nodes of a
    tree from its root down, children in order, and leave is the last number below a node, so what lies below it are the
    numbers from enter to leave. Files that do not parse have no rows. A file is parsed once, by one task.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix}")
    name = F.url_decode(F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1))
    files = files.select(F.regexp_replace(name, re.escape(suffix) + "$", "").alias("source_id"), "value")

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for source, text in zip(batch.column("source_id").to_pylist(), batch.column("value").to_pylist(), strict=True):
                try:
                    whole = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                if isinstance(whole, dict) and "root" in whole:
                    rows = outline_rows(source, whole["root"])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k in (3, 4, 10, 11) else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], names)

    names = [f.strip().split(" ")[0] for f in OUTLINE_SCHEMA.split(",")]
    return files.mapInArrow(parse, OUTLINE_SCHEMA)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one JSON object a line; lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_files(files: DataFrame) -> int:
    """Write small files (path, text), each by the task that holds its row; returns how many. Paths are URIs that all tasks reach."""

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "text").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nodes_of(documents: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Passages of documents, or of some of them by source_id: the lines that are not blank, numbered by line.

    Ids are compared as numbers before texts are cut into lines, so that they reach the scan; what is no number is no id.
    """
    if sources is not None:
        documents = documents.where(F.col("doc_id").isin([int(s) for s in sources if re.fullmatch(r"0|-?[1-9][0-9]{0,17}", s)]))
    lines = documents.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("paragraph", "text")).where("trim(text) <> ''")
    return lines.select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":p"), F.col("paragraph").cast("string")).alias("node_id"),
        F.col("doc_id").cast("string").alias("source_id"), "text", F.sha2("text", 256).alias("sha256"),
        F.lit(None).cast("int").alias("page"), "paragraph", F.concat(F.lit("/"), F.col("lang")).alias("section_path"),
    )


def node_at(documents: DataFrame, node_id: str) -> DataFrame:
    """The passage of an id, of which the document's part reaches the scan; no row for an id of another form."""
    source, _, line = node_id.rpartition(":p")
    rows = nodes_of(documents, [source])
    return rows.where(F.col("paragraph") == int(line)) if re.fullmatch(r"0|[1-9][0-9]{0,8}", line) else rows.limit(0)


def csl_of(spark: SparkSession, folder: str) -> DataFrame:
    """Bibliography records: documents with the orders of equal number as dates and customers as authors."""
    docs, orders, people = table(spark, folder, "documents").select("doc_id", "source", "lang"), table(spark, folder, "orders"), table(spark, folder, "customer")
    dated = docs.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), docs.doc_id == orders.o_orderkey, "left")
    named = dated.join(people.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    author = F.when(F.col("c_name").isNull(), F.array().cast("array<struct<family:string,given:string>>")).otherwise(F.array(F.struct(F.col("c_name").alias("family"), F.col("lang").alias("given"))))
    return named.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), author.alias("author"), F.year("o_orderdate").alias("year"), F.concat(F.lit("Journal "), F.col("lang")).alias("container"))


def events_of(events: DataFrame) -> DataFrame:
    """Agent events: one session a user; event kinds stand for the monitor's types, props for tools."""
    kinds = {"signup": "user_message", "click": "tool_call", "view": "tool_result", "purchase": "commit", "error": "error"}
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("event_type")]
    tools = F.array(*(F.lit(t) for t in ("cite_search", "index_claim", "regex_search", "unknown_tool", "node_lookup")))
    return events.select("event_id", "ts", F.col("user_id").alias("session_id"), kind.alias("type"), F.get(tools, (F.col("event_id") % 5).cast("int")).alias("tool_name"))


def memory_of(conversations: DataFrame) -> DataFrame:
    """Memory entries: one thread a conversation; system turns are long-term, others episodic."""
    said = F.coalesce("text", F.lit(""))
    return conversations.select(
        F.concat_ws(":", "conv_id", "turn").alias("entry_id"), F.col("conv_id").alias("thread_id"), "turn",
        F.when(F.col("role") == "user", said).otherwise("").alias("query"), F.when(F.col("role") == "user", "").otherwise(said).alias("response"),
        F.when(F.col("role") == "system", "long_term").otherwise("episodic").alias("tier"), said.alias("content"), F.sha2(said, 256).alias("sha256"), F.col("role").alias("tag"),
    )
