"""A bibliographic catalogue as a data source: records in shards by the hash of their key, each read under a time limit.

A shard answers or it does not: its status is 200, or null where its file is missing, broken or takes longer than the limit.
A key that a shard which answered does not hold is a 404. Keys are normal forms, ``doi:...`` or ``title:...``.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from provenia.functions.text import doi_key, title_key
from provenia.sources.tables import write_files

SCHEMA = "shard int, key string, http_status int, doi string, title string"
#: Seconds that a shard has to answer.
TIMEOUT = 10.0
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def shard_of(key: str, shards: int) -> int:
    return int(hashlib.sha256(key.encode()).hexdigest()[:6], 16) % shards


def shard_column(key: Column, shards: int) -> Column:
    return (F.conv(F.substring(F.sha2(key, 256), 1, 6), 16, 10).cast("int") % shards).alias("shard")


def key_of(doi: Column, title: Column) -> Column:
    """The key by which a record is looked up: its DOI if there is one, else its title; null without either."""
    d, t = F.nullif(doi_key(F.coalesce(doi, F.lit(""))), F.lit("")), F.nullif(title_key(F.coalesce(title, F.lit(""))), F.lit(""))
    return F.coalesce(F.concat(F.lit("doi:"), d), F.concat(F.lit("title:"), t))


class _Shard(InputPartition):
    """A shard, and the keys that it is asked for; None for all that it holds."""

    def __init__(self, number: int, keys: list[str] | None) -> None:
        super().__init__(number)
        self.number, self.keys = number, keys


class CatalogueReader(DataSourceReader):
    """A partition a shard; with keys, of these shards and records alone."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.shards, self.timeout = options["path"], int(options["shards"]), float(options.get("timeout", TIMEOUT))
        self.keys: list[str] | None = json.loads(options["keys"]) if options.get("keys") else None

    def _ask(self, keys: list[str]) -> None:
        self.keys = keys if self.keys is None else [k for k in self.keys if k in set(keys)]

    def partitions(self) -> list[InputPartition]:
        if self.keys is None:
            return [_Shard(k, None) for k in range(self.shards)]
        by: dict[int, list[str]] = {}
        for key in dict.fromkeys(self.keys):
            by.setdefault(shard_of(key, self.shards), []).append(key)
        return [_Shard(k, keys) for k, keys in sorted(by.items())] or [_Shard(-1, [])]

    def _records(self, number: int, out: list) -> None:
        fs, at = pafs.FileSystem.from_uri(f"{self.path}/{number}.jsonl")
        with fs.open_input_stream(at) as f:
            rows = [json.loads(line) for line in f.read().decode().splitlines() if line.strip()]
        out.append([(r["key"], r.get("doi"), r.get("title")) for r in rows])

    def read(self, partition: _Shard) -> Iterator[tuple]:
        """A row for the shard itself, with a null key, and one for each record; with keys, one for each key."""
        if partition.number < 0:
            return
        out: list[list[tuple]] = []

        def ask() -> None:
            try:
                self._records(partition.number, out)
            except (OSError, ValueError, KeyError, TypeError, AttributeError):  # missing or broken
                pass

        # A file that does not answer holds its thread, and not the task.
        thread = threading.Thread(target=ask, daemon=True)
        thread.start()
        thread.join(self.timeout)
        status = 200 if out else None
        yield partition.number, None, status, None, None
        if partition.keys is None:
            yield from ((partition.number, key, status, doi, title) for key, doi, title in (out[0] if out else []))
            return
        first: dict[str, tuple] = {}
        for key, doi, title in out[0] if out else []:
            first.setdefault(key, (doi, title))
        for key in partition.keys:
            yield partition.number, key, status if status is None or key in first else 404, *first.get(key, (None, None))


class _PushedReader(CatalogueReader):
    """The same, told by Spark's own filters which keys are wanted."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                self._ask([f.value])
            elif isinstance(f, In) and f.attribute == ("key",):
                self._ask([v for v in f.value if v is not None])
            yield f  # looked at again: a shard's own row has no key


class Catalogue(DataSource):
    """Options: path, shards, timeout (seconds), keys (a JSON list), pushdown (true: Spark's filters are read)."""

    @classmethod
    def name(cls) -> str:
        return "bibliographic_catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> CatalogueReader:
        return (_PushedReader if self.options.get("pushdown") == "true" else CatalogueReader)(dict(self.options))


def read_catalogue(spark: SparkSession, path: str, shards: int, keys: list[str] | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """(shard, key, http_status, doi, title) of a catalogue; ``keys`` are a few, known beforehand, of whose shards alone a file is opened.

    Filters on key do the same where the session lets them pass to Python (spark.sql.python.filterPushdown.enabled).
    """
    spark.dataSource.register(Catalogue)
    asked = {} if keys is None else {"keys": json.dumps(keys)}
    pushed = spark.conf.get(_PUSHDOWN, "false")
    return spark.read.format("bibliographic_catalogue").options(path=path, shards=shards, timeout=timeout, pushdown=pushed, **asked).load()


def write_catalogue(records: DataFrame, path: str, shards: int) -> int:
    """Write records (doi, title) as shards, each under its DOI and its title, by the tasks that hold them; returns how many shards."""
    keys = F.array_compact(F.array(key_of(F.col("doi"), F.lit(None)), key_of(F.lit(None), F.col("title"))))
    rows = records.select(F.explode(keys).alias("key"), "doi", "title")
    line = F.struct("key", "title", "doi", F.to_json(F.struct("key", "doi", "title")).alias("line"))
    grouped = rows.groupBy(shard_column(F.col("key"), shards)).agg(F.sort_array(F.collect_list(line)).alias("lines"))  # a shard is a file
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    empty = records.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    files = empty.join(grouped, "shard", "left").select(F.concat(F.lit(f"{path}/"), F.col("shard").cast("string"), F.lit(".jsonl")).alias("path"), F.coalesce(text, F.lit("")).alias("text"))
    return write_files(files)


def looked_up(records: DataFrame, catalogue: DataFrame, shards: int) -> DataFrame:
    """records (doi, title) with status, method, matched_title: what the catalogue says of each, by one join on the key.

    Without a DOI and a title a record is unresolvable; where its shard did not answer the catalogue was unavailable; a
    key that the shard holds is verified, and any other not_found. Of several records under a key the first title counts.
    """
    held = catalogue.where("key IS NOT NULL AND http_status = 200").groupBy("key").agg(F.min(F.struct("title", "doi")).alias("hit"))
    answered = catalogue.where("key IS NULL").select(F.col("shard").alias("__shard"), F.col("http_status").alias("answered"))
    rows = records.withColumn("__key", key_of(F.col("doi"), F.col("title")))
    rows = rows.withColumn("__of", shard_column(F.col("__key"), shards))
    rows = rows.join(answered, F.col("__of") == F.col("__shard"), "left").join(held, F.col("__key") == F.col("key"), "left")
    status = F.when(F.col("__key").isNull(), "unresolvable").when(F.col("answered").isNull(), "unavailable").when(F.col("hit").isNotNull(), "verified").otherwise("not_found")
    method = F.when(F.col("__key").isNotNull(), F.substring_index("__key", ":", 1))
    return rows.withColumns({"status": status, "method": method, "matched_title": F.col("hit.title")}).drop("__key", "__of", "__shard", "answered", "key", "hit")
