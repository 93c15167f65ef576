"""State of the engine as append-only Parquet logs in a shared folder.

Every change adds rows; nothing is rewritten, so a write touches one small file however large a log is, and a reader
never meets a half-written row. The present state is the newest row of each key, read back with one aggregation;
a deletion is a row of its own, applied as an anti-join. ``compact`` merges the files of a log into one generation.

Writers take turns by a lock file, which only one can create (on file systems that create files atomically, as HDFS and
local ones do). A lock older than ``LOCK_AGE`` seconds belongs to a writer that was lost, and is taken over.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from provenia.operators.logs import latest

LOCK_AGE, LOCK_WAIT = 600, 60

SCHEMAS = {
    "nodes": "node_id string, source_id string, text string, sha256 string, page int, paragraph int, section_path string, at long",
    "sources": "id string, title string, author array<struct<family:string,given:string>>, year int, container string, doi string, merkle_root string, at long",
    "deleted": "source_id string, at long",
    "memory": "entry_id string, thread_id string, turn long, query string, response string, evidence array<string>, tag string, tier string, content string, sha256 string, at long",
    "claims": "claim_id string, source_id string, claim_text string, polarity string, entities array<string>, at long",
    "audits": "audit_id string, verdict string, reasoning string, evidence_hashes array<string>, query string, at long",
    "signatures": "session_id string, message_hash string, signature string, at long",
    "calls": "session_id string, tool_name string, decision string, anomaly boolean, at long",
    "checkpoints": "checkpoint_id string, tool_name string, input_hash string, rollback_available boolean, at long",
    "agent_events": "session_id string, type string, tool_name string, at long",
    "trail": "session_id string, kind string, tool_name string, message_hash string, previous_hash string, at long",
    "papers": "paper_id string, title string, question string, at long",
    "paper_sources": "paper_id string, source_id string, role string, at long",
    "active": "state string, paper_id string, at long",
    "sessions": "session_id string, topics array<string>, source_ids array<string>, open_questions array<string>, at long",
    "workflows": "workflow_id string, topic string, evidence_count long, stage int, end string, saved long, at long",
}


class Store:
    """Logs under ``root``, read and written by Spark only; ``clock`` gives nanoseconds and never repeats."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] = time.time_ns) -> None:
        self.spark, self.root, self._clock, self._last = spark, root.rstrip("/"), clock, 0

    def now(self) -> int:
        self._last = max(self._clock(), self._last + 1)
        return self._last

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    @contextmanager
    def writing(self, log: str) -> Iterator[None]:
        """The right to write to a log; waits for other writers, at most LOCK_WAIT seconds."""
        fs, p = self._fs(f"{self.root}/{log}.lock")
        until = time.monotonic() + LOCK_WAIT
        while True:
            try:
                fs.create(p, False).close()
                break
            except Exception:
                if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > LOCK_AGE:
                    fs.delete(p, False)
                elif time.monotonic() > until:
                    raise TimeoutError(f"{log}: another writer holds {p.toString()}") from None
                else:
                    time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(p, False)

    def generation(self, log: str) -> str:
        """Folder of the newest complete generation of a log; compaction makes the next one."""
        fs, p = self._fs(f"{self.root}/{log}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [n for n in names if n.startswith("g") and (n == "g0" or fs.exists(self._fs(f"{self.root}/{log}/{n}/_SUCCESS")[1]))]
        return f"{self.root}/{log}/{max(done, key=lambda n: int(n[1:]), default='g0')}"

    def append(self, log: str, rows: DataFrame | list[dict]) -> None:
        """Rows of a log; columns that are not given are null, ``at`` is the time of the call."""
        schema = self.spark.createDataFrame([], SCHEMAS[log]).schema
        if isinstance(rows, list):
            at = self.now()
            rows = self.spark.createDataFrame([tuple(r.get(f.name, at if f.name == "at" else None) for f in schema) for r in rows], schema)
        with self.writing(log):
            rows.select(*schema.names).write.mode("append").parquet(self.generation(log))

    def read(self, log: str) -> DataFrame:
        path = self.generation(log)
        fs, p = self._fs(path)
        return self.spark.read.schema(SCHEMAS[log]).parquet(path) if fs.exists(p) else self.spark.createDataFrame([], SCHEMAS[log])

    def newest(self, log: str, key: str) -> DataFrame:
        """The newest row of each key."""
        return latest(self.read(log), key, ["at"])

    def compact(self, log: str, files: int = 1) -> None:
        """Merge the files of a log, between writes."""
        with self.writing(log):
            old = self.generation(log)
            fs, p = self._fs(old)
            if fs.exists(p):
                self.read(log).coalesce(files).write.parquet(f"{self.root}/{log}/g{int(old.rsplit('/g', 1)[1]) + 1}")
                fs.delete(p, True)


def new_id(prefix: str = "") -> str:
    return prefix + uuid.uuid4().hex[:8]
