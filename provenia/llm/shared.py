"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset on a single machine, as in tests, a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="provenia-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class Workspace:
    """Numbered Parquet tables of one run of an operator, under a folder name of its own."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.n = spark, 0
        self.path = f"{shared_folder(spark)}/provenia/{name}-{uuid.uuid4().hex}"
        # Taken now: at the end of the process the session may have been stopped.
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(self.drop, "")

    def save(self, df: DataFrame, name: str, **stats: Column) -> tuple[DataFrame, dict]:
        """The table as reread from the shared folder, which cuts its lineage, and figures of what was written.

        Figures are taken from the reread table: tasks that run twice after a loss would count twice while writing.
        """
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.provenia_path = path
        return out, (out.agg(*(c.alias(k) for k, c in stats.items())).first().asDict() if stats else {})

    def drop(self, path: str | DataFrame) -> None:
        """Delete a table that nothing reads any more; '' stands for the whole folder."""
        path = self.path if path == "" else getattr(path, "provenia_path", path)
        with suppress(Exception):
            at = self._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self._conf).delete(at, True)


def hashed_rank(column: str, salt: int = 0) -> Column:
    """A fixed pseudo-random order of rows by an id."""
    return F.xxhash64(F.lit(salt), F.col(column))


def batches(it: Iterator, column: str = "text") -> Iterator[tuple]:
    """(batch, data, offsets) of non-empty Arrow batches, see spans.text_column."""
    from provenia.llm.spans import text_column

    for batch in it:
        if batch.num_rows:
            yield batch, *text_column(batch.column(column))
