"""Where streams keep their checkpoints, and where indexes lie."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession

_own: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset on a single machine, as in tests, a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return f"{found.rstrip('/')}/provenia"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="provenia-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below work_folder, deleted when this process ends."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # the session may be stopped by then

    def drop() -> None:
        with suppress(Exception):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    atexit.register(drop)
    return path
