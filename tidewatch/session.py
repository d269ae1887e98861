"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import lru_cache

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session that runs in one process may go without it; elsewhere a local
    folder would scatter the files over the executors, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or _local_dir()).rstrip("/")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tidewatch-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewatch/{uuid.uuid4().hex}/{name}"


_writers: dict[str, int] = {}  # writes under way, by session
_writers_lock = threading.Lock()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions that begin in here remove their shuffle files when they end.

    Otherwise these stay until the driver happens to collect its garbage, and
    every step adds its own to those of all before.
    """
    session = spark._jsparkSession.sessionUUID()
    with _writers_lock:
        own = session in _writers or spark.conf.get(FILE_CLEANUP, "false") != "true"
        if own:
            _writers[session] = _writers.get(session, 0) + 1
            spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        with _writers_lock:
            if own:
                _writers[session] -= 1
                if not _writers[session]:
                    del _writers[session]
                    spark.conf.unset(FILE_CLEANUP)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage durably and gives the planner real size statistics,
    so that later joins broadcast the table only when it is small.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*works: Callable[[], object]) -> list:
    """Run independent Spark actions at the same time and return their results.

    One action's last tasks then overlap with the next one's first.
    """
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(works)) as pool:
        started = [pool.submit(inherit(work)) for work in works]
        return [f.result() for f in started]
