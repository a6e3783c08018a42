"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Removes the shuffle files of a query when it has ended; else they stay until the driver collects its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "gavilla", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned with; ``conf`` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's own setting, or a fresh one in local tests."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="gavilla-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries over frames made inside leave no shuffle files behind; ``select("*")`` makes one of an older frame."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def materialise(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    The result has no lineage to lose with an executor, and its file sizes give the optimizer real
    statistics, so later joins are broadcast only when the table is known to be small.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/gavilla/{tag}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.select("*").write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    for made in getattr(_scopes, "open", [])[-1:]:
        made.append(table)
    return table


_scopes = threading.local()


def settle(build: Callable[[], DataFrame], tag: str = "step") -> DataFrame:
    """``materialise`` of what ``build`` returns; every table that it wrote on the way is then deleted."""
    scopes = _scopes.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        made = scopes[-1]
        result = materialise(build(), tag)
        made.remove(result)
    finally:
        left = scopes.pop()
        release(*left)
    for outer in scopes[-1:]:
        outer.append(result)
    return result


def release(*tables: DataFrame) -> None:
    """Delete tables written by ``materialise`` once a later table has replaced them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
