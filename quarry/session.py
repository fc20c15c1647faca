"""Session helpers: a tuned session, and staged tables that outlive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "quarry", **conf: str) -> SparkSession:
    """The active session, or a new one with the engine's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map={**_DEFAULTS, **conf}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has no such setting and runs in one process is a
    temporary folder of this machine taken.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="quarry-")
    context.setCheckpointDir(at)
    return context.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    ``rows`` is an upper bound of its rows, where one is known: small tables then
    are written in few files, by as many tasks.

    Cuts the lineage: later jobs read files, so a lost executor costs nothing but
    its running tasks, and a table that several branches read is computed once.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // 100_000))
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    spark.sparkContext.__dict__.setdefault("_quarry_staged", []).append(at)
    return out


def clear_stages(spark: SparkSession) -> int:
    """Delete what this session has staged; for the end of a job, when nothing is left to read."""
    staged = spark.sparkContext.__dict__.pop("_quarry_staged", [])
    for at in staged:
        _delete(spark, at)
    return len(staged)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, least: int = 4 << 20, most: int = 64 << 20) -> DataFrame:
    """``df`` dealt over all cores where it comes in fewer files than there are cores.

    A file may be a single row group, which one task reads whatever it costs.
    Only for tables of ``least`` bytes, and of at most ``most`` for each core:
    larger ones come in enough files, and are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = size_of(df)
    if least <= size <= most * cores and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def gather(df: DataFrame, each: int = 8 << 20) -> DataFrame:
    """``df`` read by fewer tasks where it comes in many files of far less than ``each`` bytes; nothing is shuffled.

    A task and a file for each of thousands of tiny inputs cost more than what they hold.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, size_of(df) // each)
    return df.coalesce(n) if len(df.inputFiles()) > 2 * n else df


def size_of(df: DataFrame) -> int:
    """What the planner takes ``df`` for, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def together(*jobs: Callable[[], object]) -> list:
    """The results of independent jobs, which run side by side."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        session = SparkSession.getActiveSession()
        wrap = inheritable_thread_target(session) if session is not None else lambda j: j
        return [f.result() for f in [pool.submit(wrap(j)) for j in jobs]]


def limited(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows (it is counted), else joined by a shuffle.

    Not as the planner sees fit: it takes a table for the size of its files, and a few MB of these may hold millions of rows.
    """
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def release(df: DataFrame) -> None:
    """Delete the files of a table from ``stage`` that nothing will read again."""
    at = getattr(df, "_staged_at", None)
    if at is None:
        return
    _delete(df.sparkSession, at)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    context, home = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_quarry_shipped", False) or not os.path.isdir(home):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry_package.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quarry", os.path.relpath(full, home)))
    context.addPyFile(at)
    context._quarry_shipped = True


def small_batches(spark: SparkSession, rows: int = 1000, bytes_: str = "16m") -> None:
    """Bound the Arrow batches that Python workers get, for tables with very long texts; and ship the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bytes_)
