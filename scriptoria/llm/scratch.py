"""Intermediate tables in the folder that the driver and all executors share.

A table written here cuts lineage, so a lost executor costs only the tasks that
ran on it, never the chain of stages before the table.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes at most of an Arrow batch; one larger row makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="scriptoria-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Results that are planned and consumed inside leave no shuffle files; else these stay until the driver collects its garbage, and some time after."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back with its own schema; the write's shuffle files go when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptoria-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """From now on no Arrow batch of this session has over BATCH_ROWS rows or about BATCH_BYTES; smaller settings stay.

    Executor and worker each hold a batch or two for every running task. Where rows are cut changes no result. The setting outlives the
    call, since Spark reads it when a result is consumed; give the session a larger one afterwards if others need it.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        number, unit = re.match(r"(-?\d+)([kmgtp]?)", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= most:
            spark.conf.set(key, str(most))


def collected(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and broadcasts of results that nobody holds any more, which it does only when driver objects are collected; and let executors collect theirs.

    An executor's heap else stays as large as the work before has made it, full of garbage, beside the Python workers of the work to come. Each executor is
    given one task, if none is busy; one that gets none only stays as it is. In local mode the driver's collection is all.
    """
    gc.collect()
    sc = spark.sparkContext
    sc._jvm.System.gc()
    n = sc._jsc.sc().getExecutorMemoryStatus().size() - 1  # the driver is one of them
    if n > 0:
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def drop(*tables: DataFrame) -> None:
    """Delete tables of stored() that no result reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; the caller does it once results have been consumed, as results read them until then."""
    _delete(spark, f"{shared_dir(spark)}/scriptoria-{spark.sparkContext.applicationId}")
