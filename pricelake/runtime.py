"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pricelake", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the plans are written for.

    Joins of unknown size are left to the optimizer: it broadcasts by measured
    size, and skewed sort-merge joins are split at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # plans of a run have thousands of expressions; noting where each was made takes longer than making it
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Where there is neither, a session on one machine (tests) gets a temporary
    folder, which is remembered in the session; on a cluster, whose executors
    would write to their own disks, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        # set by SparkContext.setCheckpointDir
        told = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = told.get() if told.isDefined() else None
    if not folder:
        folder = spark.conf.get("pricelake.scratch.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pricelake-")
        spark.conf.set("pricelake.scratch.dir", folder)
    return folder.rstrip("/")


#: Folders of the scratch scopes that are open, the innermost last.
_open: list[list[str]] = []


def new_folder(spark: SparkSession, purpose: str) -> str:
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the folders made inside: for runs whose results are stored elsewhere."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows in a file of an intermediate table, where their number is roughly known beforehand.
FILE_ROWS = 50_000


def written(df: DataFrame, purpose: str, partition_by: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts the lineage in a way that survives lost executors, and gives later
    joins a measured size to decide on.  Where about ``rows`` rows are
    expected, there are no more files than these need and the cores can write
    twice: a few rows in a file for every shuffle partition cost more than the
    rows do (on a local file system each file's permissions are set by a
    process that the executor starts).
    """
    path = new_folder(df.sparkSession, purpose)
    if rows is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
