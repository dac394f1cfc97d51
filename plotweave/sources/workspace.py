"""Working tables in the folder that all executors share.

Lineage is cut by writing a table there and reading it back, so a lost executor costs the
re-read of a file and never the recomputation of a whole loop.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset, one of our own.

    A folder of our own is the driver's, so it serves a local master only: RuntimeError elsewhere.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="plotweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/plotweave/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{_session_folder(spark)}/{uuid.uuid4().hex}/{name}"


#: Where the store is a local file system: without Hadoop's native library the usual class starts a
#: ``chmod`` process for every file and folder; the raw one leaves permissions to the umask.
LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def local_options(path: str) -> dict[str, str]:
    """``LOCAL`` for a path on a local file system, nothing elsewhere."""
    return LOCAL if path.startswith(("file:", "/")) else {}


def write(df: DataFrame, path: str) -> None:
    """Write a working table."""
    df.write.options(**local_options(path)).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again, such as a loop's earlier rounds."""
    for table in tables:
        _delete(table.sparkSession, table._staged_path)


def release(spark: SparkSession) -> None:
    """Delete all working tables of this session; frames that read them can't be used after."""
    _delete(spark, _session_folder(spark))
