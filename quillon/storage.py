"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet to the folder named in
``spark.checkpoint.dir``; every executor can read it again, so a lost executor
costs a re-read and never a recomputation of unknown depth.  Where the setting
is missing, a local session (tests) gets a folder of its own; a cluster does
not, as executors could not see it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Folders that go when the driver ends.
_LEFT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session.

    Raises ``RuntimeError`` on a cluster where ``spark.checkpoint.dir`` is unset.
    """
    found = spark.conf.get(_SETTING, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"{_SETTING} must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(_SETTING, f"file://{own}")
    return f"file://{own}"


def stash(df: DataFrame, *by: str, to: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    With ``by`` the files are split by those columns, so that a filter on them reads
    only its own; with ``to``, a frame that this function made, the rows are appended to it.
    The folder belongs to one application; its tables are removed by :func:`discard`, and
    what is left when the driver ends.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stash/{spark.sparkContext.applicationId}"
    path = to._stash_path if to is not None else f"{base}/{uuid.uuid4().hex}"
    df.write.mode("append").partitionBy(*by).parquet(path)
    if base not in _LEFT:
        _LEFT.add(base)
        folder = spark._jvm.org.apache.hadoop.fs.Path(base)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames made by :func:`stash`; others are left alone."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
