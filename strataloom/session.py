"""Session helpers: tables by name, a checkpoint folder every executor shares, and a size check for broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a temporary one is set up on a local master; a cluster must name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strataloom-"))
        have = sc._jsc.sc().getCheckpointDir()
    return have.get()


_STAGED: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: the lineage ends here and executors may be lost.

    The shuffle files of the write go with it. The table stays until ``release`` or the driver's end, since a result may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(release, spark)
    _STAGED.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables staged so far, once the results that read them are written; gives their number."""
    n = len(_STAGED)
    while _STAGED:
        _drop(spark, _STAGED.pop())
    return n


def _drop(spark: SparkSession, path: str) -> None:
    """Deletes a staged table, if the session's JVM still runs."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone
        pass


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a session; workers of a local master have it if PYTHONPATH names it."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    near = spark.sparkContext.master.startswith("local") and root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if near or getattr(spark, "_strataloom_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="strataloom-"), "strataloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    spark.sparkContext.addPyFile(archive)
    spark._strataloom_shipped = True
