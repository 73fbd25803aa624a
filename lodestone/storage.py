"""Tables written between steps, in the folder that a cluster's machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of this machine's if no other takes part, else an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not found and held.isDefined():
        return held.get()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="lodestone-")
    if not held.isDefined():
        context.setCheckpointDir(found)
    return found


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, with a scheme. What lies there goes when the driver ends."""
    top = shared_dir(spark)
    folder = f"{top if ':/' in top else 'file://' + top}/lodestone-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_removed, spark.sparkContext._jvm, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _removed(jvm: object, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # the JVM has ended before; the folder is the cluster's to clean then
        pass


#: The setting by which Spark deletes a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write a DataFrame once as Parquet in the shared folder and read it back: lineage ends there, and the shuffle files of the write go."""
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
