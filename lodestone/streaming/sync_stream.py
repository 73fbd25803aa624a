"""Index runs on a stream of document changes: each micro-batch is merged into the store and published as a generation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import index as I

CHANGE = "seq long, op string, int_id long, content string"


def merged(store: DataFrame, changes: DataFrame) -> DataFrame:
    """(int_id, content) after changes (seq, op, int_id, content); the last change of an id holds, op delete takes it out."""
    last = changes.withColumn("n", F.row_number().over(Window.partitionBy("int_id").orderBy(F.col("seq").desc()))).filter("n = 1")
    return store.join(last.select("int_id"), "int_id", "left_anti").unionByName(last.filter("op <> 'delete'").select("int_id", "content"))


def latest(spark: SparkSession, folder: str) -> tuple[int, DataFrame | None]:
    """The published version and its documents; the pointer row is written last, so a broken run is never read."""
    try:
        pointers = _pointers(spark, folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return -1, None
    version = pointers.agg(F.max("version")).first()[0]
    return (-1, None) if version is None else (version, spark.read.parquet(f"{folder}/documents/version={version}"))


def _pointers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("version long, documents long, run string, batch long").json(f"{folder}/published")


def publish(changes: DataFrame, batch_id: int, folder: str, run: str | None = None) -> None:
    """Publish the next generation; a batch that is replayed changes nothing.

    A batch is known by its number and by the checkpoint (``run``) that counts it, so a new checkpoint over an old folder
    goes on where the folder ends. Only changed documents are tokenised; the postings of the others are carried over.
    """
    spark = changes.sparkSession
    version, store = latest(spark, folder)
    if version >= 0:
        before = _pointers(spark, folder).filter(F.col("batch") == batch_id)
        if not (before if run is None else before.filter(F.col("run") == run)).isEmpty():
            return
    if store is None:
        store = spark.createDataFrame([], "int_id long, content string")
    changes = changes.select("seq", "op", "int_id", "content")
    target = f"{folder}/documents/version={version + 1}"
    merged(store, changes).write.mode("overwrite").parquet(target)
    docs = spark.read.parquet(target)
    touched = changes.select("int_id").distinct()
    fresh = I.postings(I.tokens(docs.join(touched, "int_id", "left_semi")))
    if version >= 0:
        fresh = I.without(spark.read.parquet(f"{folder}/postings/generation={version}"), touched).unionByName(fresh)
    I.write_generation(fresh, f"{folder}/postings", version + 1, 8)
    pointer = docs.agg(F.lit(version + 1).cast("long").alias("version"), F.count("*").alias("documents"), F.lit(run or "").alias("run"), F.lit(batch_id).cast("long").alias("batch"))
    pointer.coalesce(1).write.mode("append").json(f"{folder}/published")


def _take(changes: DataFrame, batch_id: int, folder: str) -> None:
    publish(changes, batch_id, folder, changes.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))


def start(spark: SparkSession, source: str, folder: str) -> StreamingQuery:
    """Take up all change files (JSON lines) that are there, a file a batch, and stop."""
    changes = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).json(source)
    run = changes.writeStream.foreachBatch(lambda df, i: _take(df, i, folder)).option("checkpointLocation", f"{folder}/checkpoint")
    return run.trigger(availableNow=True).start()
