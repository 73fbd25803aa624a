"""The document store: crawl upserts, index runs, generations, parity, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U


def upserted(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store after a batch (seq, url, title, content), and what was done with each row (action).

    The first row of a url in the batch counts. Equal content and role: skipped. Else the row is overwritten, its version
    counted up, its status PENDING, and a tombstone lives again. New urls get the next int_ids in the order of seq.
    """
    first = batch.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("seq"))).filter("n = 1")
    fresh = first.select("seq", X.sha_id(F.col("url")).alias("id"), F.col("url").alias("url_"), F.col("title").alias("title_"), F.col("content").alias("content_"), X.sha_id(F.col("content")).alias("hash_"), U.assigned_role(F.col("url")).alias("role_"))
    both = store.join(fresh, "id", "full_outer")
    new, kept = F.col("int_id").isNull(), F.col("url_").isNull()
    same = (F.col("content_hash") == F.col("hash_")) & (F.col("allowed_roles") == F.col("role_")) & ~F.col("is_deleted")
    both = both.withColumn("action", F.when(kept, "kept").when(new, "inserted").when(same, "skipped").otherwise("updated"))
    moved = F.col("action").isin("inserted", "updated")
    top = store.agg(F.coalesce(F.max("int_id"), F.lit(-1)).alias("top"))
    ids = both.filter(F.col("action") == "inserted").select("id", "seq")
    # int_ids follow seq: ranges of seq are numbered apart, then shifted by the sizes of the ranges before
    parts = ids.withColumn("part", F.floor(F.col("seq") / 65536))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    shift = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    numbered = parts.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("seq"))).join(shift, "part").select(F.col("id").alias("nid"), (F.col("own") + F.col("before")).alias("next"))
    out = both.join(numbered, F.col("id") == F.col("nid"), "left").crossJoin(F.broadcast(top))
    pick = lambda old, fresh_: F.when(moved, F.col(fresh_)).otherwise(F.col(old))
    return out.select(
        F.coalesce("int_id", F.col("top") + F.col("next")).alias("int_id"), "id", pick("url", "url_").alias("url"), pick("title", "title_").alias("title"), pick("content", "content_").alias("content"),
        pick("content_hash", "hash_").alias("content_hash"), pick("allowed_roles", "role_").alias("allowed_roles"),
        F.when(F.col("action") == "inserted", 1).when(F.col("action") == "updated", F.col("version") + 1).otherwise(F.col("version")).cast("int").alias("version"),
        F.when(moved, False).otherwise(F.col("is_deleted")).alias("is_deleted"), F.when(moved, "PENDING").otherwise(F.col("indexing_status")).alias("indexing_status"), "action",
    )


def sync_stats(store: DataFrame, failed: Column | None = None) -> DataFrame:
    """One row of what an index run does: tombstones are deleted, pending rows of version 1 added, others updated."""
    due = store.filter(F.col("indexing_status") == "PENDING")
    bad = failed if failed is not None else F.lit(False)
    return due.agg(
        F.count_if(~F.col("is_deleted") & (F.col("version") == 1) & ~bad).alias("added"), F.count_if(~F.col("is_deleted") & (F.col("version") != 1) & ~bad).alias("updated"),
        F.count_if(F.col("is_deleted")).alias("deleted"), F.count_if(~F.col("is_deleted") & bad).alias("failed"), F.lit(0).cast("long").alias("skipped"),
    )


def synced(store: DataFrame, retry: bool = False) -> DataFrame:
    """The store after an index run: pending rows indexed, pending tombstones done; with retry failed rows too."""
    due = F.col("indexing_status").isin("PENDING", "FAILED") if retry else F.col("indexing_status") == "PENDING"
    return store.withColumn("indexing_status", F.when(due, "INDEXED").otherwise(F.col("indexing_status")))


def next_generation(versions: DataFrame, document_count: Column, checksum: Column | None = None) -> DataFrame:
    """The row of the next generation: one above the highest version, 1 without any."""
    return versions.agg(F.coalesce(F.max("version") + 1, F.lit(1)).cast("long").alias("version")).select(
        "version", document_count.alias("document_count"), (checksum if checksum is not None else F.lit(None).cast("string")).alias("checksum"), F.lit("COMPLETE").alias("status")
    )


def parity(db: DataFrame, lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """One row of the three counts of int_ids and whether they agree."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    rows = one(db, "db").crossJoin(one(lexical, "lexical")).crossJoin(one(dense, "dense"))
    return rows.withColumn("parity_ok", (F.col("db") == F.col("lexical")) & (F.col("db") == F.col("dense")))


def id_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, ids) counts of the int_ids that only one side holds."""
    both = left.select("int_id").distinct().withColumn("l", F.lit(1)).join(right.select("int_id").distinct().withColumn("r", F.lit(1)), "int_id", "full_outer")
    return both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"))


def search_events(calls: DataFrame) -> DataFrame:
    """(id, event) JSON lines of calls (id, endpoint, mode, query, total, returned, seconds)."""
    timing = F.create_map(F.lit("total"), F.round(F.col("seconds") * 1000, 2))
    event = F.struct(
        F.lit("search_request").alias("event"), F.col("endpoint"), F.col("mode"), F.length(F.coalesce("query", F.lit(""))).alias("query_length"),
        F.col("total").alias("total_results"), F.col("returned").alias("returned_results"), timing.alias("timing_ms"),
    )
    return calls.select("id", F.to_json(event).alias("event"))


def error_event(kind: str, **fields: Column) -> Column:
    """JSON of one of the other events: search_error, crawl_completed, crawl_failed, index_sync, health_check."""
    if kind not in ("search_error", "crawl_completed", "crawl_failed", "index_sync", "health_check"):
        raise ValueError(f"unknown event {kind}")
    return F.to_json(F.struct(F.lit(kind).alias("event"), *(c.alias(n) for n, c in fields.items())))


def health(db: DataFrame, lexical: DataFrame, dense: DataFrame, versions: DataFrame) -> DataFrame:
    """One row of counts, generation and the two states: the returned one needs the parts, the logged one parity too."""
    rows = parity(db, lexical, dense).crossJoin(versions.agg(F.max("version").cast("long").alias("index_generation")))
    return rows.select(
        F.lit("ok").alias("status"), F.when(F.col("parity_ok"), "healthy").otherwise("degraded").alias("logged_status"), F.col("db").alias("db_doc_count"),
        F.col("lexical").alias("lexical_doc_count"), F.col("dense").alias("dense_doc_count"), "parity_ok", "index_generation",
    )
