"""Mixing sources to target weights by Pareto order sampling.

Sources take turns in weights 1, 2, 3, ... and share the corpus by them, no source above ``most`` times its own size
(what it cannot use is shared again by weight: water filling). A document of a source whose target is f times its size
enters ``floor(f)`` times for certain; the fraction r that is left is filled by Pareto order sampling with unequal inclusion
probabilities p = r + r (1 - r) b, where b runs from -1/2 or so for the longest documents to 1/2 for the shortest and has
the mean 0 over the words of the source, so that the expected number of words is the target. Documents are ranked by
(u / (1 - u)) / (p / (1 - p)), u being a hash of the id. As targets are in words, the size of the sample is fixed in words:
the lowest ranks enter while they fit the rest of the target, then on down the ranks every one that still fits, then one
more if that comes nearer.

No source is ordered as a whole: a histogram of ranks finds the cell that the cut falls in, a second one a cell within
it, and only that cell is put in order, so a source with a third of all rows costs one pass of partial sums. Its rows are
dealt to ``SALTS`` parts wherever they meet facts of their source.

Defined cases: null texts have size 0 and empty ones too (they enter with 0 words); a null source is a source of its
own, last in order; rows with one id share their u and are told apart by size, rows of equal id and size enter together;
ties of ranks go by id and size; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import text as T
from lodestone.llm.frames import cut, map_batches

CELLS = 4096
#: Documents of a source that are tried in a round against the gap behind the cut.
BATCH = 1024
#: Steps in which the lean of a document towards being taken is counted.
LEAN = 1 << 16
#: Parts that the rows of a source are dealt to wherever they meet facts of their source.
SALTS = 64


def word_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size), the size of a text being its number of words."""

    def sizes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = np.zeros(batch.num_rows, np.int64)
        for row, end, buf, off in T.text_slices(batch.column(2)):
            n[row:end] = T.counts(T.word_spans(buf, off)[2])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], ["doc_id", "source", "size"])

    picked = docs.select(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))
    return map_batches(picked.toDF("doc_id", "source", "text"), sizes, "doc_id long, source string, size long")


def targets(sized: DataFrame, weights: int = 3, most: float = 3.0) -> DataFrame:
    """(source, source_size, target): one row a source. Only per-source sums are put in order."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_limit = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    ahead, onward = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    size = F.col("source_size").cast("double")
    level = (F.col("all") - F.coalesce(F.sum("limit").over(ahead), F.lit(0.0))) / F.sum("weight").over(onward)
    full = F.col("ratio") <= F.col("level")
    left = F.col("all") - F.coalesce(F.sum(F.when(full, F.col("limit"))).over(everything), F.lit(0.0))
    share = left / F.sum(F.when(~full, F.col("weight"))).over(everything)
    return (
        sums.withColumn("weight", (1 + place % weights).cast("double"))
        .withColumn("limit", size * most)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("all", F.sum(size).over(everything))
        .withColumn("level", level)
        .select("source", "source_size", F.when(full, F.col("limit")).otherwise(share * F.col("weight")).alias("target"))
    )


def _hashed_uniform(seed: int, *cols: str) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _cut_cells(rows: DataFrame, keys: list[str], cell: str, room: str) -> DataFrame:
    """Of each group of keys the cell of the rank histogram in which the sum of sizes reaches the room left, and the sum ahead of it."""
    order = Window.partitionBy(*keys).orderBy(cell)
    sums = rows.groupBy(*keys, cell).agg(F.sum("size").alias("held"), F.first(room).alias("room"))
    seen = sums.withColumn("upto", F.sum("held").over(order))
    return seen.filter((F.col("upto") >= F.col("room")) & (F.col("upto") - F.col("held") < F.col("room"))).select(
        *keys, F.col(cell).alias("cut"), (F.col("upto") - F.col("held")).alias("ahead")
    )


def _for_all_parts(facts: DataFrame) -> DataFrame:
    return facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: int = 3, most: float = 3.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often each document enters the mix."""
    sized = cut(word_sizes(docs, id_col, text_col, source_col), "sizes")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    salt = F.pmod(F.xxhash64("doc_id", "size", F.lit(9)), F.lit(SALTS)).cast("int")
    dealt = sized.withColumns({"k": key, "salt": salt})
    plan = targets(sized, weights, most).withColumn("k", key).join(sized.groupBy(key.alias("k")).agg(F.count("*").alias("rows")), "k")
    plan = plan.withColumn("mean", F.col("source_size") / F.col("rows")).select("k", "source_size", "target", "mean")
    plan = cut(plan, "plan")
    # in whole numbers, so that the sum does not depend on its order
    lean = F.when(F.col("mean") > 0, ((F.col("mean") - F.col("size")) / (F.col("mean") + F.col("size")) * LEAN).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = dealt.join(_for_all_parts(plan), ["k", "salt"]).withColumn("lean", lean)
    centre = rows.groupBy("k").agg(F.sum((F.col("lean") * F.col("size")).cast("decimal(38,0)")).alias("held"))
    rows = rows.join(_for_all_parts(cut(centre, "centre")), ["k", "salt"])
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    odds = lambda p: p / (1.0 - p)
    share = F.col("times") - F.col("whole")
    # from -1 (the longest) to 1 (the shortest), its mean over the words of a source being 0
    bent = F.when(F.col("source_size") > 0, (F.col("lean") - F.col("held").cast("double") / F.col("source_size")) / (2 * LEAN)).otherwise(F.lit(0.0))
    rows = (
        rows.withColumn("times", times)
        .withColumn("whole", F.floor(F.col("times") + 1e-12))
        .withColumn("room", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .withColumn("p", F.when(share > 1e-12, share + share * (1.0 - share) * bent).otherwise(F.lit(0.0)))
        .withColumn("rank", F.when(F.col("p") > 0, odds(_hashed_uniform(seed, "doc_id", "size")) / odds(F.least("p", F.lit(1 - 1e-12)))))
        .withColumn("z", F.col("rank") / (1.0 + F.col("rank")) * CELLS)
        .withColumn("cell", F.floor("z"))
        .withColumn("fine", F.floor((F.col("z") - F.col("cell")) * CELLS))
    )
    rows = cut(rows.select("k", "salt", "doc_id", "source", "size", "source_size", "target", "whole", "room", "p", "rank", "cell", "fine"), "ranks")
    some = rows.filter(F.col("p") > 0)
    this, order = F.struct("rank", "doc_id", "size"), Window.partitionBy("k").orderBy("rank", "doc_id", "size")
    first = cut(_cut_cells(some, ["k"], "cell", "room").withColumnsRenamed({"cut": "cut1", "ahead": "ahead1"}), "cells")
    within = some.join(_for_all_parts(first), ["k", "salt"]).filter(F.col("cell") == F.col("cut1")).withColumn("room1", F.col("room") - F.col("ahead1"))
    second = cut(_cut_cells(within, ["k"], "fine", "room1").withColumnsRenamed({"cut": "cut2", "ahead": "ahead2"}), "cells")
    last = within.join(_for_all_parts(second), ["k", "salt"]).filter(F.col("fine") == F.col("cut2")).withColumn("room2", F.col("room1") - F.col("ahead2"))
    upto = last.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("upto") <= F.col("room2")
    edge = upto.groupBy("k").agg(
        F.max(F.when(fits, this)).alias("edge"),
        (F.first("room2") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("gap"),
    )
    cuts = cut(first.join(second, "k").join(edge, "k"), "cuts")
    enters = (
        F.when((F.col("p") <= 0) | F.col("cut1").isNull(), False)
        .when(F.col("cell") != F.col("cut1"), F.col("cell") < F.col("cut1"))
        .when(F.col("fine") != F.col("cut2"), F.col("fine") < F.col("cut2"))
        .otherwise(F.coalesce(this <= F.col("edge"), F.lit(False)))
    )
    rows = rows.join(_for_all_parts(cuts.select("k", "cut1", "cut2", "edge")), ["k", "salt"], "left").withColumn("enters", F.coalesce(enters, F.lit(False)))
    rows = cut(rows.select("k", "salt", "doc_id", "source", "size", "source_size", "target", "whole", "p", "rank", "enters"), "marked")
    more = _filled(rows.filter(~F.col("enters") & (F.col("p") > 0)).select("k", "salt", "rank", "doc_id", "size"), cuts.select("k", "gap"))
    rows = rows.join(more.select("k", "x.doc_id", "x.size").distinct().toDF("k_", "doc_id_", "size_"), F.col("k").eqNullSafe(F.col("k_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("size") == F.col("size_")), "left")
    enters = F.col("enters") | (F.col("k_").isNotNull() & (F.col("p") > 0))
    copies = (F.col("whole") + enters.cast("long")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _filled(behind: DataFrame, gaps: DataFrame) -> DataFrame:
    """(k, x) of the documents behind the cut (k, salt, rank, doc_id, size) that fill the gaps (k, gap) left.

    On down the ranks of a source every document enters that still fits, ``BATCH`` that do a round; then one more, of all,
    whose size is nearest to what is left, if that comes nearer to the target.
    """
    this = F.struct("rank", "doc_id", "size")
    state = gaps.filter("gap > 0").select("k", "gap", F.lit(None).cast("struct<rank:double,doc_id:long,size:long>").alias("last"))
    taken, left = None, gaps
    while True:
        open_ = behind.join(_for_all_parts(state), ["k", "salt"]).filter((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & F.coalesce(this > F.col("last"), F.lit(True)))
        open_ = open_.select("k", "salt", "rank", "doc_id", "size", "gap")
        for by in (("k", "salt"), ("k",)):
            open_ = open_.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "doc_id", "size"))).filter(F.col("nth") <= BATCH).drop("nth")
        lists = open_.groupBy("k").agg(F.sort_array(F.collect_list(this)).alias("c"), F.first("gap").alias("gap"))
        none = F.slice("c", 1, 0)
        step = lambda acc, x: F.when(x["size"] <= acc["left"], F.struct((acc["left"] - x["size"]).alias("left"), F.array_append(acc["got"], x).alias("got"))).otherwise(acc)
        done = lists.select("k", F.size("c").alias("n"), F.element_at("c", -1).alias("last"), F.aggregate("c", F.struct(F.col("gap").alias("left"), none.alias("got")), step).alias("f"))
        done = cut(done.select("k", "n", "last", "f.left", "f.got"), "filled")
        got = done.select("k", F.explode("got").alias("x"))
        taken = got if taken is None else taken.unionAll(got)
        left = left.join(done.select("k", F.col("left").alias("now")), "k", "left").select("k", F.coalesce("now", "gap").alias("gap"))
        state = done.filter((F.col("n") >= BATCH) & (F.col("left") > 0)).select("k", F.col("left").alias("gap"), "last")
        if state.isEmpty():
            break
    used = taken.select(F.col("k").alias("k_"), F.col("x.doc_id").alias("d_"), F.col("x.size").alias("s_"))
    free = behind.join(used, (F.col("k") == F.col("k_")) & F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("size") == F.col("s_")), "left_anti")
    miss = F.abs(F.col("gap") - F.col("size"))
    one = free.join(_for_all_parts(left.filter("gap > 0")), ["k", "salt"]).filter(miss < F.col("gap")).groupBy("k").agg(F.min_by(this, F.struct(miss.alias("miss"), this.alias("this"))).alias("x"))
    return taken.unionAll(one)
