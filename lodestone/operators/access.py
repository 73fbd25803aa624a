"""Row security by roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each role reads.
GRANTS = {
    "Admin": ("Admin", "HR", "Engineering", "Finance", "Public"),
    "HR": ("HR", "Public"),
    "Engineering": ("Engineering", "Public"),
    "Finance": ("Finance", "Public"),
    "Public": ("Public",),
}


def grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, c) for r, cs in GRANTS.items() for c in cs], "role string, can_read string")


def readable(role: str) -> Column:
    """Predicate on allowed_roles; a role that is not known reads as Public."""
    return F.col("allowed_roles").isin(*GRANTS.get(role, GRANTS["Public"]))


def visible(docs: DataFrame, role: str) -> DataFrame:
    return docs.filter(readable(role) & ~F.col("is_deleted"))


def visible_by_role(docs: DataFrame) -> DataFrame:
    """(role, int_id) for all roles at once."""
    live = docs.filter(~F.col("is_deleted")).select("int_id", "allowed_roles")
    return live.join(grants(docs.sparkSession), F.col("allowed_roles") == F.col("can_read")).select("role", "int_id", "allowed_roles")


def blocked(docs: DataFrame) -> DataFrame:
    """(role, visible, blocked) of live documents."""
    live = docs.filter(~F.col("is_deleted"))
    roles = [F.struct(F.lit(r).alias("role"), readable(r).alias("ok")) for r in GRANTS]
    rows = live.select(F.explode(F.array(*roles)).alias("x"))
    return rows.groupBy(F.col("x.role").alias("role")).agg(F.count_if("x.ok").alias("visible"), (F.count("*") - F.count_if("x.ok")).alias("blocked"))


def leakage(shown: DataFrame) -> DataFrame:
    """(role, checked, leaks) of rows (role, allowed_roles) that were shown."""
    leak = (F.col("role") != "Admin") & (F.col("allowed_roles") != F.col("role")) & (F.col("allowed_roles") != "Public")
    return shown.groupBy("role").agg(F.count("*").alias("checked"), F.count_if(leak).alias("leaks"))
