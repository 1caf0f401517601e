"""Changes to the record table, as functions from the old table to the new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `source` replace those of their key and add new ones; of equal keys in the source one must be chosen before."""
    return target.join(source.select(key), key, "left_anti").unionByName(source)


def patch(target: DataFrame, changes: DataFrame, now: int, text: str = "exact_text") -> DataFrame:
    """Non-null columns of `changes` (one row an id) win; a changed text marks the embedding stale and sets ts_ms."""
    fields = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__hit"))
    rows = target.join(new, "id", "left")
    stale = F.coalesce(F.col("__hit") & F.col(f"__{text}").isNotNull() & (F.col(f"__{text}") != F.col(text)), F.lit(False)) if text in fields else F.lit(False)
    rows = rows.withColumn("embedding_stale", stale)
    out = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in fields}
    if "ts_ms" not in fields:
        out["ts_ms"] = F.when(F.col("embedding_stale"), F.lit(now)).otherwise(F.col("ts_ms"))
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in target.columns], "embedding_stale")


def add_counts(target: DataFrame, deltas: DataFrame, now: int, columns: tuple[str, ...] = ("retrieval_count", "usage_count")) -> DataFrame:
    """Adds the summed deltas of each id; ids with any get last_used = now."""
    sums = deltas.groupBy("id").agg(*[F.sum(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    rows = target.join(sums, "id", "left")
    for c in columns:
        rows = rows.withColumn(c, F.col(c) + F.coalesce(f"__{c}", F.lit(0)))
    return rows.withColumn("last_used", F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("last_used"))).select(*target.columns)


def delete_ids(target: DataFrame, ids: DataFrame) -> DataFrame:
    return target.join(ids.select("id"), "id", "left_anti")


def delete_reported(target: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table without `ids`, (id, outcome) of each distinct id asked for: deleted or missing); null ids are no ids."""
    asked = ids.where("id is not null").select("id").distinct()
    there = target.select("id", F.lit(True).alias("__there")).distinct()
    report = asked.join(there, "id", "left").select("id", F.when(F.col("__there"), "deleted").otherwise("missing").alias("outcome"))
    return delete_ids(target, asked), report


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    return target.where(~F.coalesce(condition, F.lit(False)))


def soft_delete(target: DataFrame, actions: DataFrame, now: int) -> DataFrame:
    """Marks ids deprecated; time, reason and superseder are written once and then stay. `actions`: id, reason, superseding."""
    rows = target.join(actions.select("id", F.col("reason").alias("__reason"), F.col("superseding").alias("__by"), F.lit(True).alias("__hit")), "id", "left")
    first = F.coalesce(F.col("__hit"), F.lit(False)) & F.col("deprecated_at").isNull()
    return rows.select(
        *[c for c in target.columns if c not in ("deprecated", "deprecated_at", "deprecated_reason", "superseding_record_id")],
        (F.col("deprecated") | F.coalesce("__hit", F.lit(False))).alias("deprecated"),
        F.when(first, F.lit(now)).otherwise(F.col("deprecated_at")).alias("deprecated_at"),
        F.when(first, F.col("__reason")).otherwise(F.col("deprecated_reason")).alias("deprecated_reason"),
        F.when(first, F.col("__by")).otherwise(F.col("superseding_record_id")).alias("superseding_record_id"),
    )


def restore(target: DataFrame, ids: DataFrame) -> DataFrame:
    """Active again; what was written about the deprecation stays."""
    rows = target.join(ids.select("id", F.lit(True).alias("__hit")), "id", "left")
    return rows.withColumn("deprecated", F.col("deprecated") & F.col("__hit").isNull()).drop("__hit")


def promote(target: DataFrame, ids: DataFrame) -> DataFrame:
    rows = target.join(ids.select("id", F.lit(True).alias("__hit")), "id", "left")
    return rows.withColumn("scope", F.when(F.col("__hit"), "global").otherwise(F.col("scope"))).drop("__hit")


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")
