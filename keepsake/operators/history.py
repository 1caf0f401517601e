"""Ordered histories: turns, windows, as-of lookups, ordered id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ids(df: DataFrame, ids: list[str]) -> DataFrame:
    """Rows in the order of `ids`, as often as they are named; missing ones are left out. Adds `pos`."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    return df.join(F.broadcast(wanted), "id").orderBy("pos")


def page(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def turns(messages: DataFrame, conv: str = "conv_id", seq: str = "turn") -> DataFrame:
    """`turn_no` of each message: how many user messages came up to it."""
    w = Window.partitionBy(conv).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn_no", F.sum((F.col("role") == "user").cast("long")).over(w))


def last_turns(messages: DataFrame, n: int, conv: str = "conv_id", seq: str = "turn") -> DataFrame:
    """(conv, turn_no, user_text, assistant_text) of the last n turns that have an answer."""
    rows = turns(messages, conv, seq).where("turn_no > 0 and role in ('user', 'assistant')")
    whole = rows.groupBy(conv, "turn_no").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col(seq))).alias("user_text"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col(seq))).alias("assistant_text"),
        F.count_if(F.col("role") == "assistant").alias("answers"),
    ).where("answers > 0")
    w = Window.partitionBy(conv).orderBy(F.desc("turn_no"))
    return whole.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r", "answers")


def latest_before(results: DataFrame, calls: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each result with the latest call of its key at or before it: one pass over both, without a range join.

    Results without an earlier call get null. Of equal times the greatest value counts.
    """
    nothing = F.lit(None)
    a = calls.select(by, at, F.lit(0).alias("__side"), F.col(value).alias("__value"), *[nothing.cast(t).alias(c) for c, t in results.dtypes if c not in (by, at)])
    b = results.select(by, at, F.lit(1).alias("__side"), nothing.cast(dict(calls.dtypes)[value]).alias("__value"), *[c for c in results.columns if c not in (by, at)])
    w = Window.partitionBy(by).orderBy(at, "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("latest", F.last("__value", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*results.columns, "latest")


def around(df: DataFrame, hit: Column, n: int, by: str, seq: str) -> DataFrame:
    """Rows at most n places from a hit of their group."""
    w = Window.partitionBy(by).orderBy(seq).rowsBetween(-n, n)
    return df.withColumn("__hit", F.max(hit.cast("int")).over(w)).where("__hit = 1").drop("__hit")


def nth_last(df: DataFrame, where: Column, n: int, by: str, seq: str) -> DataFrame:
    """The n-th last row that passes `where`, of each group that has so many."""
    w = Window.partitionBy(by).orderBy(F.desc(seq))
    return df.where(where).withColumn("__r", F.row_number().over(w)).where(F.col("__r") == n).drop("__r")


def recent_ids(uses: DataFrame, n: int, by: str, member: str, seq: str) -> DataFrame:
    """The n members of each group that were used last; `place` 1 is the latest."""
    last = uses.groupBy(by, member).agg(F.max(seq).alias("last"))
    w = Window.partitionBy(by).orderBy(F.desc("last"), member)
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def distinct_ignoring_case(df: DataFrame, value: str, order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(F.lower(F.col(value))).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def latest_injections(entries: DataFrame) -> DataFrame:
    """(session, ts_ms, prompt, id): of each session the ids given at its latest time that has a prompt, once each.

    `entries`: session, ts_ms, prompt, id. A blank prompt is none; of several at that time the least counts. Entries of
    that time belong to it whether they carry the prompt or not, but for those without an id; sessions without any prompt give no rows.
    """
    text = F.regexp_replace("prompt", r"^\s+|\s+\z", "")
    latest = entries.where(text != "").groupBy("session", "ts_ms").agg(F.min(text).alias("prompt"))
    latest = latest.groupBy("session").agg(F.max(F.struct("ts_ms", "prompt")).alias("x")).select("session", "x.ts_ms", "x.prompt")
    return entries.where("id <> ''").select("session", "ts_ms", "id").distinct().join(latest, ["session", "ts_ms"]).select("session", "ts_ms", "prompt", "id")
