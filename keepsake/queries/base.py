"""The register of queries, and the record view over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = 1706659200000  # 2024-01-31 UTC


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def mem(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Records made of `embeddings` and the texts of `documents`, or of those of them that are given."""
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    v = table(spark, sf_dir, "embeddings").join(documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    n = F.col("vec_id")
    kind = F.when(n % 5 == 0, "command").when(n % 5 == 1, "error").when(n % 5 == 2, "discovery").when(n % 5 == 3, "procedure").otherwise("warning")
    return v.select(
        n.alias("n"), F.concat(F.lit("m"), F.lpad(n.cast("string"), 6, "0")).alias("id"), kind.alias("type"),
        F.concat(F.lit("/p/"), F.col("label").cast("string")).alias("project"), F.when(n % 7 == 0, "global").otherwise("project").alias("scope"),
        (F.lit(1704067200000) + (n * 7919) % 2592000 * 1000).alias("ts_ms"), (n % 11).alias("retrieval_count"), (n * 3 % 7).alias("usage_count"),
        (n % 4).alias("success_count"), (n * 5 % 4).alias("failure_count"), (n % 13 == 0).alias("deprecated"), F.col("text").alias("exact_text"), "embedding",
    ).withColumn("last_used", F.col("ts_ms") + F.col("retrieval_count") * 86400000)


MEM = """mem AS (SELECT m0.*, ts_ms + retrieval_count * 86400000 AS last_used FROM (SELECT vec_id AS n, 'm' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS id,
 CASE vec_id % 5 WHEN 0 THEN 'command' WHEN 1 THEN 'error' WHEN 2 THEN 'discovery' WHEN 3 THEN 'procedure' ELSE 'warning' END AS type,
 '/p/' || CAST(label AS VARCHAR) AS project, CASE WHEN vec_id % 7 = 0 THEN 'global' ELSE 'project' END AS scope,
 1704067200000 + ((vec_id * 7919) % 2592000) * 1000 AS ts_ms, vec_id % 11 AS retrieval_count, (vec_id * 3) % 7 AS usage_count, vec_id % 4 AS success_count,
 (vec_id * 5) % 4 AS failure_count, vec_id % 13 = 0 AS deprecated, text AS exact_text, CAST(embedding AS DOUBLE[]) AS embedding
 FROM embeddings JOIN documents ON vec_id = doc_id) m0)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number in props as `k`, milliseconds, the UTC day and a session of user and day."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.to_date("ts")
    return e.select(
        "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.unix_millis("ts").alias("ts_ms"),
        day.alias("day"), F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session"),
    )


EV = """ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ts_ms, CAST(ts AS DATE) AS day,
 CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS session FROM events)"""


def vector_of(df: DataFrame, id_: str) -> list[float]:
    """One stored vector, the query of a search."""
    row = df.where(F.col("id") == id_).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


COS = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)
