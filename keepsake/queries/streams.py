"""Streams over folders of the test tables, run over all there is."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keepsake.queries.base import EV, events, mem, query, r6
from keepsake.queries.maintaining import LOOSE
from keepsake.runtime import shared_folder, table
from keepsake.streaming import ingesting, sessions


def _folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _parts(rows, part):
    return sorted(r[0] for r in rows.select(part.alias("part")).distinct().collect())  # a handful


def _in_parts(rows, part, folder):
    """Files of `rows`, one for each number of `part`, written in its order; read as a stream a file a batch."""
    for n in _parts(rows, part):
        rows.where(part == n).coalesce(1).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(stream, folder):
    """What the stream appends, as a table."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _run_parts(rows, part, folder, of):
    """What the stream `of` the files appends, when the rows of each number of `part` come in turn, each in one batch by many tasks."""
    for n in _parts(rows, part):
        rows.where(part == n).write.mode("append").parquet(f"{folder}/in")
        found = _run(of(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in")), folder)
    return found


@query(
    "session_states",
    f"""
WITH {EV}, last AS (SELECT session, k, max(event_id) AS newest FROM ev GROUP BY session, k),
placed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY newest DESC) AS r FROM last)
SELECT session, count(*) FILTER (WHERE r <= 3) AS held, string_agg('m' || k, ',' ORDER BY newest) FILTER (WHERE r <= 3) AS ids,
    (SELECT count(*) FROM ev WHERE ev.session = placed.session) AS version FROM placed GROUP BY session""",
)
def session_states(spark, d):
    """Every event injects a record into its session: the last three records, and a version that counts the events."""
    e = events(spark, d).select(
        "session", F.col("event_id").alias("seq"), F.lit("inject").alias("kind"), F.array(F.concat(F.lit("m"), F.col("k").cast("string"))).alias("ids"),
        F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("long").alias("expected"),
    )
    most = e.agg(F.max("seq")).first()[0]
    folder = _folder(spark)
    found = _run_parts(e, F.floor(F.col("seq") * 3 / (most + 1)), folder, lambda rows: sessions.session_states(rows, LOOSE.using(recently_injected_window=3)))
    last = found.groupBy("session").agg(F.max_by(F.struct("version", "ids"), "seq").alias("x"))
    return last.select("session", F.size("x.ids").cast("long").alias("held"), F.array_join("x.ids", ",").alias("ids"), "x.version")


@query(
    "growing_transcripts",
    """
WITH parts AS (SELECT conv_id, turn, role, least(2, turn // 3) AS part FROM conversations),
arrivals AS (SELECT DISTINCT conv_id, part FROM parts),
emissions AS (SELECT conv_id, part, row_number() OVER (PARTITION BY conv_id ORDER BY part) AS emission FROM arrivals),
known AS (SELECT e.conv_id, e.part, emission, p.turn, p.part < e.part AS old,
    count(*) FILTER (WHERE p.role = 'user' AND p.part < e.part) OVER (PARTITION BY e.conv_id, e.part ORDER BY p.turn DESC) AS users,
    CASE WHEN p.role = 'user' AND p.part < e.part THEN 1 ELSE 0 END AS own
    FROM emissions e JOIN parts p ON p.conv_id = e.conv_id AND p.part <= e.part)
SELECT CAST(conv_id AS VARCHAR) AS key, emission, CAST(turn AS BIGINT) AS seq, NOT old AS is_new FROM known WHERE NOT old OR users - own < 2""",
)
def growing_transcripts(spark, d):
    """Conversations that come in three files: new turns, with the two user turns before them."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("long").alias("seq"), "role", "text")
    folder = _folder(spark)
    return _run_parts(c, F.least(F.lit(2), F.floor(F.col("seq") / 3)), folder, lambda rows: sessions.growing_events(rows, 2)).select("key", "emission", "seq", "is_new")


def _ingest_rows(m):
    columns = ["id", "project", "type", "scope", "embedding", F.concat_ws(":", "usage_count", "success_count").alias("same_as"), "success_count", "failure_count", "deprecated"]
    return m.select(*columns, F.col("n").alias("seq"))


@query("ingest_stream", None)
def ingest_stream(spark, d):
    """A tenth of the records come in three batches into the table of the others."""
    m, folder = mem(spark, d), _folder(spark)
    most = m.agg(F.max("n")).first()[0]
    stream = _in_parts(_ingest_rows(m.where("n % 10 = 0")), F.floor(F.col("seq") * 3 / (most + 1)), f"{folder}/in")
    old = _ingest_rows(m.where("n % 10 <> 0")).withColumn("seq", F.lit(None).cast("long"))
    ingesting.ingest_stream(stream, old, f"{folder}/table", f"{folder}/checkpoint", LOOSE.using(dedup_threshold=0.2)).awaitTermination()
    return ingesting.actions(spark, f"{folder}/table").select("id", "action", "target", r6("similarity"), "batch")
