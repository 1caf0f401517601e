"""Event logs and transcripts: the test tables written in their formats, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keepsake.queries.base import EV, events, query
from keepsake.runtime import shared_folder, table
from keepsake.sources import logs

SINCE = 1705276800000 + 3_600_000  # an hour into 2024-01-15 UTC


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _log(spark, d):
    """All events as a log of JSON lines by day; every 50th has no time and is put at the start of 2024-01-20."""
    e = events(spark, d)
    at = F.when(F.col("event_id") % 50 > 0, F.col("ts_ms"))
    log = e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), at.alias("timestamp"), F.col("session").alias("groupId"), F.array(F.col("k").cast("string")).alias("coInjectedIds"))
    path = _folder(spark, "log")
    logs.write_events(log, path, 1705708800000)
    return path


LOG = "log_ AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type, CASE WHEN event_id % 50 > 0 THEN ts_ms ELSE 1705708800000 END AS at_ms, session, k FROM ev)"


@query(
    "event_log",
    f"""
WITH {EV}, {LOG}
SELECT id, type, at_ms, session, CAST(k AS VARCHAR) AS member, strftime(epoch_ms(at_ms), '%Y-%m-%d') AS day FROM log_ WHERE at_ms >= {SINCE}""",
)
def event_log(spark, d):
    found = logs.read_events(spark, _log(spark, d), SINCE)
    return found.select("id", "type", F.col("timestamp").alias("at_ms"), F.col("groupId").alias("session"), F.col("coInjectedIds")[0].alias("member"), F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("event_log_days", f"WITH {EV}, {LOG} SELECT DISTINCT strftime(epoch_ms(at_ms), '%Y-%m-%d') AS day FROM log_")
def event_log_days(spark, d):
    return logs.days(spark, _log(spark, d)).select(F.date_format("date", "yyyy-MM-dd").alias("day"))


def _transcripts(spark, d):
    """All conversations as transcript lines: answers call a tool, the next question brings its result; some lines are broken."""
    c = table(spark, d, "conversations")
    name = lambda turn: F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn, none = F.col("turn"), F.lit(None).cast("string")
    block = lambda kind, text=none, id_=none, tool=none, arg=none, result_of=none, content=none: F.struct(
        F.lit(kind).alias("type"), text.alias("text"), id_.alias("id"), tool.alias("name"), F.when(arg.isNotNull(), F.struct(arg.alias("q"))).alias("input"),
        result_of.alias("tool_use_id"), content.alias("content"),
    )
    text = block("text", F.col("text"))
    call = block("tool_use", id_=name(turn), tool=F.lit("Read"), arg=turn.cast("string"))
    result = block("tool_result", result_of=name(turn - 1), content=F.concat(F.lit("ok "), turn.cast("string")))
    line = lambda content: F.to_json(F.struct(F.col("role").alias("type"), (F.col("role") == "system").alias("isMeta"), F.struct("role", content.alias("content")).alias("message")))
    lines = F.when(F.col("role") == "assistant", line(F.array(text, call))).when((F.col("role") == "user") & (turn >= 2), line(F.array(result, text))).otherwise(line(F.col("text")))
    lines = F.when((F.col("conv_id") + turn) % 13 == 0, F.concat(F.lit("x"), lines)).otherwise(lines)
    path = _folder(spark, "transcripts")
    c.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select(lines.alias("value")).write.text(path)
    return path


@query(
    "transcript_rows",
    """
WITH good AS (SELECT * FROM conversations WHERE role <> 'system' AND (conv_id + turn) % 13 <> 0),
calls AS (SELECT *, format('t{}-{}', conv_id, turn) AS tool_id, 'Read' AS name, format('{{"q":"{}"}}', turn) AS input FROM good WHERE role = 'assistant')
SELECT role AS kind, text, NULL AS tool_id, NULL AS name, NULL AS input FROM good
UNION ALL SELECT 'tool_call', NULL, tool_id, name, input FROM calls
UNION ALL SELECT 'tool_result', format('ok {}', u.turn), format('t{}-{}', u.conv_id, u.turn - 1), c.name, c.input
FROM good u LEFT JOIN calls c ON c.conv_id = u.conv_id AND c.turn = u.turn - 1 WHERE u.role = 'user' AND u.turn >= 2""",
)
def transcript_rows(spark, d):
    return logs.transcript(spark, _transcripts(spark, d)).select("kind", "text", "tool_id", "name", "input")


@query("transcript_errors", "SELECT CAST(count(*) FILTER ((conv_id + turn) % 13 = 0) AS BIGINT) AS errors FROM conversations")
def transcript_errors(spark, d):
    return logs.parse_errors(spark, _transcripts(spark, d)).agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
