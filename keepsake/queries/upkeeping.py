"""Validity of commands, JSON in free texts, patches, trims, excerpts and a gated consolidation run."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import commands
from keepsake.operators import upkeep
from keepsake.queries.base import EV, MEM, NOW, events, mem, query
from keepsake.queries.maintaining import CO, EDGES, LOOSE, _edges
from keepsake.records import parse_payload
from keepsake.runtime import table


@query(
    "json_in_text",
    f"""
WITH {EV} SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{{"k":' || k || '}}' WHEN 1 THEN '{{"s":"}}{{ \\" {{","p":{{"k":' || k || '}}}}' END AS found FROM ev""",
)
def json_in_text(spark, d):
    props, n = F.col("props"), F.col("event_id") % 4
    text = (
        F.when(n == 0, F.concat(F.lit("so } it is: "), props, F.lit(' and {"z": 1}'))).when(n == 1, F.concat(F.lit('x {"s": "}{ \\" {", "p": '), props, F.lit("} tail")))
        .when(n == 2, F.concat(F.lit('cut {"p": '), props)).otherwise(F.lit("none at all }"))
    )
    return table(spark, d, "events").select("event_id", commands.json_object(text).alias("found"))


WORD = r"'p' || regexp_extract({}, '[a-z]+')"


@query(
    "command_validity",
    f"""
WITH {MEM}, known AS (SELECT DISTINCT {WORD.format('exact_text')} AS program FROM mem WHERE n % 3 = 0),
c AS (SELECT id, n, {WORD.format('exact_text')} AS w FROM mem WHERE type = 'command'),
p AS (SELECT id, CASE (n // 5) % 6 WHEN 2 THEN './bin/' || w WHEN 3 THEN 'npx' WHEN 5 THEN NULL ELSE w END AS program FROM c),
v AS (SELECT id, program, program IS NOT NULL AND (program IN (SELECT program FROM known) OR contains(program, '/') OR program IN ('npm', 'pnpm', 'yarn', 'bun', 'npx', 'tsx', 'node', 'python', 'python3', 'uv', 'uvx')) AS valid FROM p)
SELECT id, valid, CASE WHEN NOT valid THEN 'missing-command' || coalesce(':' || program, '') END AS reason FROM v""",
)
def command_validity(spark, d):
    m = mem(spark, d)
    w = F.concat(F.lit("p"), F.regexp_extract("exact_text", "[a-z]+", 0))
    kind = F.floor(F.col("n") / 5) % 6
    line = (
        F.when(kind == 0, F.concat(F.lit("A=1 sudo -u 'a b' -E "), w, F.lit(" --x 'a;b' | grep q"))).when(kind == 1, F.concat(F.lit("env -i X='1_2' \""), w, F.lit('" && rm z')))
        .when(kind == 2, F.concat(F.lit("./bin/"), w, F.lit(" a"))).when(kind == 3, F.lit("npx tool run")).when(kind == 4, w).otherwise(F.lit("A=1 B=2 ; ls"))
    )
    known = m.where("n % 3 = 0").select(w.alias("program"))
    return upkeep.validity(m.withColumn("line", line), known, "line")


@query(
    "field_patch",
    f"""
WITH {MEM} SELECT id, CASE WHEN type = 'command' THEN 'new ' || n END AS command, CASE WHEN type = 'command' AND n % 2 = 0 THEN 7 END AS exit_code,
    CASE WHEN type = 'discovery' THEN 'w' || n ELSE project END AS what, CASE WHEN type = 'warning' AND n % 3 = 0 THEN 'critical' END AS severity,
    CASE WHEN type = 'command' THEN '/c' END AS cwd, CASE WHEN type = 'error' THEN 'f' END AS file,
    CASE type WHEN 'command' THEN CASE WHEN n % 2 = 0 THEN '' ELSE 'exitCode,' END || 'id,severity,what' WHEN 'error' THEN 'command,exitCode,id,severity,what'
        WHEN 'discovery' THEN 'command,context,exitCode,id,severity' WHEN 'procedure' THEN 'command,exitCode,id,severity,what'
        WHEN 'warning' THEN 'command,context,exitCode,id,' || CASE WHEN n % 3 = 0 THEN '' ELSE 'severity,' END || 'what' END AS refused FROM mem""",
)
def field_patch(spark, d):
    m = mem(spark, d)
    keepers = parse_payload(m.withColumn("content", F.to_json(F.struct(F.col("project").alias("what")))))
    n = F.col("n").cast("string")
    parts = {
        "command": F.concat(F.lit(" new "), n), "exitCode": F.when(F.col("n") % 2 == 0, " 7 ").otherwise("seven"), "what": F.concat(F.lit("w"), n),
        "severity": F.when(F.col("n") % 3 == 0, "critical").otherwise("grave"), "id": F.lit("no"), "name": F.lit("  "), "context": F.lit('{"cwd": "/c", "file": "f", "x": 1}'),
    }
    proposed = m.select("id", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]).alias("fields"))
    p = upkeep.patched(keepers, proposed)
    names = {"command": "command", "exitCode": "exit_code", "what": "what", "severity": "severity", "context.cwd": "cwd", "context.file": "file"}
    return p.select("id", *[F.col(f"payload.{f}").alias(a) for f, a in names.items()], F.array_join("refused", ",").alias("refused"))


@query(
    "trim_edges",
    f"""
WITH {EV}, {CO}, {EDGES},
cost AS (SELECT *, length('{{"target":' || target || ',"kind":"' || kind || '","weight":' || CAST(CAST(weight AS DOUBLE) AS VARCHAR) || ',"reinforcement":' || reinforcement || '}}') + 1 AS c FROM ed),
fixed AS (SELECT source, sum(c) AS f FROM cost WHERE kind <> 'shares_entity' GROUP BY source),
own AS (SELECT cost.*, sum(c) OVER (PARTITION BY source ORDER BY weight DESC, target ROWS UNBOUNDED PRECEDING) AS running FROM cost WHERE kind = 'shares_entity')
SELECT source, target, kind FROM ed WHERE kind <> 'shares_entity' UNION ALL
SELECT own.source, target, kind FROM own LEFT JOIN fixed USING (source) WHERE running + coalesce(f, 0) + own.source * 10 <= 2000""",
)
def trim_edges(spark, d):
    edges = _edges(spark, d)
    sizes = edges.select("source").distinct().withColumn("size", F.col("source") * 10)
    return upkeep.trimmed_edges(edges, sizes, most=2000).select("source", "target", "kind")


@query(
    "excerpt_segments",
    """
WITH e AS (SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN 'tool_call' WHEN 4 THEN 'tool_result' ELSE role END AS kind, CASE WHEN turn % 5 IN (1, 4) THEN 't' || (turn // 10) END AS tool_id,
    trim(coalesce(text, '')) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
f AS (SELECT conv_id || ':' || turn AS id, conv_id, p AS found, kind, tool_id FROM e WHERE turn % 3 = 0 OR turn % 5 = 1),
firsts AS (SELECT conv_id, kind, tool_id, min(p) AS p FROM e WHERE tool_id IS NOT NULL GROUP BY ALL),
w AS (SELECT f.id, f.conv_id, found, e.p FROM f JOIN e ON e.conv_id = f.conv_id AND abs(e.p - found) <= 3
    UNION SELECT f.id, f.conv_id, found, x.p FROM f JOIN firsts x ON x.conv_id = f.conv_id AND x.tool_id = f.tool_id
        AND x.kind = CASE f.kind WHEN 'tool_call' THEN 'tool_result' WHEN 'tool_result' THEN 'tool_call' END),
b AS (SELECT w.*, '[' || kind || ']' || CASE WHEN text = '' THEN '' ELSE chr(10) || text END AS block FROM w JOIN e USING (conv_id, p)),
k AS (SELECT *, sum(length(block) + 2) OVER (PARTITION BY id ORDER BY abs(p - found), p DESC ROWS UNBOUNDED PRECEDING) - 2 AS total FROM b),
j AS (SELECT id, conv_id, string_agg(block, chr(10) || chr(10) ORDER BY p) AS t FROM k WHERE total <= 500 OR p = found GROUP BY id, conv_id)
SELECT id, conv_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 497) || '...' ELSE t END AS excerpt FROM j""",
)
def excerpt_segments(spark, d):
    turn = F.col("turn") % 5
    e = table(spark, d, "conversations").withColumn("kind", F.when(turn == 1, "tool_call").when(turn == 4, "tool_result").otherwise(F.col("role")))
    e = e.withColumn("tool_id", F.when(turn.isin(1, 4), F.concat(F.lit("t"), F.floor(F.col("turn") / 10).cast("string"))))
    finds = e.where("turn % 3 = 0 or turn % 5 = 1").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn")
    return upkeep.segments(e, finds, most=500)


RUN = f"""
members AS (SELECT n // 4 AS cluster, id, type, sha256('id=' || id || chr(10) || 'type=' || type) AS h FROM mem),
keyed AS (SELECT cluster, sha256('1|same-type|' || string_agg(id, '|' ORDER BY id)) AS key, sha256(string_agg(id || '=' || h, '|' ORDER BY id)) AS content_hash, min(id) AS least, list(id ORDER BY id) AS ids
    FROM members GROUP BY cluster HAVING count(*) >= 2),
answered AS (SELECT *, CASE cluster % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'no_merge' WHEN 2 THEN 'merge' END AS verdict, CASE cluster % 4 WHEN 0 THEN least WHEN 2 THEN 'stranger' END AS keeper,
    cluster % 10 = 0 OR (cluster % 10 = 5 AND cluster % 20 <> 5) AS cached FROM keyed),
run AS (SELECT *, CASE WHEN cached THEN 'cached' WHEN verdict = 'no_merge' THEN 'rejected' WHEN verdict = 'merge' AND keeper <> 'stranger' THEN 'merged' ELSE 'failed' END AS outcome FROM answered)"""


def _gated(spark, d):
    """Clusters of four; every tenth has a verdict, some an old one; answers merge, reject, name a stranger or are missing."""
    m = mem(spark, d)
    rows = m.select(F.floor(F.col("n") / 4).alias("cluster"), "id", F.to_json(F.struct("type", "id")).alias("content"))
    keyed = upkeep.verdict_keys(rows, rows, "same-type").withColumn("c", F.col("cluster"))
    day = 86_400_000
    old = F.when(F.col("c") % 20 == 5, NOW - 91 * day).otherwise(NOW - 89 * day)
    verdicts = keyed.where("c % 5 = 0").select("key", "content_hash", old.alias("checked_at"), F.lit("kept apart").alias("reason"))
    kind = F.col("c") % 4
    answers = keyed.where(kind < 3).select(
        "key", F.when(kind == 1, "no_merge").otherwise("merge").alias("verdict"), F.when(kind == 0, F.col("ids")[0]).when(kind == 2, "stranger").alias("keeper"), F.lit("answered").alias("reason"),
    )
    return upkeep.gated(rows, rows, verdicts, answers, LOOSE.using(no_merge_backoff_days=90), NOW)


@query(
    "consolidation_outcomes",
    f"""
WITH {MEM}, {RUN} SELECT cluster, key, outcome, CASE WHEN outcome = 'failed' THEN CASE WHEN verdict IS NULL THEN 'no answer' ELSE 'keeper is no member' END END AS problem,
    outcome IN ('merged', 'rejected') AS checked FROM run""",
)
def consolidation_outcomes(spark, d):
    return _gated(spark, d)[0]


@query(
    "consolidation_actions",
    f"""
WITH {MEM}, {RUN}, gone AS (SELECT unnest(ids) AS id, least FROM run WHERE outcome = 'merged')
SELECT id, 'consolidation:merged-into:' || least AS reason, least AS superseding FROM gone WHERE id <> least""",
)
def consolidation_actions(spark, d):
    return _gated(spark, d)[1]


@query(
    "consolidation_verdicts",
    f"""
WITH {MEM}, {RUN} SELECT key, content_hash, {NOW - 89 * 86_400_000} AS checked_at, 'kept apart' AS reason FROM run WHERE cached UNION ALL
SELECT key, content_hash, {NOW}, 'answered' FROM run WHERE outcome = 'rejected'""",
)
def consolidation_verdicts(spark, d):
    return _gated(spark, d)[2]
