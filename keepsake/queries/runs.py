"""Runs, incremental slices, excerpts, decisions and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators import runs
from keepsake.queries.base import EV, MEM, events, mem, query
from keepsake.runtime import table

RUNS = "runs AS (SELECT event_id AS run_id, session, ts_ms, event_type = 'error' AS failed, CASE WHEN k > 5 THEN k END AS events FROM ev)"


def _runs(spark, d):
    e = events(spark, d)
    return e.select(F.col("event_id").alias("run_id"), "session", "ts_ms", (F.col("event_type") == "error").alias("failed"), F.when(F.col("k") > 5, F.col("k")).alias("events"))


@query("run_page", f"WITH {EV}, {RUNS} SELECT run_id, session, ts_ms, (SELECT count(*) FROM runs WHERE contains(lower(session), '01-1')) AS total FROM runs WHERE contains(lower(session), '01-1') ORDER BY ts_ms DESC, run_id LIMIT 20 OFFSET 10")
def run_page(spark, d):
    return runs.run_page(_runs(spark, d), "01-1", 10, 20).select("run_id", "session", "ts_ms", "total")


@query("last_good_run", f"WITH {EV}, {RUNS} SELECT session, run_id, events FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts_ms DESC, run_id) AS r FROM runs WHERE events IS NOT NULL AND NOT failed) WHERE r = 1")
def last_good_run(spark, d):
    return runs.last_good(_runs(spark, d)).select("session", "run_id", "events")


@query("incremental_slice", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), c AS (SELECT *, p > CASE WHEN conv_id % 2 = 0 THEN 4 ELSE 0 END AS is_new FROM p),
 t AS (SELECT *, coalesce(sum(CASE WHEN role = 'user' AND NOT is_new THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, bool_or(is_new) OVER (PARTITION BY conv_id) AS a FROM c)
SELECT conv_id, turn, is_new FROM t WHERE a AND (is_new OR before < 1)""")
def incremental_slice(spark, d):
    c = table(spark, d, "conversations")
    done = c.where("conv_id % 2 = 0").select("conv_id").distinct().withColumn("n", F.lit(4))
    return runs.new_events(c, done, 1).select("conv_id", "turn", "is_new")


@query("window_from_prompt", """WITH q AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'no such text' ELSE max(text) END AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id),
 f AS (SELECT c.conv_id, min(turn) AS first FROM conversations c JOIN q USING (conv_id) WHERE role = 'user' AND starts_with(text, substr(prompt, 1, 200)) GROUP BY c.conv_id)
SELECT c.conv_id, c.turn FROM conversations c JOIN q USING (conv_id) LEFT JOIN f USING (conv_id) WHERE first IS NULL OR turn >= first""")
def window_from_prompt(spark, d):
    c = table(spark, d, "conversations")
    prompts = c.where("role = 'user'").groupBy("conv_id").agg(F.max("text").alias("m")).select("conv_id", F.when(F.col("conv_id") % 3 == 0, "no such text").otherwise(F.col("m")).alias("prompt"))
    return runs.from_prompt(c, prompts).select("conv_id", "turn")


@query("excerpt_search", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), t AS (SELECT conv_id, 'r' || CAST(conv_id AS VARCHAR) AS id, substr(max(text), 1, 30) AS needle FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
 h AS (SELECT id, p.conv_id, min(p.p) AS place FROM p JOIN t USING (conv_id) WHERE contains(lower(text), lower(needle)) GROUP BY id, p.conv_id)
SELECT id, h.conv_id, substr(string_agg(text, chr(10) ORDER BY p.p), 1, 8000) AS excerpt FROM h JOIN p ON p.conv_id = h.conv_id AND abs(p.p - place) <= 3 GROUP BY id, h.conv_id""")
def excerpt_search(spark, d):
    c = table(spark, d, "conversations")
    texts = c.where("role = 'assistant'").groupBy("conv_id").agg(F.substring(F.max("text"), 1, 30).alias("needle"))
    return runs.excerpts(c, texts.withColumn("id", F.concat(F.lit("r"), F.col("conv_id").cast("string"))))


@query("extraction_coercion", f"WITH {EV} SELECT event_id AS run_id, CASE WHEN k % 2 = 0 THEN 'discovery' ELSE 'command' END AS type FROM ev WHERE k % 4 <> 3")
def extraction_coercion(spark, d):
    e, k = events(spark, d), F.col("k")
    good = F.when(k % 2 == 0, F.lit('{"type":"discovery","what":"w","where":"x","evidence":"e","confidence":"verified"}')).otherwise(
        F.lit('{"type":"command","command":"ls","exitCode":0,"outcome":"success","context":{"project":"p"}}')
    )
    bad = F.lit('{"type":"command","command":"ls","exitCode":0,"outcome":"odd","context":{"project":"p"}}')
    output = F.concat(F.lit("["), F.when(k % 4 == 3, bad).otherwise(good), F.lit(',{"type":"procedure","name":" "}]'))
    return runs.coerce(e.select(F.col("event_id").alias("run_id"), output.alias("output"))).select("run_id", "type")


@query(
    "cascade_delete",
    f"""
WITH {MEM}, {EV}, gone AS (SELECT 'm' || lpad(CAST(k * 3 AS VARCHAR), 6, '0') AS id FROM ev WHERE user_id = 7 AND event_type IN ('click', 'purchase'))
SELECT id, type FROM mem WHERE id NOT IN (SELECT id FROM gone)""",
)
def cascade_delete(spark, d):
    """Each user's clicks insert records and purchases update them; the run of user 7 goes."""
    e = events(spark, d).withColumn("id", F.concat(F.lit("m"), F.lpad((F.col("k") * 3).cast("string"), 6, "0")))
    of = lambda kind: F.collect_set(F.when(F.col("event_type") == kind, F.col("id")))
    made = e.groupBy(F.col("user_id").alias("run_id")).agg(of("click").alias("inserted"), of("purchase").alias("updated"))
    return runs.without_run(mem(spark, d), made, F.lit(7))[0].select("id", "type")


@query("promotion_decisions", f"WITH {MEM} SELECT id FROM mem WHERE CASE WHEN n % 3 = 0 THEN n % 2 = 0 ELSE usage_count >= 5 END")
def promotion_decisions(spark, d):
    m = mem(spark, d)
    choices = m.where("n % 3 = 0").select("id", F.lit(0).alias("pos"), (F.col("n") % 2 == 0).alias("promote"))
    again = choices.select("id", F.lit(1).alias("pos"), (~F.col("promote")).alias("promote"))
    return runs.decided(m.select("id", "usage_count"), choices.unionByName(again), F.col("usage_count") >= 5).select("id")


@query("fresh_hints", f"""WITH {EV}, h AS (SELECT event_id, CASE WHEN k > 30 THEN k END AS tool_id, ts_ms, event_type AS name FROM ev WHERE event_type <> 'view'), s AS (SELECT k AS tool_id, ts_ms, event_type AS name FROM ev WHERE k % 7 = 0)
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY tool_id ORDER BY ts_ms, name) AS r FROM h WHERE tool_id IS NOT NULL) WHERE r = 1 AND tool_id NOT IN (SELECT tool_id FROM s)
UNION ALL SELECT event_id FROM h WHERE tool_id IS NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.ts_ms = h.ts_ms AND s.name = h.name)""")
def fresh_hints(spark, d):
    e = events(spark, d)
    hints = e.where("event_type <> 'view'").select("event_id", F.when(F.col("k") > 30, F.col("k")).alias("tool_id"), "ts_ms", F.col("event_type").alias("name"))
    seen = e.where("k % 7 = 0").select(F.col("k").alias("tool_id"), "ts_ms", F.col("event_type").alias("name"))
    return runs.fresh_hints(hints, seen).select("event_id")


@query("timing_lines", f"WITH {EV} SELECT event_id, 'parse:' || CAST(k AS VARCHAR) || CASE WHEN k % 2 = 0 THEN ',embed:' || CAST(user_id AS VARCHAR) ELSE '' END AS line FROM ev")
def timing_lines(spark, d):
    e = events(spark, d)
    t = e.select("event_id", F.struct(F.when(F.col("k") % 2 == 0, F.col("user_id")).alias("embed"), F.col("k").alias("parse"), F.lit(None).cast("long").alias("store")).alias("t"))
    return t.select("event_id", runs.timing_line(F.col("t"), ["parse", "embed", "store"]).alias("line"))


@query("audit_actions", f"""WITH {MEM}, g AS (SELECT n // 4 AS group_no, CASE WHEN (n // 4) % 2 = 0 THEN 'duplicate' ELSE 'conflict' END AS kind, 'm' || lpad(CAST((n // 4) * 4 + 2 AS VARCHAR), 6, '0') AS keep, id, n FROM mem WHERE NOT deprecated),
 x AS (SELECT *, count(*) OVER (PARTITION BY group_no) AS c, bool_or(id = keep) OVER (PARTITION BY group_no) AS named, first_value(id) OVER (PARTITION BY group_no ORDER BY n, id) AS f FROM g),
 y AS (SELECT id, 'audit:' || kind AS reason, CASE WHEN kind = 'conflict' AND named THEN keep ELSE f END AS superseding FROM x WHERE c >= 2) SELECT * FROM y WHERE id <> superseding""")
def audit_actions(spark, d):
    m = mem(spark, d)
    no = F.floor(F.col("n") / 4)
    keep = F.concat(F.lit("m"), F.lpad((no * 4 + 2).cast("string"), 6, "0"))
    groups = m.select(no.alias("group_no"), F.when(no % 2 == 0, "duplicate").otherwise("conflict").alias("kind"), keep.alias("keep"), F.col("n").alias("pos"), "id")
    return runs.audit(groups, m.where("not deprecated"))
