"""Scans, filters, mutations and schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake import filters, records, schema
from keepsake.operators import activity, history, mutate
from keepsake.queries.base import EV, MEM, NOW, events, mem, query
from keepsake.runtime import table

COLS = ["id", "type", "project", "scope", "ts_ms", "retrieval_count", "usage_count", "last_used"]
C = ", ".join(COLS)


@query("scan_page", f"WITH {MEM} SELECT {C} FROM mem WHERE NOT deprecated ORDER BY ts_ms DESC, id LIMIT 25 OFFSET 20")
def scan_page(spark, d):
    return history.page(mem(spark, d).where(filters.scope_filter(active=True)).select(COLS), [F.desc("ts_ms"), "id"], 20, 25)


@query("point_lookup", f"WITH {MEM} SELECT {C} FROM mem WHERE id = 'm000042'")
def point_lookup(spark, d):
    return mem(spark, d).where(F.col("id") == "m000042").select(COLS)


IDS = ["m000007", "m000003", "m999999", "m000007", "m000100", "m000001"]


@query("ordered_multi_get", f"WITH {MEM}, w AS (SELECT * FROM (VALUES {', '.join(f'({i}, {x!r})' for i, x in enumerate(IDS))}) v(pos, id)) SELECT pos, {C} FROM w JOIN mem USING (id)")
def ordered_multi_get(spark, d):
    return history.by_ids(mem(spark, d), IDS).select("pos", *COLS)


@query("record_stats", f"WITH {MEM} SELECT id, retrieval_count, usage_count, success_count, failure_count FROM mem WHERE id IN ('m000007', 'm000003', 'm000100')")
def record_stats(spark, d):
    ids = spark.createDataFrame([(i,) for i in sorted(set(IDS))], "id string")
    return mem(spark, d).join(F.broadcast(ids), "id", "left_semi").where("id <> 'm000001'").select("id", "retrieval_count", "usage_count", "success_count", "failure_count")


@query("count_records", f"WITH {MEM} SELECT count(*) AS n FROM mem WHERE project = '/p/3' AND NOT deprecated")
def count_records(spark, d):
    return mem(spark, d).where(filters.scope_filter("/p/3", active=True)).agg(F.count("*").alias("n"))


@query("scope_filter", f"WITH {MEM} SELECT {C} FROM mem WHERE (project IN ('/p/1', '/p/2') OR scope = 'global') AND type = 'error' AND id <> 'm000001' AND NOT deprecated")
def scope_filter(spark, d):
    return mem(spark, d).where(filters.scope_filter("/p/1", ["/p/2"], True, "error", "m000001", True)).select(COLS)


@query("keyword_filter", f"WITH {MEM} SELECT id, type FROM mem WHERE lower(exact_text) LIKE '%tion%' OR lower(exact_text) LIKE '%50\\%%' ESCAPE '\\'")
def keyword_filter(spark, d):
    return mem(spark, d).where(filters.has_keyword("exact_text", ["Tion", "50%", " "])).select("id", "type")


@query("recency_gate", f"WITH {MEM}, c AS (SELECT id, CASE WHEN n % 3 = 0 THEN 0 ELSE ts_ms END AS checked FROM mem) SELECT id, checked FROM c WHERE checked = 0 OR checked < {NOW - 14 * 86400000}")
def recency_gate(spark, d):
    rows = mem(spark, d).select("id", F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("ts_ms")).alias("checked"))
    return rows.where(filters.due(F.col("checked"), NOW - 14 * 86400000))


@query("session_contains", f"WITH {EV} SELECT session, count(*) AS n FROM ev WHERE lower(session) LIKE '%7:2024-01-1%' GROUP BY session")
def session_contains(spark, d):
    return events(spark, d).where(filters.has_keyword("session", ["7:2024-01-1"])).groupBy("session").agg(F.count("*").alias("n"))


@query("event_range_scan", f"WITH {EV} SELECT event_id, k, ts_ms, session FROM ev WHERE ts_ms >= {NOW - 3 * 86400000}")
def event_range_scan(spark, d):
    return events(spark, d).where(F.col("ts_ms") >= NOW - 3 * 86400000).select("event_id", "k", "ts_ms", "session")


@query("event_days", f"WITH {EV} SELECT DISTINCT day FROM ev")
def event_days(spark, d):
    return events(spark, d).select("day").distinct()


def _payload():
    """A payload that is whole for most rows and lacks a field for others."""
    n = F.col("n")
    text = F.col("exact_text")
    ok = n % 9 != 0
    return F.struct(
        text.alias("command"), F.when(ok, F.lit("success")).otherwise("odd").alias("outcome"), text.alias("errorText"), F.lit("runtime").alias("errorType"),
        F.when(ok, F.lit("fixed it")).otherwise(" ").alias("resolution"), text.alias("what"), F.when(ok, F.lit("here")).alias("where"), F.lit("seen").alias("evidence"),
        F.lit("verified").alias("confidence"), F.lit("a procedure").alias("name"), F.when(ok, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array(F.lit(" "))).alias("steps"),
        text.alias("avoid"), F.lit("this").alias("useInstead"), F.when(ok, F.lit("it fails")).alias("reason"), F.lit("caution").alias("severity"),
        (n % 3).alias("exitCode"), F.struct(F.col("project")).alias("context"),
    )


@query("validity_filter", f"WITH {MEM} SELECT id, type, n % 9 <> 0 AS valid FROM mem")
def validity_filter(spark, d):
    rows = records.parse_payload(mem(spark, d).withColumn("content", F.to_json(_payload())))
    return rows.select("id", "type", records.is_valid(F.col("type"), F.col("payload")).alias("valid"))


_ONE = "trim(regexp_replace(exact_text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(
    "render_record",
    f"""
WITH {MEM}, lines AS (SELECT id, CASE type
    WHEN 'command' THEN 'command: ' || {_ONE} || ' | outcome: ' || CASE WHEN n % 9 <> 0 THEN 'success' ELSE 'odd' END || ' | exit: ' || CAST(n % 3 AS VARCHAR) || CASE WHEN n % 9 <> 0 THEN ' | last result: fixed it' ELSE '' END
    WHEN 'error' THEN 'error: ' || {_ONE} || CASE WHEN n % 9 <> 0 THEN ' | resolution: fixed it' ELSE '' END
    WHEN 'discovery' THEN 'discovery: ' || {_ONE} || CASE WHEN n % 9 <> 0 THEN ' | where: here' ELSE '' END || ' | confidence: verified'
    WHEN 'procedure' THEN 'procedure: a procedure | steps: ' || CASE WHEN n % 9 <> 0 THEN 'one; two' ELSE '' END
    ELSE 'warning: Don''t ' || {_ONE} || ' | use instead: this' || CASE WHEN n % 9 <> 0 THEN ' | reason: it fails' ELSE '' END END AS line FROM mem)
SELECT id, CASE WHEN length(line) <= 1500 THEN line ELSE substr(line, 1, 1497) || '...' END AS line FROM lines""",
)
def render_record(spark, d):
    rows = mem(spark, d).withColumn("payload", F.from_json(F.to_json(_payload()), schema.PAYLOAD))
    return rows.select("id", records.rendered(F.col("type"), F.col("payload")).alias("line"))


@query("relative_age", f"""WITH {MEM}, a AS (SELECT id, ts_ms, ({NOW} - ts_ms) // 60000 AS mi FROM mem)
SELECT id, CASE WHEN mi // 1440 >= 30 THEN CAST(mi // 43200 AS VARCHAR) || 'mo ago' WHEN mi // 1440 >= 7 THEN CAST(mi // 10080 AS VARCHAR) || 'w ago'
 WHEN mi // 1440 > 0 THEN CAST(mi // 1440 AS VARCHAR) || 'd ago' WHEN mi // 60 > 0 THEN CAST(mi // 60 AS VARCHAR) || 'h ago'
 WHEN mi > 5 THEN CAST(mi AS VARCHAR) || 'm ago' ELSE 'just now' END AS age FROM a""")
def relative_age(spark, d):
    return mem(spark, d).select("id", records.relative_age(F.col("ts_ms"), NOW).alias("age"))


@query("upsert", f"""WITH {MEM}, base AS (SELECT id, type, usage_count FROM mem WHERE n % 2 = 0),
 src AS (SELECT id, 'warning' AS type, usage_count + 100 AS usage_count FROM mem WHERE n % 3 = 0)
SELECT * FROM src UNION ALL SELECT * FROM base WHERE id NOT IN (SELECT id FROM src)""")
def upsert(spark, d):
    m = mem(spark, d)
    source = m.where("n % 3 = 0").select("id", F.lit("warning").alias("type"), (F.col("usage_count") + 100).alias("usage_count"))
    return mutate.upsert(m.where("n % 2 = 0").select("id", "type", "usage_count"), source)


@query("patch_by_key", f"""WITH {MEM} SELECT id, CASE WHEN n % 4 = 0 THEN 'new text' ELSE exact_text END AS exact_text,
 CASE WHEN n % 4 = 0 THEN {NOW} ELSE ts_ms END AS ts_ms, CASE WHEN n % 2 = 0 AND n % 4 <> 0 THEN 'global' ELSE scope END AS scope, n % 4 = 0 AS embedding_stale FROM mem""")
def patch_by_key(spark, d):
    m = mem(spark, d)
    changes = m.where("n % 2 = 0").select("id", F.when(F.col("n") % 4 == 0, "new text").alias("exact_text"), F.when(F.col("n") % 4 != 0, "global").alias("scope"))
    return mutate.patch(m.select("id", "exact_text", "ts_ms", "scope"), changes, NOW)


@query("counter_increment", f"""WITH {MEM}, {EV}, x AS (SELECT 'm' || lpad(CAST(k AS VARCHAR), 6, '0') AS id, count(*) AS r, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS u FROM ev GROUP BY 1)
SELECT mem.id, CAST(retrieval_count + coalesce(r, 0) AS BIGINT) AS retrieval_count, CAST(usage_count + coalesce(u, 0) AS BIGINT) AS usage_count, CASE WHEN r IS NULL THEN last_used ELSE {NOW} END AS last_used
FROM mem LEFT JOIN x USING (id)""")
def counter_increment(spark, d):
    deltas = events(spark, d).select(F.concat(F.lit("m"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("id"), F.lit(1).cast("long").alias("retrieval_count"), (F.col("event_type") == "purchase").cast("long").alias("usage_count"))
    return mutate.add_counts(mem(spark, d).select("id", "retrieval_count", "usage_count", "last_used"), deltas, NOW)


@query("delete_by_ids", f"WITH {MEM} SELECT id, type FROM mem WHERE n % 6 <> 0")
def delete_by_ids(spark, d):
    m = mem(spark, d)
    return mutate.delete_ids(m.select("id", "type"), m.where("n % 6 = 0").select("id"))


@query("purge_deprecated", f"WITH {MEM} SELECT id, type FROM mem WHERE NOT deprecated")
def purge_deprecated(spark, d):
    return mutate.delete_where(mem(spark, d), F.col("deprecated")).select("id", "type")


@query("soft_delete", f"""WITH {MEM} SELECT id, deprecated OR n % 4 = 0 AS deprecated, CASE WHEN deprecated THEN ts_ms WHEN n % 4 = 0 THEN {NOW} END AS deprecated_at,
 CASE WHEN deprecated THEN 'old' WHEN n % 4 = 0 THEN 'duplicate' END AS deprecated_reason, CASE WHEN NOT deprecated AND n % 4 = 0 THEN 'm000001' END AS superseding_record_id FROM mem""")
def soft_delete(spark, d):
    m = mem(spark, d)
    target = m.select("id", "deprecated", F.when(F.col("deprecated"), F.col("ts_ms")).alias("deprecated_at"), F.when(F.col("deprecated"), "old").alias("deprecated_reason"), F.lit(None).cast("string").alias("superseding_record_id"))
    actions = m.where("n % 4 = 0").select("id", F.lit("duplicate").alias("reason"), F.lit("m000001").alias("superseding"))
    return mutate.soft_delete(target, actions, NOW)


@query("restore", f"WITH {MEM} SELECT id, deprecated AND n % 2 <> 0 AS deprecated FROM mem")
def restore(spark, d):
    m = mem(spark, d)
    return mutate.restore(m.select("id", "deprecated"), m.where("n % 2 = 0").select("id"))


@query("promote_scope", f"WITH {MEM} SELECT id, CASE WHEN n % 10 = 1 THEN 'global' ELSE scope END AS scope FROM mem")
def promote_scope(spark, d):
    m = mem(spark, d)
    return mutate.promote(m.select("id", "scope"), m.where("n % 10 = 1").select("id"))


@query("schema_migrate", f"WITH {MEM} SELECT id, type, scope, deprecated, CAST(NULL AS BIGINT) AS deprecated_at, CAST(0 AS BIGINT) AS last_conflict_check, false AS generalized, usage_count FROM mem")
def schema_migrate(spark, d):
    old = mem(spark, d).select("id", "type", "scope", "deprecated", "usage_count", "embedding")
    return schema.migrate(old).select("id", "type", "scope", "deprecated", "deprecated_at", "last_conflict_check", "generalized", "usage_count")


@query("retention", f"WITH {EV} SELECT event_id, ts_ms FROM ev WHERE day >= DATE '2024-01-24'")
def retention(spark, d):
    return activity.retained(events(spark, d), "ts_ms", 7, NOW).select("event_id", "ts_ms")


@query("snapshot_once_a_day", f"""WITH {EV}, old AS (SELECT ts_ms, event_id AS v FROM ev WHERE event_type = 'signup' AND k < 3), new AS (SELECT ts_ms, event_id AS v FROM ev WHERE event_type = 'click' AND k < 20),
 fresh AS (SELECT *, row_number() OVER (PARTITION BY epoch_ms(ts_ms)::DATE ORDER BY ts_ms) AS r FROM new WHERE epoch_ms(ts_ms)::DATE NOT IN (SELECT epoch_ms(ts_ms)::DATE FROM old))
SELECT ts_ms, v FROM old UNION ALL SELECT ts_ms, v FROM fresh WHERE r = 1""")
def snapshot_once_a_day(spark, d):
    e = events(spark, d).select("ts_ms", F.col("event_id").alias("v"), "event_type", "k")
    return activity.snapshot_if_new_day(e.where("event_type = 'signup' and k < 3").select("ts_ms", "v"), e.where("event_type = 'click' and k < 20").select("ts_ms", "v"), "ts_ms")


@query("table_difference", f"""WITH {MEM}, a AS (SELECT type, project FROM mem WHERE n % 2 = 0), b AS (SELECT type, project FROM mem WHERE n % 3 = 0)
SELECT type, project, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT type, project, 'b' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def table_difference(spark, d):
    from keepsake.operators import evaluate

    m = mem(spark, d)
    return evaluate.table_difference(m.where("n % 2 = 0").select("type", "project"), m.where("n % 3 = 0").select("type", "project"))


@query("random_batch", f"WITH {MEM} SELECT id, type FROM mem ORDER BY sha256('5:' || id), id LIMIT 20")
def random_batch(spark, d):
    return mem(spark, d).orderBy(F.sha2(F.concat(F.lit("5:"), "id"), 256), "id").limit(20).select("id", "type")


@query("known_ancestors", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '/p' END AS root FROM customer")
def known_ancestors(spark, d):
    path = F.when(F.col("c_custkey") % 2 == 0, "/p/7/x").otherwise("/r/7/x")
    nearest = F.get(F.filter(filters.parents(path), lambda x: x.isin("/p", "/q")), F.lit(0))
    return table(spark, d, "customer").select("c_custkey", nearest.alias("root"))
