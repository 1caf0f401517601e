"""Reports: arms against a baseline, two states of the table, two result lists, hints and suggested notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators import evaluate, hints, scans, vectors
from keepsake.queries.base import COS, MEM, mem, query
from keepsake.queries.measuring import ARMS, _arms
from keepsake.runtime import table

REPORT_ROWS = """
runs AS (
    SELECT 'base' AS arm, id AS prompt, n * 37 % 400 AS ms FROM mem WHERE n % 50 = 0
    UNION ALL SELECT 'typed', id, n * 37 % 400 + 25 FROM mem WHERE n % 50 = 0 AND n % 150 <> 0),
rows_ AS (
    SELECT arm, prompt, id, n % 3 = 0 AS keyword,
        CASE n % 4 WHEN 0 THEN 'relates_to' WHEN 1 THEN 'shares_entity' END AS via,
        CASE n % 5 WHEN 0 THEN 'relevant' WHEN 1 THEN 'partially_relevant' WHEN 2 THEN 'irrelevant' WHEN 3 THEN 'unknown' END AS verdict,
        CASE WHEN n % 12 = 0 THEN n % 24 = 0 END AS helped
    FROM arms SEMI JOIN runs USING (arm, prompt)),
flagged AS (
    SELECT r.*, verdict IN ('relevant', 'partially_relevant') AS good, r.prompt IN (SELECT prompt FROM runs WHERE arm = 'base')
        AND NOT EXISTS (SELECT 1 FROM rows_ b WHERE b.arm = 'base' AND b.prompt = r.prompt AND b.id = r.id) AS fresh
    FROM rows_ r)"""
REPORT_SUMS = """
sums AS (
    SELECT arm, count(*) AS injected, count(verdict) AS judged, count(*) FILTER (verdict = 'relevant') AS relevant,
        count(*) FILTER (good) AS good, count(*) FILTER (via = 'shares_entity') AS by_entity, count(*) FILTER (via = 'relates_to') AS related,
        count(*) FILTER (fresh AND good) AS discoveries, count(*) FILTER (fresh AND verdict = 'relevant') AS strict_found,
        count(*) FILTER (fresh AND good AND via = 'shares_entity') AS entity_found,
        count(*) FILTER (fresh AND good AND via IS NULL AND keyword) AS keyword_found,
        count(helped) AS gold_judged, count(*) FILTER (helped) AS gold_helped, count(*) FILTER (fresh AND helped) AS gold_found
    FROM flagged GROUP BY arm),
times AS (
    SELECT arm, count(*) AS prompts, list_sort(list(ms))[50 * count(*) // 100 + 1] AS p50, list_sort(list(ms))[95 * count(*) // 100 + 1] AS p95
    FROM runs GROUP BY arm),
lost AS (
    SELECT 'typed' AS arm, count(*) AS displaced FROM rows_ b
    WHERE arm = 'base' AND verdict = 'relevant' AND prompt IN (SELECT prompt FROM runs WHERE arm = 'typed')
        AND NOT EXISTS (SELECT 1 FROM rows_ t WHERE t.arm = 'typed' AND t.prompt = b.prompt AND t.id = b.id)),
sets AS (
    SELECT prompt, coalesce(list(id) FILTER (arm = 'base'), []) AS x, coalesce(list(id) FILTER (arm = 'typed'), []) AS y
    FROM runs LEFT JOIN rows_ USING (arm, prompt) GROUP BY prompt HAVING count(DISTINCT arm) = 2),
nearness AS (
    SELECT 'typed' AS arm, avg(CASE WHEN len(x) + len(y) = 0 THEN 1.0
        ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END) AS overlap FROM sets)"""


@query(
    "eval_report",
    f"""
WITH {MEM}, {ARMS}, {REPORT_ROWS}, {REPORT_SUMS}
SELECT arm, prompts, injected, judged, round(relevant / judged, 6) AS strict, round(good / judged, 6) AS lenient, by_entity, related, p50, p95,
    CASE arm WHEN 'typed' THEN discoveries END AS discoveries, CASE arm WHEN 'typed' THEN strict_found END AS strict_found,
    CASE arm WHEN 'typed' THEN entity_found END AS entity_found, CASE arm WHEN 'typed' THEN keyword_found END AS keyword_found,
    displaced, CASE arm WHEN 'typed' THEN gold_found END AS gold_found, CASE arm WHEN 'typed' THEN strict_found - displaced END AS net,
    CASE arm WHEN 'typed' THEN round(100 * discoveries / (SELECT count(DISTINCT prompt) FROM runs), 6) END AS per_100,
    round(overlap, 6) AS overlap, gold_judged, gold_helped, round(gold_helped / gold_judged, 6) AS gold_rate
FROM times LEFT JOIN sums USING (arm) LEFT JOIN lost USING (arm) LEFT JOIN nearness USING (arm)""",
)
def eval_report(spark, d):
    asked = mem(spark, d).where("n % 50 = 0").select(F.col("id").alias("prompt"), "n", (F.col("n") * 37 % 400).alias("ms"))
    base = asked.select(F.lit("base").alias("arm"), "prompt", "ms")
    runs = base.unionByName(asked.where("n % 150 <> 0").select(F.lit("typed").alias("arm"), "prompt", (F.col("ms") + 25).alias("ms")))
    n = F.col("n")
    injected = _arms(spark, d).join(runs.select("arm", "prompt"), ["arm", "prompt"], "left_semi")
    injected = injected.withColumn("via", F.when(n % 4 == 0, "relates_to").when(n % 4 == 1, "shares_entity")).withColumn("keyword", n % 3 == 0)
    keys = injected.select("prompt", "id", "n").distinct()
    verdict = F.get(F.array(*[F.lit(v) for v in ("relevant", "partially_relevant", "irrelevant", "unknown")]), (n % 5).cast("int"))
    verdicts = keys.where("n % 5 < 4").select("prompt", "id", verdict.alias("verdict"))
    gold = keys.where("n % 12 = 0").select("prompt", "id", (n % 24 == 0).alias("helped"))
    found = evaluate.eval_report(runs, injected.drop("n"), verdicts, gold, "base")
    return found.withColumns({c: F.round(c, 6) for c in ("strict", "lenient", "per_100", "overlap", "gold_rate")})


FIELDS = ["type", "scope", "project", "ts_ms", "success_count", "failure_count", "retrieval_count", "usage_count"]
STATES = """
a AS (SELECT *, true AS has_vector FROM mem),
b AS (
    SELECT * REPLACE (CASE WHEN n % 19 = 0 THEN id || 'x' ELSE id END AS id, CASE WHEN n % 10 = 0 THEN usage_count + 1 ELSE usage_count END AS usage_count,
        CASE WHEN n % 23 = 0 THEN 'global' ELSE scope END AS scope, deprecated OR n % 29 = 0 AS deprecated), n % 31 > 0 AS has_vector
    FROM mem WHERE n % 17 > 0)"""
COUNTED = """
SELECT 'total' AS "check", 'all' AS key, count(*) AS n FROM {t} UNION ALL SELECT 'type', type, count(*) FROM {t} GROUP BY type
    UNION ALL SELECT 'scope', scope, count(*) FROM {t} GROUP BY scope UNION ALL SELECT 'deprecated', 'all', count(*) FILTER (deprecated) FROM {t}"""
DIFFERS = " UNION ALL ".join(
    f"SELECT 'differs', '{c}', count(*) FILTER (a.{c} IS DISTINCT FROM b.{c}), count(*) FILTER (a.{c} IS DISTINCT FROM b.{c}) FROM a JOIN b USING (id)" for c in [*FIELDS, "has_vector"]
)


@query(
    "compare_tables",
    f"""
WITH {MEM}, {STATES}, ca AS ({COUNTED.format(t="a")}), cb AS ({COUNTED.format(t="b")}),
found AS (
    SELECT "check", key, coalesce(ca.n, 0) AS a, coalesce(cb.n, 0) AS b FROM ca FULL JOIN cb USING ("check", key)
    UNION ALL SELECT 'only here', 'all', (SELECT count(*) FROM a ANTI JOIN b USING (id)), (SELECT count(*) FROM b ANTI JOIN a USING (id))
    UNION ALL {DIFFERS})
SELECT *, CASE WHEN "check" IN ('differs', 'only here') THEN a + b = 0 ELSE a = b END AS same FROM found""",
)
def compare_tables(spark, d):
    m = mem(spark, d)
    n = F.col("n")
    other = m.where("n % 17 > 0").withColumns({
        "id": F.when(n % 19 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")), "usage_count": F.when(n % 10 == 0, F.col("usage_count") + 1).otherwise(F.col("usage_count")),
        "scope": F.when(n % 23 == 0, "global").otherwise(F.col("scope")), "deprecated": F.col("deprecated") | (n % 29 == 0), "embedding": F.when(n % 31 > 0, F.col("embedding")),
    })
    return evaluate.compare_tables(m, other, FIELDS)


@query(
    "compare_results",
    f"""
WITH {MEM}, q AS (SELECT id AS query, embedding AS v FROM mem WHERE n % 50 = 0),
sims AS (SELECT query, id, n, {COS.format(a="m.embedding", b="q.v")} AS s FROM mem m JOIN q ON m.id <> q.query WHERE NOT deprecated),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS r FROM sims) WHERE r <= 8),
b AS (SELECT * REPLACE (CASE WHEN n % 2 = 0 THEN s ELSE s / 2 END AS s)
    FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS r FROM sims WHERE n % 9 > 0) WHERE r <= 8),
p AS (
    SELECT query, count(a.r) AS n_a, count(b.r) AS n_b, count(*) FILTER (a.r IS NOT NULL AND b.r IS NOT NULL) AS shared,
        count(*) FILTER (a.r = b.r) AS in_place, count(*) FILTER (abs(a.s - b.s) > 0.05) AS drifted
    FROM q LEFT JOIN (a FULL JOIN b USING (query, id)) USING (query) GROUP BY query)
SELECT query, n_a, n_b, CASE WHEN n_a > 0 THEN CAST(floor(100 * shared / n_a + 0.5) AS INT) WHEN n_b = 0 THEN 100 ELSE 0 END AS overlap,
    in_place = n_a AND n_a = n_b AS same_order, drifted,
    CASE WHEN in_place = n_a AND n_a = n_b THEN 'same' WHEN shared = n_a AND n_a = n_b THEN 'order' WHEN overlap >= 70 THEN 'near' ELSE 'far' END AS verdict
FROM p""",
)
def compare_results(spark, d):
    m = mem(spark, d)
    live, asked = m.where("not deprecated"), m.where("n % 50 = 0")
    lists = lambda pool: vectors.neighbours(asked, pool, 8, -1.0).select(F.col("id").alias("query"), F.col("other").alias("id"), "rank", "similarity")
    odd = F.substring("id", 2, 18).cast("long") % 2 == 1
    other = lists(live.where("n % 9 > 0")).withColumn("similarity", F.when(odd, F.col("similarity") / 2).otherwise(F.col("similarity")))
    return evaluate.compare_results(asked.select(F.col("id").alias("query")), lists(live), other)


@query(
    "memory_write_hints",
    """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'none') AS source, doc_id % 4 AS c FROM documents WHERE doc_id % 8 <> 3),
x AS (
    SELECT doc_id, 's' || CAST((doc_id // 10) % 50 AS VARCHAR) AS session, CASE WHEN doc_id % 3 > 0 THEN 't' || CAST(doc_id // 2 AS VARCHAR) END AS tool_id,
        CASE c WHEN 0 THEN 'Doc ' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'd' || CAST(doc_id AS VARCHAR) WHEN 2 THEN '/x/' || source ELSE 'memory_write' END AS name,
        CASE c WHEN 0 THEN 'from ' || source END AS description, CASE c WHEN 0 THEN source WHEN 1 THEN source WHEN 2 THEN 'm' END AS kind,
        CASE c WHEN 0 THEN format(E'---\\nname: \\'Doc {}\\'\\n# a remark\\nmetadata:\\n  type: {}\\n  more: 1\\ndescription: from {}\\n---\\n', doc_id, source, source) || text
            WHEN 2 THEN '{"path":"/x/' || source || '","content":5,"metadata":{"type":"m"}}' ELSE text END AS content FROM d),
y AS (SELECT *, row_number() OVER (PARTITION BY session, tool_id ORDER BY doc_id) AS r FROM x)
SELECT doc_id, session, tool_id, name, description, kind, length(content) > 12000 AS truncated,
    sha256(CASE WHEN length(content) > 12000 THEN content[1:9981] || E'\\n...[truncated]...\\n' || right(content, 2000) ELSE content END) AS content_sha256
FROM y WHERE tool_id IS NULL OR r = 1""",
)
def memory_write_hints(spark, d):
    n, text, source = F.col("doc_id"), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("none"))
    number = n.cast("string")
    note = F.concat(F.lit("---\nname: 'Doc "), number, F.lit("'\n# a remark\nmetadata:\n  type: "), source, F.lit("\n  more: 1\ndescription: from "), source, F.lit("\n---\n"), text)
    json = lambda **fields: F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
    given = (
        F.when(n % 4 == 0, json(content=note)).when(n % 4 == 1, json(name=F.concat(F.lit("  d"), number, F.lit(" ")), content=text, type=source))
        .when(n % 4 == 2, json(path=F.concat(F.lit("/x/"), source), content=F.lit(5), metadata=F.struct(F.lit("m").alias("type")))).otherwise(json(content=text))
    )
    session = F.when(n % 8 != 3, F.concat(F.lit(" s"), (F.floor(n / 10) % 50).cast("string")))
    tool = F.when(n % 3 > 0, F.concat(F.lit("t"), F.floor(n / 2).cast("string")))
    calls = table(spark, d, "documents").select("doc_id", session.alias("session_id"), tool.alias("tool_use_id"), given.alias("tool_input"), (n * 1000).alias("ts_ms"))
    found = hints.loaded(hints.write_hints(calls))
    return found.select("doc_id", "session", "tool_id", "name", "description", "kind", "truncated", F.sha2("content", 256).alias("content_sha256"))


@query(
    "suggested_notes",
    f"""
WITH {MEM},
r AS (
    SELECT CASE WHEN n % 2 = 0 THEN project ELSE 'shared' END AS target, CASE WHEN n % 11 > 0 THEN project END AS project, id, usage_count, last_used, ts_ms,
        CASE n % 3 WHEN 0 THEN 'General' WHEN 1 THEN 'src ' || type ELSE 'docs' END AS place,
        '- ' || trim(regexp_replace(exact_text, '\\s+', ' ', 'g')) || CASE WHEN n % 4 = 1 THEN ' (Evidence: seen ' || CAST(n AS VARCHAR) || ')' ELSE '' END AS line
    FROM mem WHERE type = 'discovery' AND usage_count >= 3 AND NOT deprecated),
g AS (
    SELECT target, place, count(*) AS n, '## ' || place || chr(10) || string_agg(line, chr(10) ORDER BY usage_count DESC, last_used DESC, ts_ms DESC, id) AS body
    FROM r GROUP BY target, place),
p AS (SELECT target, count(DISTINCT project) AS many, (SELECT string_agg(DISTINCT q.project, ', ' ORDER BY q.project) FROM r q WHERE q.target = r.target) AS names FROM r GROUP BY target)
SELECT target, CAST(sum(n) AS BIGINT) AS n, CASE any_value(many) WHEN 0 THEN 'Scope: Global' WHEN 1 THEN 'Scope: Project-specific' || chr(10) || 'Project: ' || any_value(names)
    ELSE 'Scope: Multiple projects' || chr(10) || 'Projects: ' || any_value(names) END || chr(10) || chr(10)
    || string_agg(body, chr(10) || chr(10) ORDER BY place) || chr(10) AS text
FROM g JOIN p USING (target) GROUP BY target""",
)
def suggested_notes(spark, d):
    n = F.col("n")
    kept = mem(spark, d).where("type = 'discovery' and usage_count >= 3 and not deprecated").select(
        F.when(n % 2 == 0, F.col("project")).otherwise("shared").alias("target"), F.when(n % 11 > 0, F.col("project")).otherwise(" unknown ").alias("project"), "id", "usage_count", "last_used", "ts_ms",
        F.when(n % 3 == 1, F.concat(F.lit(" src \n"), "type")).when(n % 3 == 2, "docs").alias("where"), F.col("exact_text").alias("what"),
        F.when(n % 4 == 1, F.concat(F.lit("seen\t"), n.cast("string"), F.lit(" "))).alias("evidence"),
    )
    return scans.suggested_notes(kept)
