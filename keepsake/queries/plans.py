"""Whole plans: retrieval and maintenance runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.plans import maintenance, retrieval
from keepsake.queries.base import MEM, NOW, mem, query, vector_of
from keepsake.queries.maintaining import LOOSE, _edges
from keepsake.queries.searching import LOOSE as SEARCH
from keepsake.queries.searching import NEEDLES
from keepsake.runtime import written

NAMES = ["stale", "low-usage", "zero-usage", "stale-unused", "promotion"]


@query("maintenance_run", f"""WITH {MEM} SELECT 'stale' AS operation, id, 'deprecate' AS action, 'stale' AS reason FROM mem WHERE NOT deprecated AND last_used < {NOW - 14 * 86400000}
UNION ALL SELECT 'low-usage', id, 'deprecate', 'low-usage' FROM mem WHERE NOT deprecated AND retrieval_count >= 5 AND usage_count / retrieval_count < 0.3
UNION ALL SELECT 'zero-usage', id, 'deprecate', 'zero-usage' FROM mem WHERE NOT deprecated AND retrieval_count >= 5 AND usage_count = 0
UNION ALL SELECT 'stale-unused', id, 'deprecate', 'stale-unused' FROM mem WHERE NOT deprecated AND ts_ms < {NOW - 10 * 86400000} AND usage_count = 0 AND retrieval_count = 0
UNION ALL SELECT 'promotion', id, 'promote', 'useful in its project' FROM mem WHERE NOT deprecated AND scope = 'project' AND type IN ('command', 'error', 'discovery') AND CASE WHEN type = 'command' THEN success_count >= 2 ELSE usage_count >= 2 END AND (retrieval_count < 3 OR usage_count / retrieval_count >= 0.3)""")
def maintenance_run(spark, d):
    return maintenance.actions(mem(spark, d), NAMES, LOOSE, NOW)


@query("maintenance_summary", f"""WITH {MEM}, s AS (SELECT CAST(count(*) FILTER (WHERE last_used < {NOW - 14 * 86400000}) AS BIGINT) AS a, count(*) FILTER (WHERE retrieval_count >= 5 AND usage_count = 0) AS b FROM mem WHERE NOT deprecated)
SELECT 'stale' AS operation, 'deprecate' AS action, a AS n FROM s UNION ALL SELECT 'zero-usage', 'deprecate', b FROM s""")
def maintenance_summary(spark, d):
    return maintenance.summary(maintenance.actions(mem(spark, d), ["stale", "zero-usage"], LOOSE, NOW))


@query("maintenance_apply", f"""WITH {MEM}, x AS (SELECT *, retrieval_count >= 5 AND usage_count / retrieval_count < 0.3 AND NOT deprecated AS low, last_used < {NOW - 14 * 86400000} AND NOT deprecated AS old FROM mem)
SELECT id, deprecated OR low OR old AS deprecated, CASE WHEN low OR old THEN {NOW} END AS deprecated_at, CASE WHEN low THEN 'low-usage' WHEN old THEN 'stale' END AS deprecated_reason FROM x""")
def maintenance_apply(spark, d):
    m = mem(spark, d)
    target = m.select("*", F.lit(None).cast("long").alias("deprecated_at"), F.lit(None).cast("string").alias("deprecated_reason"), F.lit(None).cast("string").alias("superseding_record_id"))
    return maintenance.apply(target, maintenance.actions(m, ["stale", "low-usage"], LOOSE, NOW), NOW).select("id", "deprecated", "deprecated_at", "deprecated_reason")


@query(
    "maintenance_report",
    f"""
WITH {MEM}, live AS (SELECT * FROM mem WHERE NOT deprecated)
SELECT 'stale' AS operation, count(*) AS actions, false AS failed FROM live WHERE last_used < {NOW - 14 * 86400000}
UNION ALL SELECT 'quality', 0, true UNION ALL SELECT 'zero-usage', count(*), false FROM live WHERE retrieval_count >= 5 AND usage_count = 0
UNION ALL SELECT 'validity', count(*), false FROM live WHERE type = 'command' AND n % 3 = 0""",
)
def maintenance_report(spark, d):
    """Four operations, one of which has not got what it needs."""
    m = mem(spark, d)
    checked = m.where("type = 'command'").select("id", (F.col("n") % 3 != 0).alias("valid"), F.lit("missing-command").alias("reason"))
    report = maintenance.run_all(m, LOOSE, NOW, ["stale", "quality", "zero-usage", "validity"], maintenance.Inputs(validity=checked))[2]
    return report.select("operation", "actions", F.col("error").isNotNull().alias("failed"))


@query("retrieval_plan", None)
def retrieval_plan(spark, d):
    m = written(mem(spark, d), "records")  # read by many steps, each of which would join the texts of all documents again
    pad = lambda c: F.concat(F.lit("m"), F.lpad(F.col(c).cast("string"), 6, "0")).alias(c)
    edges = _edges(spark, d).select(pad("source"), pad("target"), "kind", "weight")
    s = SEARCH.using(min_expanded_score=0.05)
    return retrieval.retrieve(m, edges, vector_of(m, "m000000"), NEEDLES, "/p/3", m.where("n % 3 = 0").select("id"), s)
