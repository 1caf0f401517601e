"""Scans, clusters, conflicts, edges and promotion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake import filters
from keepsake.functions import text as tx
from keepsake.operators import clusters, graph, mutate, scans, vectors
from keepsake.queries.base import COS, EV, MEM, NOW, events, mem, query, r6, vector_of
from keepsake.runtime import table
from keepsake.settings import Settings

LOOSE = Settings(
    stale_days=14, stale_unused_days=10, low_usage_ratio_threshold=0.3, consolidation_threshold=0.3, cross_type_threshold=0.3,
    conflict_threshold=0.3, currentness_threshold=0.3, warning_threshold=0.3,
)


def _ids(df):
    return df.select("id", "type", "project")


@query("stale_scan", f"WITH {MEM} SELECT id, type, project FROM mem WHERE NOT deprecated AND last_used < {NOW - 14 * 86400000}")
def stale_scan(spark, d):
    return _ids(scans.stale(mem(spark, d), LOOSE, NOW))


@query("low_usage_scan", f"WITH {MEM} SELECT id, type, project FROM mem WHERE NOT deprecated AND retrieval_count >= 5 AND usage_count / retrieval_count < 0.3")
def low_usage_scan(spark, d):
    return _ids(scans.low_usage(mem(spark, d), LOOSE))


@query("zero_usage_scan", f"WITH {MEM} SELECT id, type, project FROM mem WHERE NOT deprecated AND retrieval_count >= 5 AND usage_count = 0")
def zero_usage_scan(spark, d):
    return _ids(scans.zero_usage(mem(spark, d), LOOSE))


@query("stale_unused_scan", f"WITH {MEM} SELECT id, type, project FROM mem WHERE NOT deprecated AND ts_ms < {NOW - 10 * 86400000} AND usage_count = 0 AND retrieval_count = 0")
def stale_unused_scan(spark, d):
    return _ids(scans.stale_unused(mem(spark, d), LOOSE, NOW))


@query("promotion_candidates", f"WITH {MEM} SELECT id, type, project FROM mem WHERE NOT deprecated AND scope = 'project' AND type IN ('command', 'error', 'discovery') AND CASE WHEN type = 'command' THEN success_count >= 2 ELSE usage_count >= 2 END AND (retrieval_count < 3 OR usage_count / retrieval_count >= 0.3)")
def promotion_candidates(spark, d):
    return _ids(scans.promotion_candidates(mem(spark, d), LOOSE, NOW))


@query("skill_candidates", f"WITH {MEM} SELECT CASE WHEN project = '/p/0' THEN 'global' ELSE project END AS project, count(*) AS n, min(id) AS first_id FROM mem WHERE NOT deprecated AND ((type = 'procedure' AND usage_count >= 5) OR (type = 'discovery' AND usage_count >= 3 AND success_count >= 2)) GROUP BY ALL")
def skill_candidates(spark, d):
    m = mem(spark, d).withColumn("confidence", F.when(F.col("success_count") >= 2, "verified").otherwise("inferred"))
    rows = scans.documentation_candidates(m.withColumn("project", F.when(F.col("project") != "/p/0", F.col("project")).otherwise("  ")))
    return rows.groupBy("project").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("quality_scan", f"""WITH {MEM} SELECT id, CASE WHEN n % 6 = 0 THEN 'quality:tool-result-prefix' WHEN n % 6 = 1 THEN 'quality:persisted-output-pointer'
 WHEN n % 6 = 2 AND type IN ('error', 'warning') AND n % 4 = 0 THEN 'quality:vague-extension-error' WHEN n % 6 = 3 AND type IN ('command', 'error', 'warning') AND n % 8 = 0 THEN 'quality:raw-metric-dump' END AS reason FROM mem
 WHERE n % 6 < 2 OR (n % 6 = 2 AND type IN ('error', 'warning') AND n % 4 = 0) OR (n % 6 = 3 AND type IN ('command', 'error', 'warning') AND n % 8 = 0)""")
def quality_scan(spark, d):
    m = mem(spark, d)
    n, nl = F.col("n") % 6, "\n"
    primary = (
        F.when(n == 0, F.concat(F.lit("[Tool Result] "), F.col("exact_text"))).when(n == 1, "Output too large. Full output saved to /tmp/x.txt")
        .when(n == 2, "extension timeout").when(n == 3, f"reward: 1{nl}loss = 2{nl}fps 30").otherwise("plain words")
    )
    cause = F.when(F.col("n") % 8 == 0, "unknown").otherwise("the reward was scaled twice")
    remedy = F.when(F.col("n") % 4 == 0, "retry").otherwise("restart the browser first")
    return m.select("id", scans.quality_reason(F.col("type"), primary, F.lit(""), [remedy], [cause]).alias("reason")).where("reason is not null")


PAIRS = f"pairs AS (SELECT a.id AS a, b.id AS b, a.type AS ta, b.type AS tb, a.project AS pa, b.project AS pb, {COS.format(a='a.embedding', b='b.embedding')} AS s FROM mem a JOIN mem b ON a.id <> b.id WHERE NOT a.deprecated AND NOT b.deprecated)"


def _active(spark, d):
    return mem(spark, d).where(~F.col("deprecated"))


@query("knn_same_type", f"WITH {MEM}, {PAIRS} SELECT a AS id, b AS other, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM pairs WHERE ta = tb AND s >= 0.3) WHERE r <= 12")
def knn_same_type(spark, d):
    m = _active(spark, d)
    return vectors.neighbours(m, m, 12, 0.3, same=("type",)).select("id", "other", r6("similarity"), "rank")


@query("knn_cross_type", f"WITH {MEM}, {PAIRS} SELECT a AS id, b AS other, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM pairs WHERE ta <> tb AND s >= 0.3) WHERE r <= 12")
def knn_cross_type(spark, d):
    m = _active(spark, d)
    return vectors.neighbours(m, m, 12, 0.3, differ="type").select("id", "other", r6("similarity"), "rank")


CHECKED = NOW - 12 * 86400000  # the records' times stand in for those of their last check


def _clusters(spark, d, cross_type=False):
    m = _active(spark, d)
    return clusters.similarity_clusters(m, LOOSE, cross_type, m.where(filters.due(F.col("ts_ms"), CHECKED)))


def _closure(kind: str) -> str:
    cond = "ta = tb" if kind == "same" else "ta <> tb"
    return f"""near AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM pairs WHERE {cond} AND s >= 0.3) WHERE r <= 12 AND a IN (SELECT id FROM mem WHERE ts_ms < {CHECKED})),
 e AS (SELECT a, b FROM near UNION SELECT b, a FROM near), walk AS (SELECT a, a AS b FROM e UNION SELECT w.a, e.b FROM walk w JOIN e ON w.b = e.a),
 comp AS (SELECT a AS id, min(b) AS cluster FROM walk GROUP BY a), best AS (SELECT b AS id, max(s) AS s FROM near GROUP BY b),
 cl AS (SELECT cluster, comp.id, CASE WHEN ts_ms < {CHECKED} THEN 1.0 ELSE s END AS s, type FROM comp LEFT JOIN best USING (id) JOIN mem USING (id))"""


@query("same_type_clusters", f"WITH RECURSIVE {MEM}, {PAIRS}, {_closure('same')} SELECT cluster, id, round(s, 6) AS similarity, type FROM cl")
def same_type_clusters(spark, d):
    return _clusters(spark, d).select("cluster", "id", r6("similarity"), "type")


@query("cross_type_clusters", f"WITH RECURSIVE {MEM}, {PAIRS}, {_closure('cross')} SELECT cluster, id, round(s, 6) AS similarity, type FROM cl WHERE cluster IN (SELECT cluster FROM cl GROUP BY cluster HAVING count(DISTINCT type) > 1)")
def cross_type_clusters(spark, d):
    return _clusters(spark, d, True).select("cluster", "id", r6("similarity"), "type")


@query("capped_clusters", f"WITH RECURSIVE {MEM}, {PAIRS}, {_closure('same')}, c AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, id) AS p FROM cl) SELECT cluster, id, CAST(p AS INT) AS place FROM c WHERE p <= 2")
def capped_clusters(spark, d):
    return clusters.capped(_clusters(spark, d), 2).select("cluster", "id", "place")


KEEP = "k AS (SELECT cl.cluster, id, first_value(id) OVER (PARTITION BY cl.cluster ORDER BY success_count DESC, last_used DESC, ts_ms DESC, id) AS keeper, success_count, failure_count, retrieval_count, usage_count, last_used FROM cl JOIN mem USING (id))"


@query("keeper_merge", f"WITH RECURSIVE {MEM}, {PAIRS}, {_closure('same')}, {KEEP} SELECT keeper, CAST(sum(success_count) AS BIGINT) AS success_count, CAST(sum(failure_count) AS BIGINT) AS failure_count, CAST(sum(retrieval_count) AS BIGINT) AS retrieval_count, CAST(sum(usage_count) AS BIGINT) AS usage_count, max(last_used) AS last_used, count(*) AS members FROM k GROUP BY keeper")
def keeper_merge(spark, d):
    m = _active(spark, d)
    return clusters.merged(_clusters(spark, d), m)[0]


@query("merge_actions", f"WITH RECURSIVE {MEM}, {PAIRS}, {_closure('same')}, {KEEP} SELECT id, 'consolidation:merged-into:' || keeper AS reason, keeper AS superseding FROM k WHERE id <> keeper")
def merge_actions(spark, d):
    m = _active(spark, d)
    return clusters.merged(_clusters(spark, d), m)[1]


@query("fallback_keeper", f"""WITH {MEM} SELECT project AS cluster, id, keeper FROM (SELECT project, id, first_value(id) OVER (PARTITION BY project ORDER BY
 CASE type WHEN 'procedure' THEN 4 WHEN 'warning' THEN 3 WHEN 'error' THEN 2 WHEN 'discovery' THEN 1 ELSE 0 END DESC, CASE WHEN retrieval_count > 0 THEN usage_count / retrieval_count ELSE usage_count END DESC,
 usage_count DESC, success_count DESC, last_used DESC, ts_ms DESC, id) AS keeper FROM mem)""")
def fallback_keeper(spark, d):
    m = mem(spark, d)
    return clusters.keepers(m.select(F.col("project").alias("cluster"), "id"), m, clusters.fallback_order())


@query("first_group_wins", f"WITH {MEM}, g AS (SELECT n % 17 AS group_no, 'm' || lpad(CAST(n % 5 AS VARCHAR), 6, '0') AS keeper, 'm' || lpad(CAST(n // 3 AS VARCHAR), 6, '0') AS id FROM mem) SELECT group_no, keeper, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY group_no) AS r FROM (SELECT group_no, min(keeper) AS keeper, id FROM g WHERE id <> keeper GROUP BY group_no, id)) WHERE r = 1")
def first_group_wins(spark, d):
    pad = lambda c: F.concat(F.lit("m"), F.lpad(c.cast("string"), 6, "0"))
    n = F.col("n")
    g = mem(spark, d).select((n % 17).alias("group_no"), pad(n % 5).alias("keeper"), pad(F.floor(n / 3)).alias("id"))
    g = mutate.first_by(g.where("id <> keeper"), ["group_no", "id"], [F.col("keeper")])
    return clusters.first_group_wins(g)


@query("verdict_key", f"WITH {MEM} SELECT project, sha256('v1|same|' || string_agg(id, ',' ORDER BY id)) AS key FROM mem GROUP BY project")
def verdict_key(spark, d):
    g = mem(spark, d).groupBy("project").agg(F.collect_list("id").alias("ids"))
    return g.select("project", clusters.verdict_key("v1", F.lit("same"), F.col("ids")).alias("key"))


@query("unsettled_clusters", f"WITH {MEM} SELECT id AS key, type AS content_hash FROM mem WHERE NOT (n % 2 = 0 AND ts_ms > {NOW - 20 * 86400000})")
def unsettled_clusters(spark, d):
    m = mem(spark, d)
    c = m.select(F.col("id").alias("key"), F.col("type").alias("content_hash"))
    v = m.where("n % 2 = 0").select(F.col("id").alias("key"), F.col("type").alias("content_hash"), F.col("ts_ms").alias("checked_at"))
    return clusters.unsettled(c, v, LOOSE.using(no_merge_backoff_days=20), NOW)


@query("conflict_pairs", f"WITH {MEM}, {PAIRS} SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(s), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM pairs WHERE ta = tb AND pa = pb AND s >= 0.3) p WHERE r <= 5 GROUP BY least(p.a, p.b), greatest(p.a, p.b)")
def conflict_pairs(spark, d):
    return clusters.conflict_pairs(_active(spark, d), LOOSE).select("a", "b", r6("similarity"))


@query("conflict_verdict", f"WITH {MEM} SELECT a.id, CASE WHEN a.n % 3 = 0 THEN CASE WHEN a.ts_ms < b.ts_ms THEN 'keep_both' ELSE 'deprecate_existing' END ELSE 'keep_both' END AS verdict FROM mem a JOIN mem b ON b.n = a.n + 1")
def conflict_verdict(spark, d):
    m = mem(spark, d)
    b = m.select((F.col("n") - 1).alias("n"), F.col("ts_ms").alias("other_ms"))
    verdict = F.when(F.col("n") % 3 == 0, "deprecate_existing").otherwise("keep_both")
    return m.join(b, "n").select("id", clusters.settled_verdict(verdict, F.col("ts_ms"), F.col("other_ms")).alias("verdict"))


# seeds one after the other, with the list of used ids; {kinds}, {often}, {near}, {most}, {by} and {alone} say which clusters
STARS = f"""
pool AS (SELECT * FROM mem WHERE NOT deprecated AND type IN ({{kinds}})),
seeds AS (SELECT *, row_number() OVER (ORDER BY ts_ms, id) AS i FROM pool WHERE ts_ms < {CHECKED} AND {{often}}),
sims AS (
    SELECT s.i, p.id AS other, p.failure_count, {COS.format(a="s.embedding", b="p.embedding")} AS s,
        row_number() OVER (PARTITION BY s.i ORDER BY {COS.format(a="s.embedding", b="p.embedding")} DESC, p.id) AS r
    FROM seeds s JOIN pool p ON s.project = p.project AND s.id <> p.id AND {{by}}),
lists AS (
    SELECT seeds.i, seeds.id, coalesce(list(other ORDER BY r) FILTER (other IS NOT NULL), []) AS near
    FROM seeds LEFT JOIN (SELECT * FROM sims WHERE r <= {{near}} AND s >= 0.3 AND {{often}}) x ON x.i = seeds.i GROUP BY ALL),
steps AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR[]) AS took
    UNION ALL SELECT i, CASE WHEN took IS NULL THEN used WHEN len(took) > 0 OR {{alone}} THEN list_concat(used, took, [id]) ELSE used END, id, took
    FROM (
        SELECT l.i, used, l.id, CASE WHEN NOT list_contains(used, l.id) THEN list_filter(near, lambda x: NOT list_contains(used, x))[1:{{most}}] END AS took
        FROM steps JOIN lists l ON l.i = steps.i + 1)),
taken AS (SELECT id AS cluster, unnest(list_concat(took, [id])) AS id FROM steps WHERE len(took) > 0),
stars AS (SELECT * FROM taken UNION ALL SELECT id, id FROM steps WHERE len(took) = 0 AND id NOT IN (SELECT id FROM taken))"""


@query("currentness_clusters", f"WITH RECURSIVE {MEM}, {STARS.format(kinds="'discovery'", often='true', near=12, most=7, by='true', alone='false')} SELECT cluster, id FROM stars")
def currentness_clusters(spark, d):
    found = _active(spark, d).where("type = 'discovery'")
    return clusters.currentness_clusters(found, LOOSE, found.where(filters.due(F.col("ts_ms"), CHECKED)))


@query(
    "warning_clusters",
    f"""
WITH RECURSIVE {MEM}, {STARS.format(kinds="'command', 'error'", often="failure_count >= 2", near=5, most=5, by="s.type = p.type", alone="true")}
SELECT cluster, id, CAST(sum(failure_count) OVER (PARTITION BY cluster) AS BIGINT) AS failures FROM stars JOIN mem USING (id)""",
)
def warning_clusters(spark, d):
    found = _active(spark, d).where("type in ('command', 'error')")
    return clusters.warning_clusters(found, LOOSE, found.where(filters.due(F.col("ts_ms"), CHECKED)))


@query("similarity_tiers", f"WITH {MEM}, t AS (SELECT d.id, {COS.format(a='d.embedding', b='a.embedding')} AS s, row_number() OVER (PARTITION BY d.id ORDER BY {COS.format(a='d.embedding', b='a.embedding')} DESC, a.id) AS r FROM mem d JOIN mem a ON d.deprecated AND NOT a.deprecated AND (d.project = a.project OR a.scope = 'global' OR d.scope = 'global')), x AS (SELECT id, max(s) FILTER (WHERE r = 1) * 2 AS t1, max(s) FILTER (WHERE r = 2) * 2 AS t2 FROM t GROUP BY id) SELECT id, round(t1, 6) AS top1, CASE WHEN t1 < 0.65 THEN 'none' WHEN t1 >= 0.85 THEN CASE WHEN t1 - coalesce(t2, 0) >= 0.05 THEN 'strong' ELSE 'multi' END ELSE 'weak' END AS tier FROM x")
def similarity_tiers(spark, d):
    m = mem(spark, d)
    near = vectors.neighbours(m.where("deprecated"), _active(spark, d), 5, -1.0, same=("project",), or_global=True)
    top = near.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("b"))
    a, b = F.col("a") * 2, F.coalesce(F.col("b") * 2, F.lit(0.0))  # twice the cosine: the test vectors are far apart
    return top.select("id", F.round(a, 6).alias("top1"), scans.similarity_tier(a, a - b).alias("tier"))


CO = "g AS (SELECT session, k, max(ts_ms) AS at FROM ev GROUP BY session, k), co AS (SELECT x.k AS a, y.k AS b, count(*) AS n, max(greatest(x.at, y.at)) AS last_at FROM g x JOIN g y ON x.session = y.session AND x.k < y.k GROUP BY x.k, y.k)"


@query("co_injection_edges", f"WITH {EV}, {CO} SELECT a, b, n, last_at, round(least(1.0, n / 10), 6) AS weight FROM co WHERE n >= 3")
def co_injection_edges(spark, d):
    return graph.co_injection_edges(events(spark, d), "session", "k", "ts_ms").select("a", "b", "n", "last_at", r6("weight"))


EDGES = "ed AS (SELECT a AS source, b AS target, CASE WHEN (a + b) % 5 = 0 THEN 'shares_entity' ELSE 'relates_to' END AS kind, least(1.0, n / 10) AS weight, n AS reinforcement, last_at FROM co WHERE n >= 1)"


def _edges(spark, d):
    e = graph.co_injection_edges(events(spark, d), "session", "k", "ts_ms", min_count=1)
    kind = F.when((F.col("a") + F.col("b")) % 5 == 0, "shares_entity").otherwise("relates_to")
    return e.select(F.col("a").alias("source"), F.col("b").alias("target"), kind.alias("kind"), "weight", F.col("n").alias("reinforcement"), "last_at")


@query("cap_edges", f"WITH {EV}, {CO}, {EDGES} SELECT source, target, kind, reinforcement FROM (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY weight DESC, reinforcement DESC, last_at DESC, target) AS r FROM ed) WHERE r <= 5 OR kind <> 'relates_to'")
def cap_edges(spark, d):
    return graph.cap_edges(_edges(spark, d), 5, "relates_to").select("source", "target", "kind", "reinforcement")


@query("prune_edges", f"WITH {EV}, {CO}, old AS (SELECT DISTINCT k AS source, (k + 13) % 100 AS target, 'relates_to' AS kind FROM ev UNION ALL SELECT DISTINCT k, (k + 29) % 100, 'supersedes' FROM ev) SELECT old.* FROM old LEFT JOIN co ON co.a = least(source, target) AND co.b = greatest(source, target) AND n >= 2 WHERE kind <> 'relates_to' OR co.a IS NOT NULL")
def prune_edges(spark, d):
    e = events(spark, d).select("k").distinct()
    old = e.select(F.col("k").alias("source"), ((F.col("k") + 13) % 100).alias("target"), F.lit("relates_to").alias("kind"))
    old = old.unionByName(e.select(F.col("k").alias("source"), ((F.col("k") + 29) % 100).alias("target"), F.lit("supersedes").alias("kind")))
    seen = graph.co_injection_edges(events(spark, d), "session", "k", "ts_ms", min_count=2).select("a", "b")
    pair = (F.least("source", "target") == F.col("a")) & (F.greatest("source", "target") == F.col("b"))
    return old.where("kind <> 'relates_to'").unionByName(old.where("kind = 'relates_to'").join(seen, pair, "left_semi"))


@query("upsert_edges", f"WITH {EV}, {CO}, {EDGES}, o AS (SELECT * FROM ed WHERE source % 2 = 0), w AS (SELECT source, target, kind, weight * 2 AS weight, reinforcement FROM ed WHERE target % 3 = 0) SELECT coalesce(o.source, w.source) AS source, coalesce(o.target, w.target) AS target, coalesce(o.kind, w.kind) AS kind, round(greatest(0, least(1, greatest(coalesce(o.weight, 0), coalesce(w.weight, 0)))), 6) AS weight, coalesce(o.reinforcement, 0) + coalesce(w.reinforcement, 0) AS reinforcement FROM o FULL JOIN w ON o.source = w.source AND o.target = w.target AND o.kind = w.kind")
def upsert_edges(spark, d):
    e = _edges(spark, d).drop("last_at")
    found = graph.upsert_edges(e.where("source % 2 = 0"), e.where("target % 3 = 0").withColumn("weight", F.col("weight") * 2))
    return found.select("source", "target", "kind", r6("weight"), "reinforcement")


@query("entity_edges", f"""WITH {MEM}, ent AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(exact_text), '[\\p{{L}}]{{8,}}')) AS e FROM mem), n AS (SELECT count(*) AS n FROM mem),
 df AS (SELECT e, count(*) AS df FROM ent GROUP BY e HAVING count(*) BETWEEN 2 AND (SELECT least(40, greatest(2, CAST(floor(0.1 * n) AS INT))) FROM n)),
 i AS (SELECT e, greatest(0, least(1, ln(n.n / df) / ln(n.n / 2))) AS idf FROM df, n), h AS (SELECT id, e, idf FROM ent JOIN i USING (e))
SELECT x.id AS a, y.id AS b, round(least(1.0, 0.4 * sum(x.idf)), 6) AS weight, count(*) AS shared FROM h x JOIN h y ON x.e = y.e AND x.id < y.id GROUP BY x.id, y.id HAVING least(1.0, 0.4 * sum(x.idf)) >= 0.1""")
def entity_edges(spark, d):
    m = mem(spark, d)
    rows = m.select("id", F.explode(tx.long_words(F.col("exact_text"))).alias("entity"))
    return graph.entity_edges(rows, m.count()).select("a", "b", r6("weight"), "shared")


HOP = f"""q AS (SELECT embedding AS v FROM mem WHERE id = 'm000000'), res AS (SELECT id, {COS.format(a='m.embedding', b='q.v')} AS s FROM mem m, q WHERE NOT deprecated ORDER BY s DESC, id LIMIT 5),
 {{co}}, el AS (SELECT 'm' || lpad(CAST(a AS VARCHAR), 6, '0') AS source, 'm' || lpad(CAST(b AS VARCHAR), 6, '0') AS target, least(1.0, n / 100) AS weight FROM co WHERE (a + b) % 5 <> 0)"""


@query("expand_relations", f"""WITH {MEM}, {EV}, {HOP.format(co=CO)}, st AS (SELECT target AS id, s * weight * 0.6 AS score, source AS parent, row_number() OVER (PARTITION BY target ORDER BY s * weight * 0.6 DESC, source) AS r
 FROM res JOIN el ON res.id = el.source JOIN mem t ON t.id = target AND NOT t.deprecated WHERE target NOT IN (SELECT id FROM res)) SELECT id, round(score, 6) AS score, parent, 1 AS hop FROM st WHERE r = 1 ORDER BY st.score DESC, id LIMIT 5""")
def expand_relations(spark, d):
    m = mem(spark, d)
    found = vectors.top_k(m.where("not deprecated"), vector_of(m, "m000000"), 5).select("id", F.col("similarity").alias("score"), "similarity")
    pad = lambda c: F.concat(F.lit("m"), F.lpad(F.col(c).cast("string"), 6, "0")).alias(c)
    edges = _edges(spark, d).select(pad("source"), pad("target"), "kind", F.least(F.lit(1.0), F.col("reinforcement") / 100).alias("weight"))
    return graph.expand(found, edges, m).select("id", r6("score"), "parent", "hop")


ALL_EDGES = HOP.format(co=CO).replace(" WHERE (a + b) % 5 <> 0", "")
TWO_HOPS = f"""WITH {MEM}, {EV}, {ALL_EDGES}, act AS (SELECT id FROM mem WHERE NOT deprecated AND id NOT IN (SELECT id FROM res)),
s1 AS (SELECT target AS id, s AS root, weight AS walked, s * weight * 0.6 AS score, source AS parent, row_number() OVER (PARTITION BY target ORDER BY s * weight * 0.6 DESC, source) AS r
 FROM res JOIN el ON res.id = source JOIN act ON act.id = target),
k1 AS (SELECT id, root, walked, score, parent, 1 AS hop FROM s1 WHERE r = 1 ORDER BY score DESC, id LIMIT 8),
s2 AS (SELECT target AS id, root * walked * weight * 0.36 AS score, k1.id AS parent, row_number() OVER (PARTITION BY target ORDER BY root * walked * weight * 0.36 DESC, k1.id) AS r
 FROM k1 JOIN el ON k1.id = source JOIN act ON act.id = target),
u AS (SELECT id, score, parent, hop FROM k1 UNION ALL SELECT id, score, parent, 2 FROM s2 WHERE r = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, hop) AS r FROM u)
SELECT id, round(score, 6) AS score, round(greatest(0.0, least(1.0, score)), 6) AS similarity, parent, CAST(hop AS INT) AS hop FROM b WHERE r = 1 ORDER BY b.score DESC, id LIMIT 8"""


@query("expand_two_hops", TWO_HOPS)
def expand_two_hops(spark, d):
    m = mem(spark, d)
    found = vectors.top_k(m.where("not deprecated"), vector_of(m, "m000000"), 5).select("id", F.col("similarity").alias("score"), "similarity")
    pad = lambda c: F.concat(F.lit("m"), F.lpad(F.col(c).cast("string"), 6, "0")).alias(c)
    edges = _edges(spark, d).select(pad("source"), pad("target"), "kind", F.least(F.lit(1.0), F.col("reinforcement") / 100).alias("weight"))
    return graph.expand(found, edges, m, hops=2, most=8, entity_edges=True).select("id", r6("score"), r6("similarity"), "parent", "hop")


@query("provenance_backfill", f"WITH {EV}, a AS (SELECT k AS id, event_type, ts_ms, event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS p FROM ev WHERE event_type IN ('purchase', 'click')) SELECT id, event_type AS kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, ts_ms, event_id) AS r FROM a) WHERE r = 1")
def provenance_backfill(spark, d):
    rows = events(spark, d).where("event_type in ('purchase', 'click')").withColumn("p", (F.col("event_type") != "purchase").cast("int"))
    return mutate.first_by(rows, ["k"], [F.col("p"), F.col("ts_ms"), F.col("event_id")]).select(F.col("k").alias("id"), F.col("event_type").alias("kind"), "event_id")


@query("verdict_normalise", "SELECT d.doc_id, CASE WHEN quality = 1 THEN 'helpful' WHEN quality = 0 THEN 'unhelpful' ELSE 'unknown' END AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def verdict_normalise(spark, d):
    v = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "helpful").otherwise("unhelpful").alias("verdict"))
    return table(spark, d, "documents").select("doc_id").join(v, "doc_id", "left").select("doc_id", F.coalesce("verdict", F.lit("unknown")).alias("verdict"))


@query("usage_delta", f"WITH {MEM} SELECT id, CASE WHEN type = 'command' AND n % 3 = 0 THEN 1 ELSE 0 END AS success, CASE WHEN (type = 'command' AND n % 3 <> 0) OR type = 'error' THEN 1 ELSE 0 END AS failure FROM mem")
def usage_delta(spark, d):
    command = F.col("type") == "command"
    good = command & (F.col("n") % 3 == 0)
    bad = (command & (F.col("n") % 3 != 0)) | (F.col("type") == "error")
    return mem(spark, d).select("id", good.cast("int").alias("success"), bad.cast("int").alias("failure"))


@query("pair_compare", f"WITH {MEM} SELECT a.id AS a, b.id AS b, round({COS.format(a='a.embedding', b='b.embedding')}, 6) AS similarity, a.usage_count - b.usage_count AS usage_gap FROM mem a JOIN mem b ON b.n = a.n + 1")
def pair_compare(spark, d):
    m = mem(spark, d)
    b = m.select((F.col("n") - 1).alias("n"), F.col("id").alias("b"), F.col("embedding").alias("e"), F.col("usage_count").alias("u"))
    return m.join(b, "n").select(F.col("id").alias("a"), "b", F.round(vectors.cosine(F.col("embedding"), F.col("e")), 6).alias("similarity"), (F.col("usage_count") - F.col("u")).alias("usage_gap"))


@query("ingest_decisions", f"WITH {MEM}, t AS (SELECT s.id, o.id AS other, {COS.format(a='s.embedding', b='o.embedding')} AS s, row_number() OVER (PARTITION BY s.id ORDER BY {COS.format(a='s.embedding', b='o.embedding')} DESC, o.id) AS r FROM mem s JOIN mem o ON s.n % 10 = 0 AND o.n % 10 <> 0 AND s.project = o.project AND s.type = o.type AND NOT o.deprecated) SELECT m.id, CASE WHEN s >= 0.2 THEN 'update' ELSE 'insert' END AS action, CASE WHEN s >= 0.2 THEN other END AS target FROM mem m LEFT JOIN t ON t.id = m.id AND r = 1 WHERE m.n % 10 = 0")
def ingest_decisions(spark, d):
    m = mem(spark, d)
    fresh = m.where("n % 10 = 0")
    near = vectors.neighbours(fresh, m.where("n % 10 <> 0 and not deprecated"), 1, 0.2, same=("project", "type"))
    rows = fresh.select("id").join(near.select("id", F.col("other").alias("target")), "id", "left")
    return rows.select("id", F.when(F.col("target").isNull(), "insert").otherwise("update").alias("action"), "target")


@query("top_margin", f"WITH {EV}, c AS (SELECT session, k, count(*) AS n FROM ev GROUP BY session, k), r AS (SELECT session, n, row_number() OVER (PARTITION BY session ORDER BY n DESC, k) AS r FROM c) SELECT session, max(n) FILTER (WHERE r = 1) - coalesce(max(n) FILTER (WHERE r = 2), 0) AS margin FROM r GROUP BY session")
def top_margin(spark, d):
    c = events(spark, d).groupBy("session", "k").agg(F.count("*").alias("n"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("n"), "k"))).where("r <= 2")
    pick = lambda i: F.max(F.when(F.col("r") == i, F.col("n")))
    return r.groupBy("session").agg((pick(1) - F.coalesce(pick(2), F.lit(0))).alias("margin"))
