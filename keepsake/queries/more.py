"""Context texts, presets, writes, reports and reviews."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake import filters
from keepsake.functions import text as tx
from keepsake.operators import activity, evaluate, graph, runs, scans, search, vectors, writes
from keepsake.plans import context
from keepsake.queries.base import COS, EV, MEM, NOW, events, mem, query, r6, vector_of
from keepsake.queries.measuring import ARMS, _arms
from keepsake.queries.searching import KW, LOOSE, NEEDLES, QV, RATIO, SIM, TWO, Q, _two_scope
from keepsake.runtime import shared_folder, table

PRE = context.PREAMBLE
ONE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _entry():
    """A line a record: warnings as such, others by a snippet of their text."""
    text = F.col("exact_text")
    warning = context.warning_text(F.when(F.col("n") % 2 == 0, "critical").otherwise("warning"), text, F.col("project"), F.col("scope"))
    return F.when(F.col("type") == "warning", warning).when(F.col("n") % 17 != 0, tx.snippet(text, 400))


LINE = f"""CASE WHEN type = 'warning' THEN CASE WHEN n % 2 = 0 THEN '🚨' ELSE '⚠️' END || ' Don''t: ' || {ONE.format('exact_text')} || ' → Use: ' || project || ' (' || scope || ')'
 WHEN n % 17 <> 0 THEN {ONE.format('exact_text')} END"""
# a warning is cut at 1000 characters, another line at 400
MOST = "CASE WHEN type = 'warning' THEN 1000 ELSE 400 END"
ENTRY = f"""CASE WHEN length({LINE}) <= {MOST} THEN {LINE} ELSE substr({LINE}, 1, {MOST} - 3) || '...' END"""
TOK = "CAST(ceil(length({}) / 4) AS BIGINT)"


@query("warning_text", f"WITH {MEM} SELECT id, {ENTRY} AS text FROM mem WHERE type = 'warning'")
def warning_text(spark, d):
    return mem(spark, d).where("type = 'warning'").select("id", _entry().alias("text"))


@query("context_text", f"""WITH {MEM}, c AS (SELECT project, id, type, row_number() OVER (PARTITION BY project ORDER BY usage_count DESC, id) AS place, {ENTRY} AS entry FROM mem WHERE NOT deprecated),
 w AS (SELECT *, sum({TOK.format('entry')}) OVER (PARTITION BY project ORDER BY place, id) + 9 AS used, row_number() OVER (PARTITION BY project ORDER BY place, id) AS k FROM c WHERE type = 'warning'),
 ws AS (SELECT project, string_agg('- ' || entry, chr(10) ORDER BY place, id) AS t, max(used) AS spent, list(id ORDER BY place, id) AS ids FROM w WHERE used <= 240 AND used + {-(-len(PRE) // 4)} <= 800 AND k <= 5 GROUP BY project),
 m AS (SELECT c.*, sum({TOK.format("'- ' || entry")}) OVER (PARTITION BY project ORDER BY place, id) + coalesce(spent, 0) + {-(-len(PRE) // 4)} + 10 AS used, row_number() OVER (PARTITION BY project ORDER BY place, id) AS k FROM c LEFT JOIN ws USING (project) WHERE type <> 'warning' AND length(trim(entry)) > 0),
 ms AS (SELECT project, string_agg('- ' || entry, chr(10) ORDER BY place, id) AS t, list(id ORDER BY place, id) AS ids FROM m WHERE used <= 800 AND k <= 8 GROUP BY project)
SELECT p.project, CASE WHEN ws.t IS NULL AND ms.t IS NULL THEN '' ELSE concat_ws(chr(10), '{PRE}', '<known-pitfalls>' || chr(10) || ws.t || chr(10) || '</known-pitfalls>', '<prior-knowledge>' || chr(10) || ms.t || chr(10) || '</prior-knowledge>') END AS context,
 len(list_concat(coalesce(ws.ids, []), coalesce(ms.ids, []))) AS n FROM (SELECT DISTINCT project FROM mem) p LEFT JOIN ws USING (project) LEFT JOIN ms USING (project)""")
def context_text(spark, d):
    m = mem(spark, d)
    place = F.row_number().over(Window.partitionBy("project", "deprecated").orderBy(F.desc("usage_count"), "id"))
    found = m.select("project", "id", "type", "deprecated", place.alias("place"), _entry().alias("entry"))
    return context.assemble(found, LOOSE.using(max_tokens=800), "project").select("project", "context", F.size("ids").cast("long").alias("n"))


@query("tool_search", f"""WITH {MEM}, {QV}, {KW.format(per=4, n=10)}, vec AS (SELECT id, s FROM (SELECT id, {SIM} AS s FROM mem m, q WHERE NOT deprecated ORDER BY s DESC, id LIMIT 10) WHERE s >= 0.15),
 b AS (SELECT coalesce(vec.id, kw.id) AS id, coalesce(s, 0) AS s, kw.id IS NOT NULL AS keyword_match FROM vec FULL JOIN kw ON vec.id = kw.id),
 f AS (SELECT b.*, (CASE WHEN keyword_match THEN 1.0 ELSE 0 END) + s + ({RATIO}) * 0.2 AS score FROM b JOIN mem USING (id))
SELECT id, round(CAST(s AS DOUBLE), 3) AS similarity, keyword_match, round(CAST(score AS DOUBLE), 3) AS score FROM f WHERE score >= 0.2 ORDER BY f.score DESC, s DESC, id LIMIT 10""")
def tool_search(spark, d):
    m = mem(spark, d)
    return search.tool_search(m, vector_of(m, Q[0]), NEEDLES, LOOSE)


@query("chat_search", f"WITH {MEM}, {QV} SELECT id, round({SIM}, 6) AS similarity FROM mem m, q WHERE NOT deprecated ORDER BY {SIM} DESC, id LIMIT 10 OFFSET 20")
def chat_search(spark, d):
    m = mem(spark, d)
    return search.chat_search(m, vector_of(m, Q[0]), LOOSE, 20, 10).select("id", r6("similarity"))


@query("paged_search", f"""WITH {MEM}, {QV}, {KW.format(per=3, n=9)}, vec AS (SELECT id, s FROM (SELECT id, {SIM} AS s FROM mem m, q ORDER BY s DESC, id LIMIT 9) WHERE s >= 0.15),
 b AS (SELECT coalesce(vec.id, kw.id) AS id, coalesce(s, 0) AS s, kw.id IS NOT NULL AS hit FROM vec FULL JOIN kw ON vec.id = kw.id),
 f AS (SELECT b.*, (CASE WHEN hit THEN 0.3 ELSE 0 END) + s * 0.7 + ({RATIO}) * 0.2 AS score FROM b JOIN mem USING (id)),
 g AS (SELECT * FROM f WHERE score >= 0.2 ORDER BY score DESC, s DESC, id LIMIT 9), h AS (SELECT *, row_number() OVER (ORDER BY score DESC, s DESC, id) AS place, count(*) OVER () AS total FROM g)
SELECT id, round(score, 6) AS score, CAST(place AS INT) AS place, total > 8 AS has_more, total FROM h WHERE place > 4 AND place <= 8""".replace("JOIN (VALUES", "JOIN (VALUES").replace("WHERE NOT deprecated)\n WHERE place", ")\n WHERE place"))
def paged_search(spark, d):
    m = mem(spark, d)
    return search.paged_search(m, vector_of(m, Q[0]), NEEDLES, LOOSE, 4, 4).select("id", r6("score"), "place", "has_more", "total")


RAW = f"""r AS (SELECT embedding AS v FROM mem WHERE id = 'm000001'), raw AS (SELECT id FROM mem WHERE NOT deprecated AND contains(lower(exact_text), 'tion')),
 qual AS (SELECT f.id, f.similarity, f.score, raw.id IS NOT NULL AS raw_match, {COS.format(a='m.embedding', b='r.v')} AS near, m.project, m.scope,
  CASE WHEN raw.id IS NOT NULL THEN {COS.format(a='m.embedding', b='r.v')} * 0.7 + least({COS.format(a='m.embedding', b='r.v')} / 0.15, 1) * 0.08 + ({RATIO}) * 0.2 + CASE WHEN m.project = '/p/3' THEN 0.05 ELSE 0 END END AS qualification
  FROM found f JOIN mem m USING (id) LEFT JOIN raw USING (id), r)"""


def _qualified(spark, d):
    m = mem(spark, d)
    raw = m.where(~F.col("deprecated") & filters.has_keyword("exact_text", NEEDLES[:1])).select("id", F.lit(1.0).alias("score"))
    return search.qualified(_two_scope(spark, d).select("id", "similarity", "score"), raw, m, vector_of(m, Q[1]), "/p/3", LOOSE)


@query("raw_qualification", f"WITH {MEM}, {TWO}, {RAW} SELECT id, round(CASE WHEN raw_match THEN greatest(similarity, near) ELSE similarity END, 6) AS similarity, round(greatest(score, coalesce(qualification, score)), 6) AS score, raw_match, round(qualification, 6) AS qualification FROM qual")
def raw_qualification(spark, d):
    return _qualified(spark, d).select("id", r6("similarity"), r6("score"), "raw_match", r6("qualification"))


def _gate(threshold: float) -> str:
    return f"""WITH {MEM}, {TWO}, {RAW}, a AS (SELECT greatest(0, max(near)) AS anchor FROM qual) SELECT id, round(greatest(score, coalesce(qualification, score)), 6) AS score, round(anchor, 6) AS anchor
 FROM qual, a WHERE anchor >= {threshold} OR (raw_match AND qualification >= 0.2 AND (project IN ('/p/3', '/p/1', '/p/5') OR scope = 'global'))"""


def _gated(spark, d, threshold):
    m = mem(spark, d)
    found = search.raw_anchored(_qualified(spark, d), m, vector_of(m, Q[1]), "/p/3", LOOSE.using(semantic_anchor_threshold=threshold), ["/p/1", "/p/5"])
    return found.select("id", r6("score"), r6("anchor"))


@query("raw_anchor_open", _gate(0.05))
def raw_anchor_open(spark, d):
    return _gated(spark, d, 0.05)


@query("raw_anchor_closed", _gate(0.999))
def raw_anchor_closed(spark, d):
    return _gated(spark, d, 0.999)


@query("project_ancestors", f"WITH {MEM}, p AS (SELECT DISTINCT '/w' || project || '/' || type || '/src' AS project FROM mem), r AS (SELECT DISTINCT '/w' || project AS root FROM mem WHERE n % 2 = 0 UNION SELECT '/w'), x AS (SELECT p.project, root, row_number() OVER (PARTITION BY p.project ORDER BY length(root) DESC) AS k FROM p JOIN r ON starts_with(p.project, root || '/')) SELECT project, root AS ancestor, CAST(k AS INT) AS place FROM x")
def project_ancestors(spark, d):
    m = mem(spark, d)
    roots = m.where("n % 2 = 0").select(F.concat(F.lit("/w"), "project").alias("root")).unionByName(m.select(F.lit("/w").alias("root")))
    return filters.known_ancestors(m.select(F.concat(F.lit("/w"), "project", F.lit("/"), "type", F.lit("/src")).alias("project")), roots)


# writes


def _payloads(spark, d):
    n, text = F.col("n"), F.col("exact_text")
    command = F.struct(F.when(n % 4 != 0, text).alias("command"), F.when(n % 3 == 0, "success").otherwise("odd").alias("outcome"), F.lit(0).alias("exitCode"), F.struct(F.col("project").alias("project")).alias("context"))
    discovery = F.struct(text.alias("what"), F.col("project").alias("where"), F.lit("seen").alias("evidence"), F.when(n % 4 != 0, "verified").alias("confidence"))
    content = F.when(F.col("type") == "command", F.to_json(command)).when(F.col("type") == "discovery", F.to_json(discovery)).otherwise("{}")
    return mem(spark, d).select("n", "id", F.when(n % 19 == 0, "note").otherwise(F.col("type")).alias("type"), content.alias("content"), "project", "embedding")


PROBLEM = "CASE WHEN n % 19 = 0 THEN 'unknown type' WHEN (type = 'command' AND n % 4 <> 0 AND n % 3 = 0) OR (type = 'discovery' AND n % 4 <> 0) THEN CASE WHEN len(embedding) <> 64 THEN 'vector length' END ELSE 'missing fields' END"


@query("insert_validated", f"WITH {MEM} SELECT id, type, CASE type WHEN 'command' THEN exact_text ELSE exact_text || chr(10) || project END AS exact_text, 'project' AS scope, {NOW} AS timestamp, 0 AS usage_count, false AS deprecated FROM mem WHERE ({PROBLEM}) IS NULL".replace(f"{NOW} AS", f"CAST({NOW} AS BIGINT) AS").replace("0 AS usage", "CAST(0 AS BIGINT) AS usage"))
def insert_validated(spark, d):
    rows, _ = writes.validated(_payloads(spark, d), NOW, 64)
    return rows.select("id", "type", "exact_text", "scope", "timestamp", "usage_count", "deprecated")


@query("insert_refused", f"WITH {MEM} SELECT id, {PROBLEM} AS problem FROM mem WHERE ({PROBLEM}) IS NOT NULL")
def insert_refused(spark, d):
    return writes.validated(_payloads(spark, d), NOW, 64)[1]


@query("deep_merge", f"WITH {MEM} SELECT id, CASE WHEN n % 2 = 0 THEN 'new' ELSE exact_text END AS command, CASE WHEN n % 3 <> 0 OR type IN ('command', 'error', 'procedure') THEN project END AS context_project, CASE WHEN n % 3 = 0 THEN '/tmp' END AS context_cwd FROM mem")
def deep_merge(spark, d):
    from keepsake.schema import PAYLOAD

    def payload(**given):
        return F.struct(*[(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in PAYLOAD.fields])

    def ctx(**given):
        kind = PAYLOAD["context"].dataType
        return F.struct(*[(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])

    n = F.col("n")
    old = payload(command=F.col("exact_text"), context=ctx(project=F.col("project")))
    new = payload(command=F.when(n % 2 == 0, "new"), context=F.when(n % 3 == 0, ctx(cwd=F.lit("/tmp"))))
    rows = mem(spark, d).select("id", "type", old.alias("o"), new.alias("w")).withColumn("p", writes.deep_merge(F.col("o"), F.col("w"), F.col("type")))
    return rows.select("id", "p.command", F.col("p.context.project").alias("context_project"), F.col("p.context.cwd").alias("context_cwd"))


@query("batch_update", f"WITH {MEM} SELECT id, CASE WHEN n % 2 = 0 AND n % 7 <> 0 THEN usage_count + 10 ELSE usage_count END AS usage_count, n % 2 = 0 AND n % 7 = 0 AS failed FROM mem")
def batch_update(spark, d):
    m = mem(spark, d).select("id", "n", "usage_count")
    after, failed = writes.batch_update(m, m.where("n % 2 = 0"), {"usage_count": F.col("usage_count") + 10}, F.col("n") % 7 != 0)
    return after.join(failed, "id", "left").select("id", "usage_count", F.col("stage").isNotNull().alias("failed"))


def _superseded(spark, d):
    m = mem(spark, d).withColumns({"deprecated_at": F.lit(None).cast("long"), "deprecated_reason": F.lit(None).cast("string"), "superseding_record_id": F.lit(None).cast("string")})
    by = F.when(F.col("n") % 15 == 0, F.lit("gone")).otherwise(F.lit("m000001"))
    actions = m.where("n % 5 = 0").select("id", F.lit("old").alias("reason"), by.alias("superseding"))
    edges = spark.createDataFrame([("m000001", "m000005", "supersedes", 0.5, 3)], "source string, target string, kind string, weight double, reinforcement long")
    return writes.supersede(m, actions, edges, NOW)


@query("supersede_edges", f"WITH {MEM} SELECT 'm000001' AS source, id AS target, CAST(1.0 AS DOUBLE) AS weight FROM mem WHERE n % 5 = 0 AND n % 15 <> 0")
def supersede_edges(spark, d):
    return _superseded(spark, d)[1].select("source", "target", "weight")


@query("supersede_failures", f"WITH {MEM} SELECT id, 'superseding record is missing' AS problem FROM mem WHERE n % 15 = 0")
def supersede_failures(spark, d):
    return _superseded(spark, d)[2]


@query(
    "ingest_sequence",
    f"""
WITH RECURSIVE {MEM}, fresh AS (SELECT *, row_number() OVER (ORDER BY n, id) AS i FROM mem WHERE n % 10 = 0),
near AS (
    SELECT f.i, t.id AS other, {COS.format(a="f.embedding", b="t.embedding")} AS s, t.n % 10 = 0 AS is_new
    FROM fresh f JOIN mem t ON f.project = t.project AND f.type = t.type AND (t.n % 10 = 0 AND t.n < f.n OR t.n % 10 <> 0 AND NOT t.deprecated)),
run AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS inserted, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS STRUCT(far DOUBLE, other VARCHAR)) AS best
    UNION ALL SELECT i, CASE WHEN best IS NULL THEN list_append(inserted, id) ELSE inserted END, id, best
    FROM (
        SELECT f.i, any_value(r.inserted) AS inserted, any_value(f.id) AS id,
            min(struct_pack(far := -x.s, other := x.other)) FILTER (x.s >= 0.2 AND (NOT x.is_new OR list_contains(r.inserted, x.other))) AS best
        FROM run r JOIN fresh f ON f.i = r.i + 1 LEFT JOIN near x ON x.i = f.i GROUP BY f.i))
SELECT id, CASE WHEN best IS NULL THEN 'insert' WHEN m.usage_count = t.usage_count THEN 'skipped' ELSE 'update' END AS action,
    best.other AS target, round(-best.far, 6) AS similarity
FROM run JOIN mem m USING (id) LEFT JOIN mem t ON t.id = best.other""",
)
def ingest_sequence(spark, d):
    m = mem(spark, d).withColumn("same_as", F.col("usage_count").cast("string"))
    fresh = m.where("n % 10 = 0").withColumn("seq", F.col("n"))
    return writes.ingest(fresh, m.where("n % 10 <> 0"), LOOSE.using(dedup_threshold=0.2)).select("id", "action", "target", r6("similarity"))


@query("compact_table", f"WITH {MEM} SELECT id, type, project, ts_ms, usage_count, md5(exact_text) AS text FROM mem")
def compact_table(spark, d):
    found = writes.compact(mem(spark, d), f"{shared_folder(spark).rstrip('/')}/compact-{uuid.uuid4().hex}", 2)
    return found.select("id", "type", "project", "ts_ms", "usage_count", F.md5("exact_text").alias("text"))


@query("clone_table", f"WITH {MEM} SELECT id, type, project FROM mem")
def clone_table(spark, d):
    return writes.clone(mem(spark, d), f"{shared_folder(spark).rstrip('/')}/clone-{uuid.uuid4().hex}").select("id", "type", "project")


@query("reset_table", f"WITH {MEM} SELECT id, type FROM mem WHERE false")
def reset_table(spark, d):
    return writes.reset(mem(spark, d)).select("id", "type")


@query(
    "refresh_embeddings",
    f"""
WITH {MEM}, t AS (SELECT id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i, CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END AS f FROM mem)
SELECT id, count(*) AS dims, round(sum(x * f * i), 4) AS weighted FROM t GROUP BY id""",
)
def refresh_embeddings(spark, d):
    m = mem(spark, d)
    new = m.where("n % 2 = 0").select("id", F.transform("embedding", lambda x: x * 2).alias("embedding"))
    parts = writes.refreshed(m, new).select("id", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("id").agg(F.count("*").alias("dims"), F.round(F.sum(F.col("x").cast("double") * (F.col("i") + 1)), 4).alias("weighted"))


@query("export_json", f"WITH {MEM} SELECT id, json_object('id', id, 'type', type, 'usage_count', usage_count, 'deprecated', deprecated) AS json FROM mem")
def export_json(spark, d):
    return writes.exported(mem(spark, d).select("id", "type", "usage_count", "deprecated", "embedding"))


@query("canonical_hash", f"WITH {MEM} SELECT id, sha256(concat_ws(chr(10), 'project=' || project, 'sourceRecordIds=a,b,' || id, 'type=' || type)) AS hash FROM mem")
def canonical_hash(spark, d):
    ids = F.when(F.col("n") % 2 == 0, F.array("id", F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"), "id"))
    a = F.to_json(F.struct("type", ids.alias("sourceRecordIds"), "project"))
    b = F.to_json(F.struct(ids.alias("sourceRecordIds"), "project", "type"))
    return mem(spark, d).select("id", writes.canonical_hash(F.when(F.col("n") % 3 == 0, a).otherwise(b)).alias("hash"))


@query("duplicate_warnings", f"""WITH {MEM}, t AS (SELECT a.id, b.id AS other, {COS.format(a='a.embedding', b='b.embedding')} AS s, row_number() OVER (PARTITION BY a.id ORDER BY {COS.format(a='a.embedding', b='b.embedding')} DESC, b.id) AS r
 FROM mem a JOIN mem b ON a.n % 10 = 1 AND b.type = 'warning' AND NOT b.deprecated AND a.id <> b.id AND (a.project = b.project OR b.scope = 'global')) SELECT id, other, round(s, 6) AS similarity FROM t WHERE r = 1 AND s >= 0.1""")
def duplicate_warnings(spark, d):
    from keepsake.operators import clusters

    m = mem(spark, d)
    return clusters.duplicate_warnings(m.where("n % 10 = 1"), m, LOOSE.using(warning_dedup_threshold=0.1)).select("id", "other", r6("similarity"))


# relations, reports and reviews


@query("relation_discovery", f"""WITH {EV}, g AS (SELECT DISTINCT session, k FROM ev WHERE ts_ms >= {NOW - 30 * 86400000} AND ts_ms <= {NOW} AND k % 7 <> 0), co AS (SELECT x.k AS a, y.k AS b, count(*) AS n FROM g x JOIN g y ON x.session = y.session AND x.k < y.k GROUP BY x.k, y.k HAVING count(*) >= 2)
SELECT a AS source, b AS target, round(least(1.0, n / 10), 6) AS weight, n AS reinforcement FROM co UNION ALL SELECT b, a, round(least(1.0, n / 10), 6), n FROM co""")
def relation_discovery(spark, d):
    e = events(spark, d)
    live = e.where("k % 7 <> 0").select("k").distinct()
    return graph.discovered(e, live, "session", "k", "ts_ms", NOW, 30, 2).select("source", "target", r6("weight"), "reinforcement")


@query("unrelated_pairs", f"WITH {EV}, p AS (SELECT DISTINCT least(k, (k * 7) % 100) AS a, greatest(k, (k * 7) % 100) AS b FROM ev WHERE k <> (k * 7) % 100), e AS (SELECT DISTINCT (k * 7) % 100 AS source, k AS target FROM ev WHERE k % 3 = 0) SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE least(source, target) = a AND greatest(source, target) = b)")
def unrelated_pairs(spark, d):
    k = events(spark, d).select("k", ((F.col("k") * 7) % 100).alias("o")).distinct()
    pairs = k.where("k <> o").select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b")).distinct()
    return graph.unrelated(pairs, k.where("k % 3 = 0").select(F.col("o").alias("source"), F.col("k").alias("target")))


@query("distinct_vocabulary", f"WITH {MEM} SELECT DISTINCT unnest(regexp_extract_all(lower(exact_text), '[\\p{{L}}]{{8,}}')) AS entity FROM mem WHERE NOT deprecated")
def distinct_vocabulary(spark, d):
    return mem(spark, d).where(~F.col("deprecated")).select(F.explode(tx.long_words(F.col("exact_text"))).alias("entity")).distinct()


@query("tier_counts", f"""WITH {MEM}, t AS (SELECT d.id, {COS.format(a='d.embedding', b='a.embedding')} AS s, row_number() OVER (PARTITION BY d.id ORDER BY {COS.format(a='d.embedding', b='a.embedding')} DESC, a.id) AS r FROM mem d JOIN mem a ON d.deprecated AND NOT a.deprecated AND (d.project = a.project OR a.scope = 'global' OR d.scope = 'global')),
 x AS (SELECT id, 2 * max(s) FILTER (WHERE r = 1) AS a, 2 * coalesce(max(s) FILTER (WHERE r = 2), 0) AS b FROM t WHERE r <= 2 GROUP BY id)
SELECT CASE WHEN a IS NULL OR a < 0.65 THEN 'none' WHEN a >= 0.85 THEN CASE WHEN a - b >= 0.05 THEN 'strong' ELSE 'multi' END ELSE 'weak' END AS tier, count(*) AS n FROM x GROUP BY tier""")
def tier_counts(spark, d):
    m = mem(spark, d)
    near = vectors.neighbours(m.where("deprecated"), m.where(~F.col("deprecated")), 5, -1.0, same=("project",), or_global=True)
    pick = lambda r: F.max(F.when(F.col("rank") == r, F.col("similarity"))) * 2
    top = near.groupBy("id").agg(pick(1).alias("a"), F.coalesce(pick(2), F.lit(0.0)).alias("b"))
    return top.select(scans.similarity_tier(F.col("a"), F.col("a") - F.col("b")).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@query("recent_sessions", f"WITH {EV} SELECT session, max(ts_ms) AS last_ms, count(*) AS n FROM ev GROUP BY session ORDER BY last_ms DESC, session LIMIT 20")
def recent_sessions(spark, d):
    rows = events(spark, d).groupBy("session").agg(F.max("ts_ms").alias("last_ms"), F.count("*").alias("n"))
    return rows.orderBy(F.desc("last_ms"), "session").limit(20)


@query("planned_needles", f"WITH {MEM} SELECT id, array_to_string(list_filter(['error', project, type], lambda x: lower(x) NOT IN (lower(type), 'retry')), ',') AS needles FROM mem WHERE type <> 'error' UNION ALL SELECT id, project FROM mem WHERE type = 'error'")
def planned_needles(spark, d):
    found = tx.canonical_needles(F.array(F.upper("type"), F.lit("retry")), F.array(F.lit("error"), F.col("project"), F.lit("Retry "), F.col("type"), F.col("project")))
    return mem(spark, d).select("id", F.array_join(found, ",").alias("needles"))


@query("text_helpers", "SELECT c_custkey, c_name AS step, '\"' || c_name || ' \\\"x\\\"\"' AS quoted, 'a-b-' || replace(c_name, '#', '-') AS key, 'see ' || c_name AS bare FROM customer")
def text_helpers(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select(
        "c_custkey", tx.step(F.concat(F.lit("  3) "), name)).alias("step"), tx.yaml_quoted(F.concat(name, F.lit(' "x"'))).alias("quoted"),
        tx.path_key(F.concat(F.lit("a/b:"), name)).alias("key"), tx.without_noise(F.concat(F.lit("see <b>"), name, F.lit("</b> https://x.y/z ```\ncode\n```"))).alias("bare"),
    )


@query("arm_report", f"""WITH {MEM}, {ARMS}, x AS (SELECT arms.*, CASE n % 4 WHEN 0 THEN 'relates_to' WHEN 1 THEN 'shares_entity' ELSE 'search' END AS kind, CASE n % 5 WHEN 0 THEN 'helpful' WHEN 1 THEN 'partial' WHEN 2 THEN 'unhelpful' END AS verdict, n % 6 = 0 AND n % 5 < 3 AS gold FROM arms),
 l AS (SELECT a.arm, count(*) AS displaced FROM (SELECT DISTINCT arm FROM arms) a JOIN x b ON b.arm = 'base' AND b.verdict = 'helpful' WHERE NOT EXISTS (SELECT 1 FROM arms o WHERE o.arm = a.arm AND o.prompt = b.prompt AND o.id = b.id) GROUP BY a.arm)
SELECT x.arm, count(DISTINCT prompt) AS prompts, count(*) AS injected, count(verdict) AS judged, round(count(*) FILTER (WHERE verdict = 'helpful') / count(verdict), 6) AS strict, round(count(*) FILTER (WHERE verdict IN ('helpful', 'partial')) / count(verdict), 6) AS lenient,
 count(*) FILTER (WHERE kind = 'relates_to') AS related, count(*) FILTER (WHERE kind = 'shares_entity') AS by_entity, round(count(DISTINCT CASE WHEN gold THEN prompt END) / count(DISTINCT prompt), 6) AS gold_rate, coalesce(max(displaced), 0) AS displaced FROM x LEFT JOIN l ON l.arm = x.arm GROUP BY x.arm""")
def arm_report(spark, d):
    kind = F.when(F.col("n") % 4 == 0, "relates_to").when(F.col("n") % 4 == 1, "shares_entity").otherwise("search")
    rows = _arms(spark, d).withColumn("kind", kind)
    verdict = F.when(F.col("n") % 5 == 0, "helpful").when(F.col("n") % 5 == 1, "partial").when(F.col("n") % 5 == 2, "unhelpful")
    verdicts = rows.where("n % 5 < 3").select("prompt", "id", verdict.alias("verdict"), (F.col("n") % 6 == 0).alias("gold")).distinct()
    found = evaluate.arm_report(rows.drop("n"), verdicts, "base")
    return found.withColumns({c: F.round(c, 6) for c in ("strict", "lenient", "gold_rate")})


@query("eval_prompts", "WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn AS BIGINT) AS ts_ms, text AS prompt FROM conversations WHERE role = 'user') SELECT substr(sha256(session || ':' || ts_ms || ':' || prompt), 1, 16) AS key, session, ts_ms FROM p WHERE length(trim(prompt, ' ')) >= 15 AND NOT regexp_matches(trim(prompt, ' '), '^/[A-Za-z0-9_:-]+$')")
def eval_prompts(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("long").alias("ts_ms"), F.col("text").alias("prompt"))
    return evaluate.prompts(rows).select("key", "session", "ts_ms")


@query("run_alerts", f"""WITH {EV}, r AS (SELECT event_type AS source, ts_ms + {NOW} - (SELECT max(ts_ms) FROM ev) AS ts_ms, k, CASE k % 5 WHEN 0 THEN 'api_error' WHEN 1 THEN 'no_auth' WHEN 2 THEN 'internal_error' END AS kind, CASE WHEN k % 10 = 0 THEN 429 ELSE 401 END AS status FROM ev),
 a AS (SELECT *, unnest(list_filter([CASE WHEN kind = 'api_error' AND status = 429 THEN 'rate_limited' END, CASE WHEN kind = 'no_auth' OR (kind = 'api_error' AND status = 401) THEN 'auth' END, CASE WHEN kind = 'internal_error' THEN 'internal_error' END,
  CASE WHEN NOT (kind IS NOT NULL AND k % 3 = 0) AND k % 4 > 0 THEN 'record_store_failures' END], lambda x: x IS NOT NULL)) AS alert FROM r WHERE ts_ms >= {NOW - 86400000} AND ts_ms <= {NOW})
SELECT source, alert, count(*) AS n, CAST(max(ts_ms) AS BIGINT) AS last_ms FROM a GROUP BY source, alert""")
def run_alerts(spark, d):
    e = events(spark, d)
    last = e.agg(F.max("ts_ms")).first()[0] or 0
    k = F.col("k")
    kind = F.when(k % 5 == 0, "api_error").when(k % 5 == 1, "no_auth").when(k % 5 == 2, "internal_error")
    rows = e.select(F.col("event_type").alias("source"), (F.col("ts_ms") + NOW - last).alias("ts_ms"), kind.alias("kind"), F.lit(None).cast("string").alias("code"), F.when(k % 10 == 0, 429).otherwise(401).alias("status"), (k % 3).alias("records"), (k % 4).alias("failed_records"))
    return activity.run_alerts(rows, NOW)


@query("run_detail", f"WITH {MEM} SELECT project AS run_id, CAST(row_number() OVER (PARTITION BY project ORDER BY id) - 1 AS INT) AS place, id, CASE WHEN n % 4 <> 0 THEN type END AS type, 'b' || project AS review FROM mem")
def run_detail(spark, d):
    m = mem(spark, d)
    found = m.groupBy(F.col("project").alias("run_id")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    reviews = found.select("run_id", F.explode(F.array(F.struct(F.lit(1).alias("ts_ms"), F.lit("a").alias("p")), F.struct(F.lit(2).alias("ts_ms"), F.lit("b").alias("p")))).alias("x"))
    return runs.run_detail(found, m.where("n % 4 <> 0"), reviews.select("run_id", "x.ts_ms", F.concat("x.p", "run_id").alias("review")))


@query("record_outcomes", f"WITH {MEM} SELECT project AS run_id, id, CASE WHEN n % 2 = 0 THEN 'inserted' ELSE 'updated' END AS outcome, id AS stored_id, CASE WHEN n % 3 <> 0 THEN type END AS type, n % 3 <> 0 AS present FROM mem")
def record_outcomes(spark, d):
    m = mem(spark, d)
    found = m.select(F.col("project").alias("run_id"), "id", F.when(F.col("n") % 2 == 0, "inserted").otherwise("updated").alias("outcome"), F.col("id").alias("stored_id"))
    return runs.outcomes(found, m.where("n % 3 <> 0"))


@query("helpful_ids", f"WITH {MEM} SELECT project AS key, id FROM mem WHERE n % 2 = 0 AND n % 3 = 0")
def helpful_ids(spark, d):
    m = mem(spark, d).select(F.col("project").alias("key"), "id", "n")
    named = m.where("n % 2 = 0").select("key", "id")
    return runs.helpful(named.unionByName(named), m.where("n % 3 = 0"))


@query("review_texts", f"WITH {MEM}, p AS (SELECT id AS key, list_filter([trim(project, ' '), type, project], lambda x: x <> '') AS parts FROM mem) SELECT DISTINCT key, unnest(list_append(parts, array_to_string(parts, chr(10)))) AS text FROM p")
def review_texts(spark, d):
    rows = mem(spark, d).select(F.col("id").alias("key"), F.concat(F.col("project"), F.lit(" ")).alias("prompt"), F.array(F.col("type"), F.lit("  ")).alias("errors"), F.array("project").alias("commands"))
    return runs.review_texts(rows)


@query("first_verdicts", f"WITH {MEM} SELECT project AS key, id, CASE WHEN n % 3 = 0 THEN 'partial' WHEN n % 3 = 1 THEN 'helpful' ELSE 'unknown' END AS verdict FROM mem")
def first_verdicts(spark, d):
    m = mem(spark, d).select(F.col("project").alias("key"), "id", "n")
    given = lambda where, pos, v: m.where(where).select("key", "id", F.lit(pos).alias("pos"), F.lit(v).alias("verdict"))
    verdicts = given("n % 3 = 0", 1, "partial").unionByName(given("n % 3 < 2", 2, "helpful")).unionByName(given("n % 3 = 2", 1, "nonsense"))
    return runs.first_verdicts(m, verdicts.unionByName(verdicts.withColumn("id", F.lit("foreign"))))
