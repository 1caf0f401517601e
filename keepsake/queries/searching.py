"""Vector, keyword, hybrid and scoped search, and what follows it."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake import filters, records
from keepsake.operators import packing, search, vectors
from keepsake.queries.base import COS, MEM, events, mem, query, r6, vector_of
from keepsake.settings import Settings

Q = ("m000000", "m000001", "m000002")
LOOSE = Settings(min_semantic_similarity=0.15, min_score=0.2, min_semantic_only_score=0.2, semantic_anchor_threshold=0.35, max_records=8)
SIM = COS.format(a="m.embedding", b="q.v")
QV = "q AS (SELECT embedding AS v FROM mem WHERE id = 'm000000')"
RATIO = "CASE WHEN usage_count <= 0 THEN 0.0 ELSE least(usage_count / greatest(retrieval_count, 1), 1.0) END"


@query("topk_cosine", f"WITH {MEM}, {QV} SELECT id, round({SIM}, 6) AS similarity FROM mem m, q WHERE NOT deprecated AND project <> '/p/9' ORDER BY {SIM} DESC, id LIMIT 10")
def topk_cosine(spark, d):
    m = mem(spark, d)
    return vectors.top_k(m, vector_of(m, Q[0]), 10, where=~F.col("deprecated") & (F.col("project") != "/p/9")).select("id", r6("similarity"))


@query("limit_before_threshold", f"WITH {MEM}, {QV}, t AS (SELECT id, {SIM} AS s FROM mem m, q ORDER BY s DESC, id LIMIT 10) SELECT id, round(s, 6) AS similarity FROM t WHERE s >= 0.25")
def limit_before_threshold(spark, d):
    m = mem(spark, d)
    return vectors.top_k(m, vector_of(m, Q[0]), 10, 0.25).select("id", r6("similarity"))


@query("similar_to_record", f"WITH {MEM}, q AS (SELECT embedding AS v, type AS qt, project AS qp FROM mem WHERE id = 'm000001') SELECT id, round({SIM}, 6) AS similarity FROM mem m, q WHERE type = qt AND project = qp AND id <> 'm000001' AND NOT deprecated ORDER BY {SIM} DESC, id LIMIT 5")
def similar_to_record(spark, d):
    m = mem(spark, d)
    row = m.where("id = 'm000001'").select("type", "project").first()
    where = filters.scope_filter(row["project"], kind=row["type"], but="m000001", active=True)
    return vectors.top_k(m, vector_of(m, "m000001"), 5, where=where).select("id", r6("similarity"))


@query("multi_query_pool", f"WITH {MEM}, s AS (SELECT m.id, max({COS.format(a='m.embedding', b='q.embedding')}) AS s FROM mem m JOIN mem q ON q.id IN {Q} WHERE m.id NOT IN {Q} AND m.ts_ms <= 1705363200000 GROUP BY m.id) SELECT id, round(greatest(s, 0), 6) AS similarity FROM s ORDER BY s DESC, id LIMIT 15")
def multi_query_pool(spark, d):
    m = mem(spark, d)
    rows = m.where(~F.col("id").isin(*Q) & (F.col("ts_ms") <= 1705363200000))
    return rows.withColumn("similarity", vectors.max_cosine_to([vector_of(m, q) for q in Q])).orderBy(F.desc("similarity"), "id").limit(15).select("id", r6("similarity"))


NEEDLES = ["tion", "ment", "schkeit"]
KW = f"""kw AS (SELECT id, needle, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, needle) AS one FROM (
 SELECT id, needle, row_number() OVER (PARTITION BY needle ORDER BY id) AS place FROM mem JOIN (VALUES (0, 'tion'), (1, 'ment'), (2, 'schkeit')) v(needle, word) ON contains(lower(exact_text), word) WHERE NOT deprecated)
 WHERE place <= {{per}}) WHERE one = 1 ORDER BY place, needle, id LIMIT {{n}})"""


@query("keyword_interleave", f"WITH {MEM}, {KW.format(per=7, n=20)} SELECT id, CAST(needle AS INT) AS needle, CAST(place AS INT) AS place FROM kw")
def keyword_interleave(spark, d):
    return search.keyword_rows(mem(spark, d).where(~F.col("deprecated")), NEEDLES, 20)


@query("hybrid_search", f"""WITH {MEM}, {QV}, {KW.format(per=4, n=10)}, vec AS (SELECT id, s FROM (SELECT id, {SIM} AS s FROM mem m, q WHERE NOT deprecated ORDER BY s DESC, id LIMIT 10) WHERE s >= 0.15),
 b AS (SELECT coalesce(vec.id, kw.id) AS id, coalesce(s, 0) AS s, kw.id IS NOT NULL AS keyword_match FROM vec FULL JOIN kw ON vec.id = kw.id),
 f AS (SELECT b.*, (CASE WHEN keyword_match THEN 0.3 ELSE 0 END) + s * 0.7 + ({RATIO}) * 0.2 AS score FROM b JOIN mem USING (id))
SELECT id, round(s, 6) AS similarity, keyword_match, round(score, 6) AS score FROM f WHERE score >= 0.2 ORDER BY f.score DESC, s DESC, id LIMIT 10""")
def hybrid_search(spark, d):
    m = mem(spark, d)
    found = search.hybrid(m, vector_of(m, Q[0]), NEEDLES, LOOSE, where=~F.col("deprecated"))
    return found.select("id", r6("similarity"), "keyword_match", r6("score"))


@query("near_misses", f"""WITH {MEM}, {QV}, t AS (SELECT id, {SIM} AS s, ({RATIO}) AS u FROM mem m, q WHERE NOT deprecated ORDER BY s DESC, id LIMIT 30), x AS (SELECT *, s * 0.7 + u * 0.2 AS score FROM t)
SELECT id, 'similarity_below_threshold' AS reason, 0.3 AS threshold, round(s, 6) AS actual, round(0.3 - s, 6) AS gap FROM x WHERE s < 0.3
UNION ALL SELECT id, 'score_below_threshold', 0.3, round(score, 6), round(0.3 - score, 6) FROM x WHERE s >= 0.3 AND score < 0.3""".replace("0.3 AS threshold", "CAST(0.3 AS DOUBLE) AS threshold").replace("'score_below_threshold', 0.3,", "'score_below_threshold', CAST(0.3 AS DOUBLE),"))
def near_misses(spark, d):
    m = mem(spark, d)
    s = LOOSE.using(min_semantic_similarity=0.3, min_score=0.3)
    return search.near_misses(m.where(~F.col("deprecated")), vector_of(m, Q[0]), s).select("id", "reason", "threshold", r6("actual"), r6("gap"))


TWO = f"""{QV}, {KW.format(per=8, n=24).replace("WHERE NOT deprecated", "WHERE NOT deprecated AND (project = '/p/3' OR scope = 'global')")},
 vec AS (SELECT id FROM (SELECT id, {SIM} AS s FROM mem m, q WHERE NOT deprecated ORDER BY s DESC, id LIMIT 24) WHERE s >= 0.2),
 u AS (SELECT id, max(w) AS w FROM (SELECT id, true AS w FROM kw UNION ALL SELECT id, false FROM vec) GROUP BY id),
 p AS (SELECT m.id, CASE WHEN u.w AND vec.id IS NULL THEN greatest(0, {SIM}) ELSE {SIM} END AS s, u.w AS keyword_match, ({RATIO}) * 0.2 AS usage, CASE WHEN project = '/p/3' THEN 0.05 ELSE 0.0 END AS project_boost, project, scope
  FROM u JOIN mem m USING (id) LEFT JOIN vec USING (id), q),
 two AS (SELECT id, s AS similarity, keyword_match, s * 0.7 AS semantic, CASE WHEN keyword_match THEN least(s / 0.15, 1) * 0.08 ELSE 0 END AS keyword_bonus, usage, project_boost, project, scope FROM p),
 found AS (SELECT *, semantic + keyword_bonus + usage + project_boost AS score FROM two WHERE semantic + keyword_bonus + usage + project_boost >= 0.2 ORDER BY semantic + keyword_bonus + usage + project_boost DESC, similarity DESC, id LIMIT 24)"""


@query("two_scope_search", f"WITH {MEM}, {TWO} SELECT id, round(similarity, 6) AS similarity, keyword_match, round(semantic, 6) AS semantic, round(keyword_bonus, 6) AS keyword_bonus, CAST(round(usage, 6) AS DOUBLE) AS usage, CAST(project_boost AS DOUBLE) AS project_boost, round(score, 6) AS score FROM found")
def two_scope_search(spark, d):
    found = _two_scope(spark, d)
    return found.select("id", r6("similarity"), "keyword_match", r6("semantic"), r6("keyword_bonus"), r6("usage"), "project_boost", r6("score"))


def _two_scope(spark, d):
    m = mem(spark, d)
    return search.two_scope(m, vector_of(m, Q[0]), NEEDLES, "/p/3", LOOSE)


@query("anchor_gate", f"WITH {MEM}, {TWO} SELECT id, round(score, 6) AS score FROM found WHERE (SELECT max(similarity) FROM found) >= 2 OR (keyword_match AND score >= 0.2 AND (project = '/p/3' OR scope = 'global'))")
def anchor_gate(spark, d):
    m = mem(spark, d)
    return search.anchored(_two_scope(spark, d), m, "/p/3", LOOSE.using(semantic_anchor_threshold=2.0)).select("id", r6("score"))


@query("suppress_soft", f"WITH {MEM}, {TWO} SELECT id, round(CASE WHEN id IN (SELECT id FROM mem WHERE n % 3 = 0) THEN score * 0.5 ELSE score END, 6) AS score, round(score, 6) AS original_score FROM found")
def suppress_soft(spark, d):
    return search.suppressed(_two_scope(spark, d), mem(spark, d).where("n % 3 = 0"), LOOSE).select("id", r6("score"), r6("original_score"))


@query("suppress_hard", f"WITH {MEM}, {TWO} SELECT id, round(score, 6) AS score FROM found WHERE id NOT IN (SELECT id FROM mem WHERE n % 3 = 0)")
def suppress_hard(spark, d):
    return search.suppressed(_two_scope(spark, d), mem(spark, d).where("n % 3 = 0"), LOOSE.using(suppression_mode="hard")).select("id", r6("score"))


@query("topic_shift", f"WITH {MEM}, p AS (SELECT project AS session, n AS seq, embedding AS e, lag(embedding) OVER (PARTITION BY project ORDER BY n) AS b FROM mem), s AS (SELECT session, seq, {COS.format(a='e', b='b')} AS s FROM p WHERE b IS NOT NULL) SELECT session, seq, round(s, 6) AS similarity, s < 0.1 AS changed FROM s")
def topic_shift(spark, d):
    prompts = mem(spark, d).select(F.col("project").alias("session"), F.col("n").alias("seq"), "embedding")
    return search.topic_shift(prompts, LOOSE.using(topic_change_threshold=0.1)).select("session", "seq", r6("similarity"), "changed")


@query("usage_ratio", f"WITH {MEM} SELECT id, round({RATIO}, 6) AS ratio FROM mem".replace("SELECT id, round(", "SELECT id, round(CAST(").replace(", 6) AS ratio", " AS DOUBLE), 6) AS ratio"))
def usage_ratio(spark, d):
    return mem(spark, d).select("id", F.round(records.usage_ratio(F.col("usage_count"), F.col("retrieval_count")), 6).alias("ratio"))


MMR = f"""WITH RECURSIVE {MEM}, sc AS (SELECT q.id AS query_id, m.id, {SIM} AS score, m.embedding AS e FROM mem m, (SELECT id, embedding AS v FROM mem WHERE id IN {Q}) q),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM sc) WHERE place <= 24),
near AS (SELECT a.query_id, a.id, b.id AS other, {COS.format(a='a.e', b='b.e')} AS s FROM pool a JOIN pool b USING (query_id)),
picked AS (SELECT query_id, id, [id] AS chosen, 1 AS rank FROM pool WHERE place = 1 UNION ALL
 SELECT query_id, id, list_append(chosen, id), rank + 1 FROM (SELECT p.query_id, c.id, p.chosen, p.rank, row_number() OVER (PARTITION BY p.query_id ORDER BY 0.7::DOUBLE * c.score - (1 - 0.7::DOUBLE) * max(n.s) DESC, c.score DESC, c.id) AS r
  FROM picked p JOIN pool c ON c.query_id = p.query_id AND NOT list_contains(p.chosen, c.id) JOIN near n ON n.query_id = c.query_id AND n.id = c.id AND list_contains(p.chosen, n.other)
  WHERE p.rank < 8 GROUP BY p.query_id, c.id, c.score, p.chosen, p.rank) WHERE r = 1)
SELECT query_id, id, CAST(rank AS INT) AS rank FROM picked"""


@query("mmr", MMR)
def mmr(spark, d):
    m = mem(spark, d)
    pools = [vectors.top_k(m, vector_of(m, q), 24).select(F.lit(q).alias("query_id"), "id", F.col("similarity").alias("score"), "embedding") for q in Q]
    return packing.maximal_marginal_relevance(pools[0].unionByName(pools[1]).unionByName(pools[2]), 8, 0.7)


LEFT_OUT = """,
best AS (SELECT * FROM pool WHERE place <= 8 AND NOT EXISTS (SELECT 1 FROM picked k WHERE k.query_id = pool.query_id AND k.id = pool.id)),
to_chosen AS (SELECT b.query_id, b.id, b.score, n.other, n.s, row_number() OVER (PARTITION BY b.query_id, b.id ORDER BY n.s DESC, k.rank) AS r
    FROM best b JOIN near n ON n.query_id = b.query_id AND n.id = b.id JOIN picked k ON k.query_id = b.query_id AND k.id = n.other),
ends AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS r FROM picked) WHERE r = 1),
limits AS (SELECT e.query_id, 0.7 * max(p.score) - 0.3 * max(n.s) AS threshold FROM ends e JOIN pool p ON p.query_id = e.query_id AND p.id = e.id
    JOIN near n ON n.query_id = e.query_id AND n.id = e.id AND n.other <> e.id JOIN picked k ON k.query_id = e.query_id AND k.id = n.other GROUP BY e.query_id)
SELECT t.query_id, t.id, round(threshold, 6) AS threshold, round(0.7 * score - 0.3 * s, 6) AS actual, other AS similar_to, round(s, 6) AS similarity FROM to_chosen t JOIN limits USING (query_id) WHERE r = 1"""


@query("mmr_exclusions", MMR.rsplit("\nSELECT query_id, id, CAST(rank", 1)[0] + LEFT_OUT)
def mmr_exclusions(spark, d):
    m = mem(spark, d)
    pools = [vectors.top_k(m, vector_of(m, q), 24).select(F.lit(q).alias("query_id"), "id", F.col("similarity").alias("score"), "similarity", "embedding") for q in Q]
    pool = pools[0].unionByName(pools[1]).unionByName(pools[2])
    found = packing.diversity_exclusions(pool, packing.maximal_marginal_relevance(pool, 8, 0.7), 8, 0.7)
    return found.select("query_id", "id", r6("threshold"), r6("actual"), "similar_to", r6("similarity"))


@query("pack_tokens", f"""WITH {MEM}, t AS (SELECT id, project, CAST(ceil(length(exact_text) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY project ORDER BY usage_count DESC, last_used DESC, id) AS place,
 sum(CAST(ceil(length(exact_text) / 4) AS BIGINT)) OVER (PARTITION BY project ORDER BY usage_count DESC, last_used DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM mem WHERE NOT deprecated AND type <> 'warning')
SELECT id, project, tokens, CAST(place AS INT) AS place FROM t WHERE running <= 4000 AND place <= 8""")
def pack_tokens(spark, d):
    rows = mem(spark, d).where("not deprecated and type <> 'warning'")
    found = packing.stop_at_overflow(rows, records.tokens(F.col("exact_text")), 4000, [F.desc("usage_count"), F.desc("last_used"), F.col("id")], ["project"], 8)
    return found.select("id", "project", "tokens", "place")


@query("pack_warnings", f"""WITH {MEM}, t AS (SELECT id, project, CAST(ceil(length(exact_text) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY project ORDER BY ts_ms DESC, id) AS place,
 sum(CAST(ceil(length(exact_text) / 4) AS BIGINT)) OVER (PARTITION BY project ORDER BY ts_ms DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM mem WHERE NOT deprecated AND type = 'warning')
SELECT id, project, tokens FROM t WHERE running <= 1200 - 20 AND place <= 5""")
def pack_warnings(spark, d):
    rows = mem(spark, d).where("not deprecated and type = 'warning'")
    return packing.stop_at_overflow(rows, records.tokens(F.col("exact_text")), 1200 - 20, [F.desc("ts_ms"), F.col("id")], ["project"], 5).select("id", "project", "tokens")


@query("nearest_rank_percentile", "WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS percentile FROM t WHERE r = least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1")
def nearest_rank_percentile(spark, d):
    from keepsake.operators import activity

    return activity.nearest_rank(events(spark, d), "value", 95, ["event_type"])


@query("needle_distinct", f"WITH {MEM}, w AS (SELECT lower(string_split(exact_text, ' ')[1]) AS low, string_split(exact_text, ' ')[1] AS word, id FROM mem) SELECT word, id FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY id) AS r FROM w) WHERE r = 1")
def needle_distinct(spark, d):
    from keepsake.operators import history

    words = mem(spark, d).select(F.split("exact_text", " ").getItem(0).alias("word"), "id")
    return history.distinct_ignoring_case(words, "word", ["id"])


RANKED = "CAST(row_number() OVER (ORDER BY usage_count DESC, last_used DESC, ts_ms DESC, id) AS INT) AS place"


def _usage_rank(rows):
    order = [F.desc("usage_count"), F.desc("last_used"), F.desc("ts_ms"), F.col("id")]
    found = packing.ranked(rows.select("id", "usage_count", "last_used", "ts_ms"), order, ["id"])
    return found.select("id", F.col("place").cast("int").alias("place"))


@query("usage_rank", f"WITH {MEM} SELECT id, {RANKED} FROM mem WHERE project = '/p/2'")
def usage_rank(spark, d):
    return _usage_rank(mem(spark, d).where("project = '/p/2'"))


@query("usage_rank_all", f"WITH {MEM} SELECT id, {RANKED} FROM mem")
def usage_rank_all(spark, d):
    return _usage_rank(mem(spark, d))
