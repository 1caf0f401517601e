"""Many prompts at once: needles from tables, entity needles, and retrieval under several settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import text as tx
from keepsake.operators import needles
from keepsake.plans import sweep
from keepsake.queries.base import COS, EV, MEM, mem, query, r6
from keepsake.queries.maintaining import CO, _edges
from keepsake.queries.searching import LOOSE, RATIO
from keepsake.runtime import table, written

WORDS_OF_QUERIES = r"""
words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]{7,}')) AS needle FROM documents WHERE doc_id % 50 = 0),
needles AS (SELECT needle FROM words UNION SELECT substr(n_name, 1, 2) FROM nation UNION SELECT substr(n_name, 1, 1) FROM nation)"""


def _many_needles(spark, d):
    """The longer words of every 50th document, and the first one and two letters of the nations."""
    words = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.explode(tx.long_words(F.col("text"), 7)).alias("needle"))
    names = table(spark, d, "nation")
    return words.unionByName(names.select(F.substring("n_name", 1, 2).alias("needle"))).unionByName(names.select(F.substring("n_name", 1, 1).alias("needle")))


@query(
    "needle_matches",
    f"""
WITH {WORDS_OF_QUERIES},
held AS (SELECT needle, doc_id FROM needles JOIN documents ON contains(lower(text), lower(needle)))
SELECT needle, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, CAST(sum(doc_id) AS BIGINT) AS total FROM held GROUP BY needle""",
)
def needle_matches(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = needles.matches(texts, _many_needles(spark, d), "text")
    return found.groupBy("needle").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.sum("id").alias("total"))


VOCABULARY = r"vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(exact_text), '[\p{L}]{10,}')) AS entity FROM mem WHERE NOT deprecated)"
ENTITY_NEEDLES = r"""
tokens AS (SELECT prompt, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM
    (SELECT prompt, regexp_extract_all(nfc_normalize(text), '[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}._:/@+-]*[\p{L}\p{N}\p{M}])?') AS ts FROM prompts)),
entities AS (SELECT prompt, token, pos, lower(token) AS entity FROM tokens WHERE length(token) BETWEEN 3 AND 120 AND regexp_matches(token, '\p{L}')
    AND lower(token) NOT IN ('git', 'npm', 'pnpm', 'node', 'npx', 'bash', 'zsh', 'shell', 'linux', 'file', 'server', 'error', 'command', 'config', 'json', 'http', 'https')),
shaped AS (SELECT prompt, entity, pos, CASE WHEN regexp_matches(token, '[/:\\]') OR regexp_matches(token, '\.[A-Za-z0-9]') THEN 0
    WHEN regexp_matches(token, '^\p{Lu}') THEN 1 WHEN regexp_matches(token, '\p{L}[-_]\p{L}') THEN 2 WHEN regexp_matches(token, '[0-9]') THEN 3 END AS shape FROM entities),
taken AS (SELECT prompt, s.entity, pos, coalesce(shape, 4) AS tier FROM shaped s LEFT JOIN vocabulary v ON v.entity = s.entity WHERE shape IS NOT NULL OR v.entity IS NOT NULL),
one AS (SELECT *, row_number() OVER (PARTITION BY prompt, entity ORDER BY pos) AS r FROM taken),
placed AS (SELECT prompt, entity AS needle, tier, row_number() OVER (PARTITION BY prompt ORDER BY tier, pos) AS place FROM one WHERE r = 1)"""


def _vocabulary(m):
    return m.where("not deprecated").select(F.explode(tx.long_words(F.col("exact_text"), 10)).alias("entity"))


@query(
    "entity_needles",
    f"""
WITH {MEM}, {VOCABULARY}, prompts AS (SELECT doc_id AS prompt, coalesce(text, '') AS text FROM documents), {ENTITY_NEEDLES}
SELECT prompt, needle, CAST(tier AS INT) AS tier, CAST(place AS INT) AS place FROM placed WHERE place <= 12""",
)
def entity_needles(spark, d):
    prompts = table(spark, d, "documents").select(F.col("doc_id").alias("prompt"), "text")
    return needles.entity_needles(prompts, _vocabulary(mem(spark, d)), 12)


# snapshot settings: a base, a floor for related records, entity edges, and entity needles
FLOORED = LOOSE.using(min_expanded_score=0.1)
SWEEP = {
    "A": LOOSE.using(min_expanded_score=0.0), "AF": FLOORED, "B1": FLOORED.using(enable_entity_edges=True),
    "B2": FLOORED.using(enable_entity_edges=True, enable_entity_keywords=True),
}
SWEEP_SQL = f"""
WITH RECURSIVE {MEM}, {EV}, {CO}, {VOCABULARY},
ed AS (SELECT 'm' || lpad(CAST(a AS VARCHAR), 6, '0') AS source, 'm' || lpad(CAST(b AS VARCHAR), 6, '0') AS target,
    CASE WHEN (a + b) % 5 = 0 THEN 'shares_entity' ELSE 'relates_to' END AS kind, least(1.0, n / 10) AS weight FROM co),
arms AS (SELECT * FROM (VALUES ('A', false, false, 0.0), ('AF', false, false, 0.1), ('B1', true, false, 0.1), ('B2', true, true, 0.1)) t(arm, by_entity, words_too, least_score)),
prompts AS (SELECT id AS prompt, project AS home, embedding AS v, exact_text AS text FROM mem WHERE n % 50 = 0),
{ENTITY_NEEDLES},
long_one AS (SELECT prompt, unnest(ws) AS needle, unnest(range(len(ws))) AS pos FROM (SELECT prompt, regexp_extract_all(lower(text), '[\\p{{L}}]{{9,}}') AS ws FROM prompts)),
own AS (SELECT prompt, needle FROM (SELECT prompt, needle, row_number() OVER (PARTITION BY prompt ORDER BY min(pos)) AS r FROM long_one GROUP BY prompt, needle) WHERE r <= 3),
wanted AS (SELECT prompt, needle, false AS entity FROM own UNION ALL
    SELECT prompt, needle, true FROM placed WHERE place <= 3 AND NOT EXISTS (SELECT 1 FROM own WHERE own.prompt = placed.prompt AND own.needle = placed.needle)),
facts AS (SELECT id, project, scope, embedding, exact_text, {RATIO} AS ratio FROM mem WHERE NOT deprecated),
sims AS (SELECT prompt, home, f.id, ratio, {COS.format(a='f.embedding', b='v')} AS s FROM prompts JOIN facts f ON f.id <> prompt),
alike AS (SELECT arm, prompt, id, s FROM arms, (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY s DESC, id) AS r FROM sims) WHERE r <= 24 AND s >= 0.15 AND s + ratio * 0.2 >= 0.2),
hits AS (SELECT arm, w.prompt, needle, f.id, ratio FROM wanted w JOIN arms ON NOT entity OR words_too JOIN prompts p ON p.prompt = w.prompt
    JOIN facts f ON contains(lower(exact_text), lower(needle)) AND (f.project = home OR f.scope = 'global') AND f.id <> p.prompt),
near_hits AS (SELECT DISTINCT arm, prompt, id, ratio FROM (SELECT *, row_number() OVER (PARTITION BY arm, prompt, needle ORDER BY id) AS r FROM hits) WHERE r <= 24),
used_hits AS (SELECT arm, prompt, id FROM (SELECT *, row_number() OVER (PARTITION BY arm, prompt ORDER BY ratio DESC, id) AS r FROM near_hits) WHERE r <= 24),
both_ways AS (SELECT arm, prompt, id, max(s) AS s, bool_or(word) AS word FROM
    (SELECT arm, prompt, id, s, false AS word FROM alike UNION ALL SELECT arm, prompt, id, 0, true FROM used_hits) GROUP BY arm, prompt, id),
scaled AS (SELECT b.arm, b.prompt, b.id, word, sims.s AS near, CASE WHEN b.s = 0 THEN greatest(0, sims.s) ELSE b.s END AS similarity, f.project, f.scope, home,
    f.ratio * 0.2 + CASE WHEN f.project = home THEN 0.05 ELSE 0 END AS extra
    FROM both_ways b JOIN sims ON sims.prompt = b.prompt AND sims.id = b.id JOIN facts f ON f.id = b.id),
rated AS (SELECT *, similarity * 0.7 + CASE WHEN word THEN least(similarity / 0.15, 1) * 0.08 ELSE 0 END + extra AS plain,
    CASE WHEN word THEN near * 0.7 + least(near / 0.15, 1) * 0.08 + extra END AS qualification FROM scaled),
scored AS (SELECT *, greatest(plain, coalesce(qualification, plain)) AS score FROM rated),
best AS (SELECT *, max(greatest(near, 0)) OVER (PARTITION BY arm, prompt) AS anchor FROM
    (SELECT *, row_number() OVER (PARTITION BY arm, prompt ORDER BY score DESC, similarity DESC, id) AS r FROM scored WHERE score >= 0.2) WHERE r <= 24),
found AS (SELECT arm, prompt, id, similarity, score FROM best WHERE anchor >= 0.35 OR (word AND qualification >= 0.2 AND (project = home OR scope = 'global'))),
steps AS (SELECT f.arm, f.prompt, target AS id, f.score * weight * 0.6 AS score, greatest(0, least(1, f.similarity * weight * 0.6)) AS similarity, f.id AS parent
    FROM found f JOIN arms USING (arm) JOIN ed ON ed.source = f.id AND (kind <> 'shares_entity' OR by_entity) JOIN facts t ON t.id = target
    WHERE NOT EXISTS (SELECT 1 FROM found k WHERE k.arm = f.arm AND k.prompt = f.prompt AND k.id = target)),
reached AS (SELECT *, row_number() OVER (PARTITION BY arm, prompt ORDER BY score DESC, id) AS o FROM
    (SELECT *, row_number() OVER (PARTITION BY arm, prompt, id ORDER BY score DESC, parent) AS r FROM steps) WHERE r = 1),
every AS (SELECT arm, prompt, id, similarity, score, CAST(NULL AS VARCHAR) AS parent, 0 AS hop FROM found UNION ALL
    SELECT arm, prompt, id, similarity, score, parent, 1 FROM reached JOIN arms USING (arm) WHERE o <= 5 AND (least_score <= 0 OR score >= least_score)),
pool AS (SELECT e.*, embedding AS e, CAST(ceil(length(exact_text) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY arm, prompt ORDER BY score DESC, id) AS place FROM every e JOIN facts USING (id)),
pairs AS (SELECT a.arm, a.prompt, a.id, b.id AS other, {COS.format(a='a.e', b='b.e')} AS s FROM pool a JOIN pool b ON a.arm = b.arm AND a.prompt = b.prompt),
picked AS (SELECT arm, prompt, id, [id] AS chosen, 1 AS rank FROM pool WHERE place = 1 UNION ALL
    SELECT arm, prompt, id, list_append(chosen, id), rank + 1 FROM (SELECT p.arm, p.prompt, c.id, p.chosen, p.rank,
        row_number() OVER (PARTITION BY p.arm, p.prompt ORDER BY 0.7::DOUBLE * c.score - (1 - 0.7::DOUBLE) * max(n.s) DESC, c.score DESC, c.id) AS r
        FROM picked p JOIN pool c ON c.arm = p.arm AND c.prompt = p.prompt AND NOT list_contains(p.chosen, c.id)
        JOIN pairs n ON n.arm = c.arm AND n.prompt = c.prompt AND n.id = c.id AND list_contains(p.chosen, n.other)
        WHERE p.rank < 8 GROUP BY p.arm, p.prompt, c.id, c.score, p.chosen, p.rank) WHERE r = 1),
packed AS (SELECT k.arm, k.prompt, k.id, k.rank, l.score, l.similarity, tokens, parent, hop, sum(tokens) OVER (PARTITION BY k.arm, k.prompt ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running
    FROM picked k JOIN pool l ON l.arm = k.arm AND l.prompt = k.prompt AND l.id = k.id)
SELECT arm, prompt, CAST(rank AS INT) AS place, id, round(CAST(score AS DOUBLE), 6) AS score, round(CAST(similarity AS DOUBLE), 6) AS similarity, tokens, parent, CAST(hop AS INT) AS hop
FROM packed WHERE running <= 4000"""


def _prompts(m):
    """Every 50th record as a prompt, and its needles: its first three long words, then its entities."""
    rows = m.where("n % 50 = 0").select(F.col("id").alias("prompt"), "project", F.array().cast("array<string>").alias("ancestors"), "embedding", F.col("exact_text").alias("text"))
    own = rows.select("prompt", F.posexplode(F.slice(tx.long_words(F.col("text"), 9), 1, 3)).alias("place", "needle"))
    return rows, needles.with_entities(own, needles.entity_needles(rows, _vocabulary(m)))


@query("settings_sweep", SWEEP_SQL)
def settings_sweep(spark, d):
    # documents beyond the least and greatest id of a vector join none, and their texts need no shuffle
    ids = table(spark, d, "embeddings").agg(F.min("vec_id").alias("least"), F.max("vec_id").alias("greatest"))
    near = table(spark, d, "documents").join(F.broadcast(ids), F.col("doc_id").between(F.col("least"), F.col("greatest")))
    m = written(mem(spark, d, near), "records")  # read by many steps, each of which would join the texts of all documents again
    pad = lambda c: F.concat(F.lit("m"), F.lpad(F.col(c).cast("string"), 6, "0")).alias(c)
    edges = _edges(spark, d).select(pad("source"), pad("target"), "kind", "weight")
    rows, wanted = _prompts(m)
    found = sweep.sweep(m, edges, rows, wanted, SWEEP)
    return found.select("arm", "prompt", "place", "id", r6("score"), r6("similarity"), "tokens", "parent", "hop")


@query(
    "needle_budget",
    r"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}]{8,}') AS words FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, turn, unnest(words) AS needle, unnest(range(len(words))) AS pos FROM t),
o AS (SELECT conv_id, turn, needle, min(pos) AS pos FROM f GROUP BY ALL)
SELECT conv_id, turn, needle, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS INT) AS place FROM o QUALIFY place <= 6""",
)
def needle_budget(spark, d):
    t = table(spark, d, "conversations").where("role = 'user'")
    own = needles.budgeted(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), tx.long_words(F.col("text")))
    return t.select("conv_id", "turn", F.posexplode(own).alias("at", "needle")).select("conv_id", "turn", "needle", (F.col("at") + 1).alias("place"))
