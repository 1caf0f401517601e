"""Roll-ups, totals, health, histories and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import text as tx
from keepsake.operators import activity, evaluate, history, mutate, packing, vectors
from keepsake.queries.base import COS, EV, MEM, NOW, events, mem, query, r6, vector_of
from keepsake.runtime import table

DAYS = "days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-31' - INTERVAL {n} DAY, DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS bucket)"
WEEKS = "weeks AS (SELECT CAST(unnest(generate_series(DATE '2024-01-29' - INTERVAL {n} WEEK, DATE '2024-01-29', INTERVAL 7 DAY)) AS DATE) AS bucket)"


@query("daily_activity", f"WITH {EV}, {DAYS.format(n=39)}, c AS (SELECT day AS bucket, count(*) AS n FROM ev GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM days LEFT JOIN c USING (bucket)")
def daily_activity(spark, d):
    return activity.activity(events(spark, d), "ts_ms", "day", 40, NOW)


@query("weekly_activity", f"WITH {EV}, {WEEKS.format(n=11)}, c AS (SELECT CAST(date_trunc('week', day) AS DATE) AS bucket, count(*) AS n FROM ev GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM weeks LEFT JOIN c USING (bucket)")
def weekly_activity(spark, d):
    return activity.activity(events(spark, d), "ts_ms", "week", 12, NOW)


def _usage(spark, d):
    return events(spark, d).select("ts_ms", F.col("event_type").alias("source"), F.floor("value").alias("input_tokens"), F.col("k").alias("output_tokens"))


@query("token_totals", f"""WITH {EV}, {DAYS.format(n=29)}, c AS (SELECT day AS bucket, CAST(sum(greatest(floor(value), 0)) AS BIGINT) AS i, CAST(sum(greatest(k, 0)) AS BIGINT) AS o FROM ev WHERE event_type = 'purchase' GROUP BY 1)
SELECT bucket, coalesce(i, 0) AS input_tokens, coalesce(o, 0) AS output_tokens, coalesce(i, 0) + coalesce(o, 0) AS total_tokens FROM days LEFT JOIN c USING (bucket)""")
def token_totals(spark, d):
    return activity.token_totals(_usage(spark, d), "day", 30, NOW, "purchase")


@query("latest_snapshot", f"WITH {EV}, {WEEKS.format(n=7)}, c AS (SELECT CAST(date_trunc('week', day) AS DATE) AS bucket, event_id, row_number() OVER (PARTITION BY date_trunc('week', day) ORDER BY ts_ms DESC, event_id) AS r FROM ev WHERE event_type = 'signup') SELECT bucket, event_id FROM weeks LEFT JOIN (SELECT * FROM c WHERE r = 1) x USING (bucket)")
def latest_snapshot(spark, d):
    return activity.latest_snapshots(events(spark, d).where("event_type = 'signup'"), "ts_ms", "event_id", "week", 8, NOW)


@query("pool_stats", f"""WITH {MEM} SELECT 'type' AS dimension, type AS key, count(*) AS n FROM mem GROUP BY type UNION ALL SELECT 'project', project, count(*) FROM mem GROUP BY project
UNION ALL SELECT 'scope', scope, count(*) FROM mem GROUP BY scope UNION ALL SELECT 'total', 'all', count(*) FROM mem UNION ALL SELECT 'deprecated', 'all', count(*) FROM mem WHERE deprecated""")
def pool_stats(spark, d):
    return activity.pool_stats(mem(spark, d))


@query("usage_summary", f"WITH {MEM} SELECT count(*) AS n, round(avg(retrieval_count), 9) AS avg_retrievals, round(avg(usage_count), 9) AS avg_usages, round(sum(usage_count) / sum(retrieval_count), 9) AS avg_usage_ratio FROM mem WHERE retrieval_count > 0")
def usage_summary(spark, d):
    s = activity.usage_summary(mem(spark, d))
    return s.select("n", *[F.round(c, 9).alias(c) for c in s.columns[1:]])


@query("record_counts", f"WITH {MEM} SELECT count(*) AS total, CAST(sum(CAST(deprecated AS INT)) AS BIGINT) AS deprecated, CAST(sum(CAST(scope = 'global' AS INT)) AS BIGINT) AS global, CAST(sum(failure_count) AS BIGINT) AS failures FROM mem")
def record_counts(spark, d):
    return mem(spark, d).agg(F.count("*").alias("total"), F.count_if("deprecated").alias("deprecated"), F.count_if(F.col("scope") == "global").alias("global"), F.sum("failure_count").alias("failures"))


def _runs(spark, d):
    e = events(spark, d).where("event_type in ('signup', 'error')")
    return e.select((F.col("user_id") % 20).cast("string").alias("source"), "ts_ms", (F.col("event_type") == "error").alias("failed"))


@query("run_health", f"""WITH {EV}, r AS (SELECT CAST(user_id % 20 AS VARCHAR) AS source, ts_ms, event_type = 'error' AS failed FROM ev WHERE event_type IN ('signup', 'error')),
 d AS (SELECT source, count(*) FILTER (WHERE ts_ms >= {NOW - 86400000} AND ts_ms <= {NOW}) AS runs, count(*) FILTER (WHERE failed AND ts_ms >= {NOW - 86400000} AND ts_ms <= {NOW}) AS failures FROM r GROUP BY source),
 g AS (SELECT source, ts_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY source ORDER BY ts_ms) AS gap FROM r WHERE NOT failed),
 s AS (SELECT source, count(*) AS successes, max(ts_ms) AS last, median(gap) FILTER (WHERE gap > 0) AS median_gap FROM g GROUP BY source)
SELECT d.source, runs, failures, successes, median_gap, runs >= 3 AND failures >= 2 AND failures >= 0.5 * runs AS failing,
 coalesce(successes >= 4 AND {NOW} - last > greatest(259200000.0, 4 * median_gap), false) AS stalled FROM d LEFT JOIN s USING (source)""")
def run_health(spark, d):
    return activity.run_health(_runs(spark, d), NOW)


@query("run_status", f"WITH {EV} SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN k < 10 THEN 'skipped' WHEN k % 3 > 0 THEN CASE WHEN value > 50 THEN 'partial' ELSE 'failed' END ELSE 'completed' END AS status FROM ev")
def run_status(spark, d):
    e = events(spark, d)
    error, skip = F.when(F.col("event_type") == "error", "x"), F.when(F.col("k") < 10, "short")
    return e.select("event_id", activity.run_status(error, skip, F.col("k") % 3, F.when(F.col("value") > 50, 1).otherwise(0)).alias("status"))


@query("outcome_counts", f"WITH {EV} SELECT session, count(*) FILTER (WHERE event_type = 'signup') AS inserted, count(*) FILTER (WHERE event_type = 'purchase') AS updated, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS events FROM ev GROUP BY session")
def outcome_counts(spark, d):
    one = lambda t: F.count_if(F.col("event_type") == t)
    return events(spark, d).groupBy("session").agg(one("signup").alias("inserted"), one("purchase").alias("updated"), one("error").alias("failed"), F.count("*").alias("events"))


@query("latest_entry", f"WITH {EV} SELECT k, event_id, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts_ms DESC, event_id DESC) AS r FROM ev) WHERE r = 1")
def latest_entry(spark, d):
    return mutate.first_by(events(spark, d), ["k"], [F.desc("ts_ms"), F.desc("event_id")]).select("k", "event_id", "ts_ms")


@query("latest_injection_group", f"WITH {EV} SELECT session, event_id, k FROM (SELECT *, rank() OVER (PARTITION BY session ORDER BY ts_ms DESC) AS r FROM ev WHERE event_type = 'view') WHERE r = 1")
def latest_injection_group(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy(F.desc("ts_ms"))
    return events(spark, d).where("event_type = 'view'").withColumn("r", F.rank().over(w)).where("r = 1").select("session", "event_id", "k")


@query("session_counters", f"WITH {EV}, {MEM} SELECT event_id, 'm' || lpad(CAST(k * 7 AS VARCHAR), 6, '0') AS id, retrieval_count, usage_count FROM ev LEFT JOIN mem ON mem.id = 'm' || lpad(CAST(k * 7 AS VARCHAR), 6, '0') WHERE event_type = 'click'")
def session_counters(spark, d):
    e = events(spark, d).where("event_type = 'click'").select("event_id", F.concat(F.lit("m"), F.lpad((F.col("k") * 7).cast("string"), 6, "0")).alias("id"))
    return e.join(mem(spark, d).select("id", "retrieval_count", "usage_count"), "id", "left")


@query("latest_earlier_call", f"""WITH {EV}, c AS (SELECT user_id, ts_ms, event_id FROM ev WHERE event_type = 'click'), p AS (SELECT user_id, ts_ms, event_id FROM ev WHERE event_type = 'purchase')
SELECT p.user_id, p.ts_ms, p.event_id, max_by(c.event_id, struct_pack(a := c.ts_ms, b := c.event_id)) AS latest FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.ts_ms <= p.ts_ms GROUP BY ALL""")
def latest_earlier_call(spark, d):
    e = events(spark, d)
    pick = lambda t: e.where(F.col("event_type") == t).select("user_id", "ts_ms", "event_id")
    calls = pick("click").withColumnRenamed("event_id", "call_id")
    return history.latest_before(pick("purchase"), calls, "user_id", "ts_ms", "call_id")


@query("last_turns", """WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS turn_no FROM conversations),
 w AS (SELECT conv_id, CAST(turn_no AS BIGINT) AS turn_no, arg_min(text, turn) FILTER (WHERE role = 'user') AS user_text, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS assistant_text, count(*) FILTER (WHERE role = 'assistant') AS a
  FROM t WHERE turn_no > 0 AND role IN ('user', 'assistant') GROUP BY ALL HAVING count(*) FILTER (WHERE role = 'assistant') > 0)
SELECT conv_id, turn_no, user_text, assistant_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_no DESC) AS r FROM w) WHERE r <= 3""")
def last_turns(spark, d):
    return history.last_turns(table(spark, d, "conversations"), 3)


@query("last_line", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_line(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("nth_last_user_message", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r = 2")
def nth_last_user_message(spark, d):
    return history.nth_last(table(spark, d, "conversations"), F.col("role") == "user", 2, "conv_id", "turn").select("conv_id", "turn", "text")


@query("context_window", "WITH h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, contains(lower(text), 'tion') AS hit FROM conversations) SELECT DISTINCT a.conv_id, a.turn FROM h a JOIN h b ON a.conv_id = b.conv_id AND b.hit AND abs(a.p - b.p) <= 3")
def context_window(spark, d):
    rows = history.around(table(spark, d, "conversations"), F.lower("text").contains("tion"), 3, "conv_id", "turn")
    return rows.select("conv_id", "turn").distinct()


@query("suffix_packing", "WITH t AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations) SELECT conv_id, turn, CAST(running AS BIGINT) AS running FROM t WHERE running <= 600 OR p = 1")
def suffix_packing(spark, d):
    rows = packing.newest_within(table(spark, d, "conversations"), F.char_length("text"), 600, [F.desc("turn")], ["conv_id"])
    return rows.select("conv_id", "turn", F.col("running").cast("long").alias("running"))


@query("message_length_gate", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id HAVING sum(length(text)) >= 400")
def message_length_gate(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("chars")).where("chars >= 400")


@query("recent_ids", f"WITH {EV} SELECT session, k, CAST(r AS INT) AS place FROM (SELECT session, k, row_number() OVER (PARTITION BY session ORDER BY max(ts_ms) DESC, k) AS r FROM ev GROUP BY session, k) WHERE r <= 3")
def recent_ids(spark, d):
    return history.recent_ids(events(spark, d), 3, "session", "k", "ts_ms").select("session", "k", "place")


ARMS = f"""q AS (SELECT id AS prompt, embedding AS v FROM mem WHERE n % 50 = 0), sims AS (SELECT prompt, m.id, m.n, {COS.format(a='m.embedding', b='q.v')} AS s, type FROM mem m JOIN q ON m.id <> q.prompt WHERE NOT deprecated),
 arms AS (SELECT 'base' AS arm, prompt, id, n FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY s DESC, id) AS r FROM sims) WHERE r <= 8
  UNION ALL SELECT 'typed', prompt, id, n FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY s DESC, id) AS r FROM sims WHERE type <> 'warning') WHERE r <= 12)"""


def _arms(spark, d):
    """Every 50th record as a prompt, against all others, in two arms."""
    m = mem(spark, d)
    live = m.where(~F.col("deprecated"))
    arm = lambda name, pool, k: vectors.neighbours(m.where("n % 50 = 0"), pool, k, -1.0).select(F.lit(name).alias("arm"), F.col("id").alias("prompt"), F.col("other").alias("id"))
    both = arm("base", live, 8).unionByName(arm("typed", live.where("type <> 'warning'"), 12))
    return both.withColumn("n", F.substring("id", 2, 18).cast("long"))


@query("arm_metrics", f"WITH {MEM}, {ARMS}, j AS (SELECT arms.*, CASE WHEN n % 3 <> 0 THEN n % 2 = 0 END AS helpful FROM arms), b AS (SELECT prompt, id FROM arms WHERE arm = 'base') SELECT arm, count(DISTINCT j.prompt) AS prompts, count(*) AS injected, count(helpful) AS judged, count(*) FILTER (WHERE helpful) AS helpful, count(*) FILTER (WHERE helpful AND b.id IS NULL) AS discoveries, round(count(*) FILTER (WHERE helpful) / count(helpful), 6) AS precision FROM j LEFT JOIN b ON j.prompt = b.prompt AND j.id = b.id GROUP BY arm")
def arm_metrics(spark, d):
    arms = _arms(spark, d)
    verdicts = arms.where("n % 3 <> 0").select("prompt", "id", (F.col("n") % 2 == 0).alias("helpful")).distinct()
    found = evaluate.arm_metrics(arms.drop("n"), verdicts, "base")
    return found.withColumn("precision", F.round("precision", 6))


@query("arm_overlap", f"WITH {MEM}, {ARMS}, a AS (SELECT prompt, id FROM arms WHERE arm = 'base'), b AS (SELECT prompt, id FROM arms WHERE arm = 'typed'), i AS (SELECT prompt, count(*) AS n FROM a JOIN b USING (prompt, id) GROUP BY prompt), u AS (SELECT prompt, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY prompt) SELECT prompt, round(coalesce(i.n, 0) / u.n, 6) AS jaccard FROM u LEFT JOIN i USING (prompt)")
def arm_overlap(spark, d):
    return evaluate.overlap(_arms(spark, d), "base", "typed").select("prompt", r6("jaccard"))


@query("blind_union", f"WITH {MEM}, {ARMS}, u AS (SELECT DISTINCT prompt, id FROM arms) SELECT prompt, id, CAST(row_number() OVER (PARTITION BY prompt ORDER BY sha256('s1:' || id), id) AS INT) AS place FROM u")
def blind_union(spark, d):
    return evaluate.blind_union(_arms(spark, d), "s1")


@query("long_words", f"WITH {MEM} SELECT id, len(list_distinct(regexp_extract_all(lower(exact_text), '[\\p{{L}}]{{8,}}'))) AS n FROM mem")
def long_words(spark, d):
    return mem(spark, d).select("id", F.size(tx.long_words(F.col("exact_text"))).cast("long").alias("n"))


@query("snippets", "SELECT doc_id, CASE WHEN length(o) <= 120 THEN o ELSE substr(o, 1, 117) || '...' END AS snippet, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 50) || right(text, 50) END AS ends FROM (SELECT doc_id, text, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS o FROM documents)")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"), tx.head_and_tail(F.col("text"), 100).alias("ends"))


@query("slugs", "SELECT c_custkey, substr(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM customer")
def slugs(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.slug(F.col("c_name")).alias("slug"))


WORDS = lambda words: ", ".join(f"'{w}'" for w in words)


@query(
    "keywords",
    f"""
WITH {MEM}, t AS (SELECT id, regexp_extract_all(coalesce(exact_text, ''), '{tx.TOKEN}') AS found FROM mem),
w AS (SELECT id, unnest(found) AS word, generate_subscripts(found, 1) AS place FROM t),
kept AS (
    SELECT id, lower(word) AS low, min(place) AS place FROM w
    WHERE lower(word) NOT IN ({WORDS(tx.STOPWORDS)}) AND (lower(word) IN ({WORDS(tx.SHORT_TECH)})
        OR length(word) >= 3 AND regexp_matches(word, '^\\p{{Lu}}') OR regexp_matches(word, '\\d') OR regexp_matches(word, '[/:\\\\]')
        OR regexp_matches(word, '\\.[A-Za-z0-9]+') OR length(word) >= 4 AND regexp_matches(word, '^[\\p{{Ll}}\\p{{M}}]+$'))
    GROUP BY id, low)
SELECT id, coalesce(string_agg(low, ' ' ORDER BY place), '') AS keywords FROM t LEFT JOIN kept USING (id) GROUP BY id""",
)
def keywords(spark, d):
    return mem(spark, d).select("id", F.array_join(tx.keywords(F.col("exact_text")), " ").alias("keywords"))


ENTRIES = "entries AS (SELECT session, ts_ms // 3600000 * 3600000 AS ts_ms, CASE k % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' p' || CAST(k AS VARCHAR) END AS prompt, 'm' || CAST(k % 5 AS VARCHAR) AS id FROM ev)"


@query(
    "latest_injections",
    f"""
WITH {EV}, {ENTRIES}, g AS (SELECT session, ts_ms, min(trim(prompt)) AS prompt FROM entries WHERE trim(prompt) <> '' GROUP BY ALL),
l AS (SELECT session, max(ts_ms) AS ts_ms, arg_max(prompt, ts_ms) AS prompt FROM g GROUP BY session)
SELECT DISTINCT session, ts_ms, l.prompt, id FROM l JOIN entries USING (session, ts_ms)""",
)
def latest_injections(spark, d):
    k = F.col("k")
    hour = (F.floor(F.col("ts_ms") / 3600000) * 3600000).alias("ts_ms")
    prompt = F.when(k % 4 == 0, " ").when(k % 4 == 1, F.concat(F.lit(" p"), k.cast("string")))
    return history.latest_injections(events(spark, d).select("session", hour, prompt.alias("prompt"), F.concat(F.lit("m"), (k % 5).cast("string")).alias("id")))


@query(
    "delete_report",
    f"""
WITH {MEM}, asked AS (SELECT DISTINCT 'm' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS id FROM orders)
SELECT id, CASE WHEN id IN (SELECT id FROM mem) THEN 'deleted' ELSE 'missing' END AS outcome FROM asked""",
)
def delete_report(spark, d):
    asked = table(spark, d, "orders").select(F.concat(F.lit("m"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("id"))
    return mutate.delete_reported(mem(spark, d), asked)[1]
