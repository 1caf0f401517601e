import json

from pyspark.sql import functions as F

from keepsake.sources import logs
from keepsake.streaming import jobs

NOW = 1706659200000


def test_event_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    e = spark.createDataFrame([("a", "x", NOW - 86_400_000, "g", ["b"]), ("b", "x", None, "g", [])], logs.EVENT)
    logs.write_events(e, path, NOW)
    assert sorted(r["id"] for r in logs.read_events(spark, path).collect()) == ["a", "b"]
    assert [r["id"] for r in logs.read_events(spark, path, since_ms=NOW).collect()] == ["b"]
    assert logs.days(spark, path).count() == 2


def test_transcript(spark, tmp_path):
    lines = [
        {"type": "user", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": "ls"}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "files"}]}},
        {"type": "user", "isSidechain": True, "message": {"role": "user", "content": "no"}},
    ]
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in lines) + "\nbroken\n")
    got = [(r["kind"], r["text"], r["name"]) for r in logs.transcript(spark, str(path)).orderBy("line", "place").collect()]
    assert got == [("user", "hello", None), ("assistant", "hi", None), ("tool_call", None, "Bash"), ("tool_result", "files", "Bash")]


def test_daily_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    e = spark.range(50).select(F.timestamp_millis(F.lit(NOW) - F.col("id") * 7_200_000).alias("ts"))
    e.write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = jobs.write_now(jobs.daily_counts(stream, "ts"), "daily", str(tmp_path / "cp"))
    q.awaitTermination()
    batch = e.groupBy(F.to_date("ts").alias("bucket")).agg(F.count("*").alias("n"))
    assert sorted(spark.table("daily").collect()) == sorted(batch.collect())


def test_recent_ids_state(spark, tmp_path):
    src = str(tmp_path / "in")
    u = spark.createDataFrame([("s", x, i) for i, x in enumerate("abcab")], "session string, id string, seq int")
    u.coalesce(1).write.parquet(src)
    q = jobs.write_now(jobs.recent_ids(spark.readStream.schema(u.schema).parquet(src), 2), "recent", str(tmp_path / "cp"), "update")
    q.awaitTermination()
    assert spark.table("recent").first()["ids"] == ["a", "b"]


def test_transcript_marker_and_parse_errors(spark, tmp_path):
    block = lambda text: {"role": "user", "content": [{"type": "text", "text": text}]}
    lines = [
        json.dumps({"type": "user", "isMeta": True, "message": block("keep <!-- mark --> this")}), json.dumps({"type": "user", "isMeta": True, "message": block("meta")}),
        json.dumps({"type": "user", "isMeta": True, "message": {"role": "user", "content": "plain <!-- mark -->"}}), json.dumps({"type": "user", "isMeta": True, "isSidechain": True, "message": block("<!-- mark -->")}),
        "", "  ", "{broken", json.dumps({"type": "user", "message": block("said")}), "not json", "{\"cut\":",
    ]
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(lines))
    assert [r["text"] for r in logs.transcript(spark, str(path), "<!-- mark -->").orderBy("line").collect()] == ["keep <!-- mark --> this", "said"]
    assert [r["text"] for r in logs.transcript(spark, str(path)).collect()] == ["said"]
    assert [r["errors"] for r in logs.parse_errors(spark, str(path)).collect()] == [3]


def test_token_events_are_made_fit(spark):
    rows = [("extraction", " m ", "5", "-3", "s"), ("unknown", "m", "5", "5", "s"), ("maintenance", None, None, "x", "s"), ("haiku-query", "  ", "2.9", "1", " "), (None, "m", "1", "1", None)]
    df = spark.createDataFrame(rows, "source string, model string, inputTokens string, outputTokens string, sessionId string")
    assert sorted(tuple(r) for r in logs.token_events(df).collect()) == [("extraction", "m", 5, 0, "s"), ("haiku-query", "unknown", 2, 1, None)]


def test_documents_by_key(spark, tmp_path):
    for k, v in (("a", {"x": 1, "y": "one"}), ("b c", {"x": 2})):
        (tmp_path / f"{k}.json").write_text(json.dumps(v, indent=1))
    got = logs.read_documents(spark, str(tmp_path), "x int, y string").collect()
    assert sorted((r["key"].replace("%20", " "), r["x"], r["y"]) for r in got) == [("a", 1, "one"), ("b c", 2, None)]


def test_weekly_counts_and_distinct_events(spark, tmp_path):
    src = str(tmp_path / "in")
    e = spark.range(60).select((F.col("id") % 40).alias("id"), F.timestamp_millis(F.lit(NOW) - (F.col("id") % 40) * 40_000_000).alias("ts"))
    e.coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(e.schema).parquet(src)
    jobs.write_now(jobs.weekly_counts(read(), "ts"), "weekly", str(tmp_path / "cp1")).awaitTermination()
    batch = e.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("bucket")).agg(F.count("*").alias("n"))
    assert sorted(spark.table("weekly").collect()) == sorted(batch.collect())
    jobs.write_now(jobs.distinct_events(read(), "ts", ["id"]), "single", str(tmp_path / "cp2"), "append").awaitTermination()
    assert sorted(r["id"] for r in spark.table("single").collect()) == list(range(40))


def test_diversity_exclusions_name_the_nearest_chosen(spark):
    import numpy as np

    from keepsake.operators import packing

    rng = np.random.default_rng(1)
    rows = [("q", f"r{i:02}", float(rng.random()), float(rng.random()), rng.normal(size=3).tolist()) for i in range(20)]
    pool = spark.createDataFrame(rows, "query_id string, id string, score double, similarity double, embedding array<double>")
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    vec, score = {r[1]: r[4] for r in rows}, {r[1]: r[2] for r in rows}
    for limit in (1, 6):
        chosen = packing.maximal_marginal_relevance(pool, limit, 0.4)
        order = [r["id"] for r in chosen.orderBy("rank").collect()]
        threshold = 0.4 * score[order[-1]] - (0 if limit == 1 else 0.6 * max(cos(vec[order[-1]], vec[x]) for x in order[:-1]))
        left = [r[1] for r in sorted(rows, key=lambda r: (-r[2], -r[3], r[1]))[:limit] if r[1] not in order]
        got = {r["id"]: r for r in packing.diversity_exclusions(pool, chosen, limit, 0.4).collect()}
        assert sorted(got) == sorted(left)
        for i, r in got.items():
            near = max(order, key=lambda x: cos(vec[i], vec[x]))  # noqa: B023
            assert r["similar_to"] == near and abs(r["similarity"] - cos(vec[i], vec[near])) < 1e-9 and abs(r["threshold"] - threshold) < 1e-9
            assert abs(r["gap"] - (threshold - (0.4 * score[i] - 0.6 * r["similarity"]))) < 1e-9
