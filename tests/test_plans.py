"""Retrieval of one prompt, and maintenance runs."""

import numpy as np
from pyspark.sql import functions as F

from keepsake.plans import maintenance, retrieval, sweep
from keepsake.settings import DAY_MS, Settings
from test_batch import store

NOW = 1_700_000_000_000


def test_retrieve_is_the_sweep_of_one_prompt(spark):
    df, ed, pr, wa, rows, _, prompts, wanted = store(spark)
    s = Settings(min_semantic_similarity=0.3, min_score=0.25, min_semantic_only_score=0.35, min_expanded_score=0.0, semantic_anchor_threshold=0.9, max_records=4, max_tokens=30)
    nobody = df.select("id").limit(0)
    every = [r for r in sweep.sweep(df, ed, pr, wa.where("not entity"), {"a": s}).collect()]
    for pid, project, ancestors, e in prompts[:3]:
        mine = [w for p, w, entity in wanted if p == pid and not entity]
        got = retrieval.retrieve(df, ed, e, mine, project, nobody, s, ancestors).orderBy("place").collect()
        assert [(r["id"], r["place"], round(r["score"], 9), r["parent"]) for r in got] == [
            (r["id"], r["place"], round(r["score"], 9), r["parent"]) for r in sorted(every, key=lambda r: r["place"]) if r["prompt"] == pid
        ]
        if got:
            recent = spark.createDataFrame([(got[0]["id"],)], "id string")
            hard = retrieval.retrieve(df, ed, e, mine, project, recent, s.using(suppression_mode="hard"), ancestors).collect()
            assert got[0]["id"] not in {r["id"] for r in hard}
            soft = {r["id"]: r["score"] for r in retrieval.retrieve(df, ed, e, mine, project, recent, s.using(max_tokens=10_000, max_records=100), ancestors).collect()}
            assert abs(soft[got[0]["id"]] - got[0]["score"] / 2) < 1e-9


def records(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        kind = ["command", "error", "discovery", "procedure", "warning"][i % 5]
        e = (np.eye(6)[i % 6] + 0.05 * rng.normal(size=6)).tolist()
        rows.append((f"r{i:03}", kind, "ab"[i % 2], "project", NOW - (i * 3 + 1) * DAY_MS, NOW - i * 2 * DAY_MS, i % 9, (i * 7) % 6, i % 4, (i * 3) % 7, i % 10 == 9, f"text {i}", e, "verified" if i % 3 else "inferred"))
    return spark.createDataFrame(
        rows, "id string, type string, project string, scope string, ts_ms long, last_used long, retrieval_count int, usage_count int, success_count int, failure_count int, deprecated boolean, exact_text string, embedding array<double>, confidence string",
    )


def test_run_all_isolates_failures_and_reports(spark):
    df = records(spark)
    e = df.select(F.explode(F.array(F.lit("s1"), F.lit("s2"), F.lit("s3"))).alias("session"), "id", F.lit(NOW - DAY_MS).alias("ts_ms")).where("id < 'r006'")
    entities = df.select("id", F.concat(F.lit("entity"), (F.col("retrieval_count") % 9).cast("string"), F.col("project")).alias("entity"))
    more = maintenance.Inputs(events=e, entities=entities, quality=df.select("id", F.when(F.col("id") == "r000", "quality:x").alias("reason")))
    s = Settings(consolidation_threshold=0.9, cross_type_threshold=0.9, conflict_threshold=0.9, currentness_threshold=0.9, warning_threshold=0.9)
    same, actions, report = maintenance.run_all(df, s, NOW, more=more)
    told = {r["operation"]: r for r in report.collect()}
    assert set(told) == {*maintenance.OPERATIONS, *maintenance.FURTHER} and all(r["dry_run"] and r["duration_ms"] >= 0 for r in told.values())
    assert {n for n, r in told.items() if r["error"]} == {"validity"} and "needs validity" in told["validity"]["error"]
    counts = {r["operation"]: r["count"] for r in actions.groupBy("operation").count().collect()}
    assert counts == {n: r["actions"] for n, r in told.items() if r["actions"]}
    assert {"stale", "consolidation", "cross-type-consolidation", "conflicts", "currentness", "quality", "relations", "entity-overlap", "warnings", "documentation", "promotion"} <= set(counts)
    assert same is df


def test_a_run_that_is_no_dry_run_changes_the_table(spark):
    df = records(spark).withColumn("deprecated_at", F.lit(None).cast("long")).withColumn("deprecated_reason", F.lit(None).cast("string")).withColumn("superseding_record_id", F.lit(None).cast("string"))
    after, actions, report = maintenance.run_all(df, Settings(), NOW, ["stale", "zero-usage", "no-such-thing"], dry_run=False)
    gone = {r["id"] for r in actions.where("action = 'deprecate'").collect()}
    assert gone and {r["id"] for r in after.where("deprecated").collect()} == gone | {r["id"] for r in df.where("deprecated").collect()}
    assert [(r["operation"], r["error"] is None) for r in report.collect()] == [("stale", True), ("zero-usage", True), ("no-such-thing", False)]
