import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake import filters, records, schema
from keepsake.functions import text as tx
from keepsake.operators import activity, clusters, evaluate, graph, history, mutate, packing, scans, search, vectors, writes
from keepsake.plans import context
from keepsake.settings import DAY_MS, Settings

NOW = 1706659200000


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def vec(spark, data):
    return spark.createDataFrame(data, "id string, type string, project string, scope string, deprecated boolean, usage_count long, retrieval_count long, exact_text string, embedding array<float>")


def sample(spark):
    return vec(spark, [
        ("a", "command", "/p", "project", False, 0, 0, "npm run build", [1.0, 0.0]), ("b", "command", "/p", "project", False, 3, 3, "npm test", [0.9, 0.1]),
        ("c", "error", "/q", "global", False, 1, 4, "build failed 100%", [0.0, 1.0]), ("d", "error", "/q", "project", True, 1, 4, "old", [1.0, 0.0]),
        ("e", "error", "/q", "project", False, 1, 4, "no vector", [0.0, 0.0]),
    ])


def test_cosine_defined_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(2**-0.5), 0, 0, 0, 0]


def test_limit_comes_before_threshold(spark):
    df = sample(spark)
    assert [r["id"] for r in vectors.top_k(df, [1.0, 0.0], 2, 0.95, ~F.col("deprecated")).collect()] == ["a", "b"]
    assert [r["id"] for r in vectors.top_k(df, [1.0, 0.0], 1, 0.999, ~F.col("deprecated")).collect()] == ["a"]


def test_neighbours_keep_types_apart(spark):
    df = sample(spark)
    near = vectors.neighbours(df, df, 3, 0.5, same=("type",))
    assert rows(near, "id", "other") == [("a", "b"), ("b", "a")]
    assert rows(vectors.neighbours(df, df, 3, 0.5, differ="type"), "id", "other") == [("a", "d"), ("b", "d"), ("d", "a"), ("d", "b")]


def test_keyword_rows_interleave(spark):
    df = sample(spark)
    got = [tuple(r) for r in search.keyword_rows(df, ["npm", "FAILED", " "], 3).collect()]
    assert got == [("a", 0, 1), ("c", 1, 1), ("b", 0, 2)]
    assert filters.like_pattern("50%_\\") == "%50\\%\\_\\\\%"


def test_hybrid_keeps_zero_for_far_keyword_rows(spark):
    s = Settings(min_semantic_similarity=0.5, min_score=0.0)
    got = {r["id"]: (round(r["similarity"], 3), r["keyword_match"]) for r in search.hybrid(sample(spark), [1.0, 0.0], ["failed"], s).collect()}
    assert got["c"] == (0.0, True)
    assert got["a"] == (1.0, False)


def test_suppression(spark):
    found = spark.createDataFrame([("a", 0.8), ("b", 0.6)], "id string, score double")
    recent = spark.createDataFrame([("a",)], "id string")
    assert rows(search.suppressed(found, recent, Settings()), "id", "score") == [("a", 0.4), ("b", 0.6)]
    assert rows(search.suppressed(found, recent, Settings(suppression_mode="hard")), "id") == [("b",)]


def test_stop_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "o int, n int")
    assert rows(packing.stop_at_overflow(df, F.col("n"), 10, [F.col("o")]), "o") == [(1,)]


def test_mmr_prefers_variety(spark):
    df = spark.createDataFrame(
        [("q", "a", 0.9, [1.0, 0.0]), ("q", "b", 0.89, [1.0, 0.01]), ("q", "c", 0.7, [0.0, 1.0]), ("q", "d", 0.5, None)],
        "query_id string, id string, score double, embedding array<double>",
    )
    got = [r["id"] for r in packing.maximal_marginal_relevance(df, 4, 0.7).orderBy("rank").collect()]
    assert got == ["a", "c", "b", "d"]


def test_soft_delete_writes_once(spark):
    t = spark.createDataFrame([("a", False, None, None, None), ("b", True, 5, "old", None)], "id string, deprecated boolean, deprecated_at long, deprecated_reason string, superseding_record_id string")
    actions = spark.createDataFrame([("a", "dup", "c"), ("b", "dup", "c")], "id string, reason string, superseding string")
    got = rows(mutate.soft_delete(t, actions, NOW), "id", "deprecated", "deprecated_at", "deprecated_reason")
    assert got == [("a", True, NOW, "dup"), ("b", True, 5, "old")]


def test_upsert_is_idempotent(spark):
    t, s = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    once = mutate.upsert(t, s)
    assert rows(once, "id", "v") == rows(mutate.upsert(once, s), "id", "v") == [("a", 1), ("b", 3), ("c", 4)]


def test_migrate_fills_typed_defaults(spark):
    out = schema.migrate(spark.createDataFrame([("x", "junk")], "id string, domain string"))
    assert out.columns == schema.RECORDS.names
    assert out.schema["deprecated_at"].dataType.simpleString() == "bigint"
    assert out.first()["usage_count"] == 0


def test_components_are_the_closure(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 40) if i != 20], "a string, b string")
    got = {r["cluster"] for r in graph.components(edges).collect()}
    assert got == {"000", "021"}


def test_expand_budget_and_known(spark):
    found = spark.createDataFrame([("a", 1.0, 0.9)], "id string, score double, similarity double")
    edges = spark.createDataFrame([("a", "b", "relates_to", 0.5), ("a", "c", "relates_to", 0.9), ("a", "d", "shares_entity", 1.0), ("c", "e", "relates_to", 1.0), ("b", "a", "relates_to", 1.0)], "source string, target string, kind string, weight double")
    recs = spark.createDataFrame([(i, False) for i in "abcde"], "id string, deprecated boolean")
    assert [r["id"] for r in graph.expand(found, edges, recs).collect()] == ["c", "b"]
    two = graph.expand(found, edges, recs, hops=2, most=2)
    assert rows(two, "id", "hop") == [("c", 1), ("e", 2)]


def test_entity_edges_need_rare_entities(spark):
    ents = [(f"r{i}", "everywhere") for i in range(30)] + [("r1", "rare"), ("r2", "rare")]
    got = graph.entity_edges(spark.createDataFrame(ents, "id string, entity string"), 30)
    assert rows(got, "a", "b", "shared") == [("r1", "r2", 1)]


def test_star_clusters_follow_time(spark):
    df = spark.createDataFrame([("p", "a", 2, [1.0, 0.0]), ("p", "b", 1, [1.0, 0.1]), ("p", "c", 3, [0.0, 1.0])], "project string, id string, ts_ms long, embedding array<float>")
    assert rows(clusters.star_clusters(df, df, 0.8, 8, 12, ["project"]), "cluster", "id") == [("b", "a"), ("b", "b"), ("c", "c")]


@pytest.mark.parametrize("tail", [0, clusters.TAIL])
def test_star_clusters_equal_brute_force_without_whole_groups(spark, monkeypatch, tail):
    """One hot project and small ones, copies among them, in cells of 50 rows."""
    monkeypatch.setattr(vectors, "GROUP", 50)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (180, 3)).astype(float)
    x[20:50] = [1.0, 2.0, -1.0]
    data = [("hot" if i < 120 else f"p{i % 3}", f"r{i:03d}", int(rng.integers(0, 60)), x[i].tolist()) for i in range(180)]
    df = spark.createDataFrame(data, "project string, id string, ts_ms long, embedding array<double>").repartition(4).cache()
    near = defaultdict(list)
    for r in vectors.neighbours(df, df, 12, 0.7, same=("project",)).orderBy("id", "rank").collect():
        near[r["id"]].append(r["other"])
    for alone_is_used in (False, True):
        used, members, alone = set(), [], []
        for _, i in sorted((t, i) for _, i, t, _ in data if t < 50):  # the later ones are no seeds
            if i not in used:
                took = [j for j in near[i] if j not in used and j[-1] != "7"][:4]
                used |= set(took) | ({i} if took or alone_is_used else set())
                members += [(i, j) for j in [i, *took]] if took else []
                alone += [] if took else [i]
        inside = {j for _, j in members}
        expected = members + [(i, i) for i in alone if i not in inside]
        found = clusters.star_clusters(df.where("ts_ms < 50"), df, 0.7, 5, 12, ["project"], ~F.col("id").endswith("7"), alone_is_used, tail)
        assert rows(found, "cluster", "id") == sorted(expected)


def _greedy(listed, seeds, most, alone_is_used):
    used, members, alone = set(), [], []
    for _, i in sorted(seeds):
        if i not in used:
            took = [j for j in listed.get(i, []) if j not in used][: most - 1]
            used |= set(took) | ({i} if took or alone_is_used else set())
            members += [(i, j) for j in [i, *took]] if took else []
            alone += [] if took else [i]
    inside = {j for _, j in members}
    return sorted(members + [(i, i) for i in alone if i not in inside])


@pytest.mark.parametrize("tail", [7, 10_000])
def test_greedy_stars_in_parts_of_all_sizes(spark, tail):
    """Components from two rows to most of all, seeds that list nothing, rows that are no seeds, equal times."""
    rng = np.random.default_rng(5)
    names = [f"n{i:03d}" for i in range(160)]
    seeds = [(int(rng.integers(0, 30)), i) for i in names if i[-1] != "3"]
    listed = {}
    for _, i in seeds:
        n = int(i[1:])
        pool = names[:90] if n < 90 else names[90 + (n - 90) // 7 * 7 : 97 + (n - 90) // 7 * 7]
        listed[i] = [j for j in rng.permutation(pool)[: int(rng.integers(0, 4))].tolist() if j != i]
    pairs = spark.createDataFrame([(i, j, r) for i, js in listed.items() for r, j in enumerate(js)], "id string, other string, rank int")
    order = spark.createDataFrame(seeds, "ts_ms long, id string").select("id", F.struct("ts_ms", "id").alias("at"))
    for alone_is_used in (False, True):
        found = clusters.greedy_stars(pairs, order, 3, alone_is_used, tail)
        assert rows(found, "cluster", "id") == _greedy(listed, seeds, 3, alone_is_used)
    nothing = clusters.greedy_stars(pairs.where("false"), order, 3, False, tail)
    assert rows(nothing, "cluster", "id") == sorted((i, i) for _, i in seeds)


def test_greedy_stars_of_a_long_chain(spark):
    """Each of 100 000 seeds lists the next one: settled in rounds of `TAIL` rows, not one seed a round."""
    n = 100_000
    name = lambda c: F.lpad(c.cast("string"), 6, "0")
    ids = spark.range(n).select(name(F.col("id")).alias("id"), F.col("id").alias("n"))
    order = ids.select("id", F.struct(F.col("n").alias("ts_ms"), "id").alias("at"))
    pairs = ids.where(F.col("n") < n - 1).select("id", name(F.col("n") + 1).alias("other"), F.lit(1).alias("rank"))
    found = clusters.greedy_stars(pairs, order, 2)
    even = found.groupBy("cluster").agg(F.count("*").alias("n"), F.max(F.col("id").cast("int") - F.col("cluster").cast("int")).alias("far"))
    assert even.where("n = 2 and far = 1 and cast(cluster as int) % 2 = 0").count() == n // 2 == even.count()


def test_warning_clusters_filter_after_the_nearest(spark):
    """The nearest row has no failures: it uses up a place, and only then is left out."""
    data = [("p", "command", "a", 1, 3, [1.0, 0.0]), ("p", "command", "b", 2, 0, [1.0, 0.01]), ("p", "command", "c", 3, 5, [1.0, 0.02]), ("p", "command", "d", 4, 2, [0.0, 1.0])]
    df = spark.createDataFrame(data, "project string, type string, id string, ts_ms long, failure_count long, embedding array<double>")
    s = Settings(warning_limit=1)
    assert rows(clusters.warning_clusters(df, s, df), "cluster", "id", "failures") == [("a", "a", 3), ("c", "c", 5), ("d", "d", 2)]
    assert rows(clusters.warning_clusters(df, Settings(warning_limit=2), df), "cluster", "id", "failures") == [("a", "a", 8), ("a", "c", 8), ("d", "d", 2)]


def test_two_hops_search_all_records(spark, tmp_path, monkeypatch):
    """The nearest records have ids from 100 on."""
    from keepsake.queries import maintaining

    ids = spark.range(0, 150)
    near = (F.col("id") == 0) | (F.col("id") >= 140)
    ids.select(F.col("id").alias("vec_id"), F.lit(2).alias("label"), F.array(F.lit(1.0), F.when(near, 0.0).otherwise(1.0)).alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    ids.select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    edges = spark.createDataFrame([(140, 7, "relates_to", 50), (1, 8, "relates_to", 50)], "source long, target long, kind string, reinforcement long")
    monkeypatch.setattr(maintaining, "_edges", lambda *_: edges)
    got = maintaining.expand_two_hops(spark, str(tmp_path))
    assert rows(got, "id", "parent") == [("m000007", "m000140")]


def test_usage_rank_has_no_limit(spark, tmp_path):
    from keepsake.queries.base import mem
    from keepsake.queries.searching import usage_rank

    ids = spark.range(0, 10_900)
    ids.select(F.col("id").alias("vec_id"), F.when(F.col("id") < 10_500, 2).otherwise(3).alias("label"), F.array(F.lit(1.0)).alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    ids.select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    found = mem(spark, str(tmp_path)).where("project = '/p/2'").select("id", "usage_count", "last_used", "ts_ms").collect()
    expected = sorted(found, key=lambda r: (-r["usage_count"], -r["last_used"], -r["ts_ms"], r["id"]))
    got = usage_rank(spark, str(tmp_path)).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(r["id"], i) for i, r in enumerate(expected, 1)] and len(got) == 10_500


def test_capped_cross_type_swaps_the_last(spark):
    c = spark.createDataFrame([("k", "a", 1.0, "x"), ("k", "b", 0.9, "x"), ("k", "c", 0.8, "y")], "cluster string, id string, similarity double, type string")
    assert rows(clusters.capped(c, 2, cross_type=True), "id") == [("a",), ("c",)]
    assert rows(clusters.capped(c, 2), "id") == [("a",), ("b",)]


def test_quality_reasons(spark):
    df = spark.createDataFrame([
        ("command", "[Tool Result] x", "fix"), ("error", "extension timeout", "retry"), ("error", "extension timeout", "restart it"),
        ("command", "reward: 1\nloss = 2\nfps 30", ""), ("command", "reward: 1\nloss = 2\nfps 30 because", ""), ("discovery", "fine", ""),
    ], "t string, p string, r string")
    got = [r[0] for r in df.select(scans.quality_reason(F.col("t"), F.col("p"), F.lit(""), [F.col("r")], [F.lit("")])).collect()]
    assert got == ["quality:tool-result-prefix", "quality:vague-extension-error", None, "quality:raw-metric-dump", None, None]
    got = [r[0] for r in df.select(scans.quality_reason(F.col("t"), F.col("p"), F.lit(""), [F.col("r")], [F.lit("scaled twice")])).collect()]
    assert got[1] == "quality:vague-extension-error" and got[3] is None, "a cause saves a metric dump only"


def test_relative_age(spark):
    ago = [0, None, NOW + 1, NOW - 60_000, NOW - 6 * 60_000, NOW - 3 * 3_600_000, NOW - 2 * DAY_MS, NOW - 8 * DAY_MS, NOW - 65 * DAY_MS]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ago)], "i int, ms long").orderBy("i")
    assert [r[0] for r in df.select(records.relative_age(F.col("ms"), NOW)).collect()] == [None, None, None, "just now", "6m ago", "3h ago", "2d ago", "1w ago", "2mo ago"]


def test_validity_and_rendering(spark):
    good = json.dumps({"command": "npm  test", "exitCode": 0, "outcome": "success", "context": {"project": "p"}, "resolution": "ok"})
    df = records.parse_payload(spark.createDataFrame([("command", good), ("command", "{}"), ("error", "not json"), ("other", good)], "type string, content string"))
    assert [r[0] for r in df.select(records.is_valid(F.col("type"), F.col("payload"))).collect()] == [True, False, False, False]
    assert df.select(records.rendered(F.col("type"), F.col("payload"))).first()[0] == "command: npm test | outcome: success | exit: 0 | last result: ok"


def test_calendar_zero_fill(spark):
    e = spark.createDataFrame([(NOW - DAY_MS,), (NOW,)], "ms long")
    got = activity.activity(e, "ms", "day", 3, NOW).orderBy("bucket").collect()
    assert [r["n"] for r in got] == [0, 1, 1]
    assert activity.calendar(spark, "week", 500, NOW).count() == 104


def test_health_alerts(spark):
    runs = [("a", NOW - i * 3_600_000, i < 2) for i in range(3)] + [("b", NOW - (20 + i) * DAY_MS, False) for i in range(5)]
    got = rows(activity.run_health(spark.createDataFrame(runs, "source string, ts_ms long, failed boolean"), NOW), "source", "failing", "stalled")
    assert got == [("a", True, False), ("b", False, True)]


def test_latest_before_and_turns(spark):
    calls = spark.createDataFrame([(1, 10, "x"), (1, 20, "y")], "u int, at int, call string")
    res = spark.createDataFrame([(1, 5), (1, 15), (1, 20), (2, 9)], "u int, at int")
    assert [r["latest"] for r in history.latest_before(res, calls, "u", "at", "call").orderBy("u", "at").collect()] == [None, "x", "y", None]
    m = spark.createDataFrame([("c", 1, "user", "q1"), ("c", 2, "assistant", "a1"), ("c", 3, "user", "q2")], "conv_id string, turn int, role string, text string")
    assert rows(history.last_turns(m, 5), "user_text", "assistant_text") == [("q1", "a1")]


def test_ordered_multi_get(spark):
    got = [(r["pos"], r["id"]) for r in history.by_ids(sample(spark), ["c", "zz", "a", "c"]).collect()]
    assert got == [(0, "c"), (2, "a"), (3, "c")]


def test_text_functions(spark):
    df = spark.createDataFrame([("Fix the Redis cache on k8s v1.2.3 with src/app.ts please",)], "t string")
    assert df.select(tx.keywords(F.col("t"))).first()[0] == ["fix", "redis", "cache", "k8s", "v1.2.3", "src/app.ts"]
    df = spark.createDataFrame([('"Config.json".',), ("npm",), ("12",), ("x",)], "t string")
    assert [r[0] for r in df.select(tx.entity(F.col("t"))).collect()] == ["config.json", None, None, None]
    df = spark.createDataFrame([("FOO=1 sudo -E npm run x && ls",), ("git status | cat",)], "t string")
    assert [r[0] for r in df.select(tx.executable(F.col("t"))).collect()] == ["npm", "git"]


def test_edges_and_evaluation(spark):
    old = spark.createDataFrame([("a", "b", "relates_to", 0.5, 2)], "source string, target string, kind string, weight double, reinforcement long")
    new = spark.createDataFrame([("a", "b", "relates_to", 1.5, 1), ("a", "a", "relates_to", 1.0, 1)], "source string, target string, kind string, weight double, reinforcement long")
    assert rows(graph.upsert_edges(old, new), "target", "weight", "reinforcement") == [("b", 1.0, 3)]
    results = spark.createDataFrame([("x", "p", "1"), ("x", "p", "2"), ("y", "p", "2"), ("y", "p", "3")], "arm string, prompt string, id string")
    assert evaluate.overlap(results, "x", "y").first()["jaccard"] == pytest.approx(1 / 3)
    verdicts = spark.createDataFrame([("p", "3", True), ("p", "2", False)], "prompt string, id string, helpful boolean")
    got = {r["arm"]: (r["judged"], r["helpful"], r["discoveries"]) for r in evaluate.arm_metrics(results, verdicts, "x").collect()}
    assert got == {"x": (1, 0, 0), "y": (2, 1, 1)}


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings().using(no_such=1)
    with pytest.raises(ValueError):
        Settings(suppression_mode="maybe")


@pytest.mark.parametrize("tail", [0, 4, writes.TAIL])
def test_ingest_equals_a_sequence(spark, tail):
    """Later new records see those inserted before them; what updates a record is no target itself; copies in the batch."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (70, 3))
    x[50:62:3], x[51:63:3] = x[44], x[5]  # of a new record and of one of the table
    data = [("p" if i % 3 else "q", "command", f"r{i:02d}", i, str(i % 4), x[i].tolist(), i >= 40) for i in range(70)]
    df = spark.createDataFrame(data, "project string, type string, id string, seq long, same_as string, embedding array<double>, fresh boolean").withColumn("deprecated", F.lit(False))
    got = {r["id"]: (r["action"], r["target"]) for r in writes.ingest(df.where("fresh"), df.where("not fresh"), Settings(dedup_threshold=0.9), tail).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pool, expected = list(range(40)), {}
    for i in range(40, 70):
        near = sorted((-round(float(unit[i] @ unit[j]), 12), data[j][2], j) for j in pool if data[j][0] == data[i][0] and unit[i] @ unit[j] >= 0.9)
        if near:
            expected[data[i][2]] = ("skipped" if near[0][2] % 4 == i % 4 else "update", near[0][1])
        else:
            pool.append(i)
            expected[data[i][2]] = ("insert", None)
    assert got == expected and {a for a, _ in got.values()} == {"insert", "update", "skipped"}


def test_co_injection_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(graph, "MEMBERS", 7)
    data = [(s, k, s * 10 + k) for s in range(3) for k in range(40 if s == 0 else 5)]
    df = spark.createDataFrame(data, "session long, k long, at long")
    got = {(r["a"], r["b"]): r["n"] for r in graph.co_injection_edges(df, "session", "k", "at", 1).collect()}
    assert got == {(a, b): 3 if b < 5 else 1 for a in range(40) for b in range(a + 1, 40)}


def test_neighbours_in_groups_of_all_sizes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", 10)
    rng = np.random.default_rng(4)
    data = [(None if i % 9 == 0 else ("hot" if i % 3 else f"g{i}"), f"r{i:02d}", rng.normal(0, 1, 3).tolist()) for i in range(80)]
    df = spark.createDataFrame(data, "project string, id string, embedding array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for _, i, v in data}
    expected = set()
    for p, i, _ in data:
        near = sorted((-float(unit[i] @ unit[j]), j) for q, j, _ in data if p == q and i != j and unit[i] @ unit[j] >= 0.5)[:3]
        expected |= {(i, j) for _, j in near}
    got = vectors.neighbours(df, df, 3, 0.5, same=("project",))
    assert {(r["id"], r["other"]) for r in got.collect()} == expected


def test_context_is_empty_when_nothing_fits(spark):
    data = [("q", 1, "a", "command", "x" * 4000, False), ("q", 2, "b", "error", "short", False), ("r", 1, "c", "warning", "w", True), ("s", 1, "d", "error", "fits", False)]
    df = spark.createDataFrame(data, "query_id string, place int, id string, type string, entry string, deprecated boolean")
    got = {r["query_id"]: (r["context"], r["ids"]) for r in context.assemble(df, Settings(max_tokens=200)).collect()}
    assert got["q"][0] == "" and got["r"][0] == ""
    assert got["s"][0].split("\n")[1:] == ["<prior-knowledge>", "- fits", "</prior-knowledge>"] and got["s"][1] == ["d"]


def test_nearest_rank_equals_sorting(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.integers(0, 5, 700).astype(float).tolist(), "b": [3.0], None: rng.normal(0, 1, 41).tolist()}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "g string, v double")
    for p in (0, 50, 95, 100):
        want = {k: sorted(v)[min(len(v) - 1, int(p / 100 * len(v)))] for k, v in values.items()}
        assert {r["g"]: r["percentile"] for r in activity.nearest_rank(df, "v", p, ["g"]).collect()} == want
