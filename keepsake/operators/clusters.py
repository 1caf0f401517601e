"""Clusters of similar records, their keepers, merges, conflicts and greedy star clusters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.operators import graph, mutate, vectors
from keepsake.runtime import written
from keepsake.settings import DAY_MS, Settings

TAIL = 20_000  # open rows of star clusters that one task settles
TYPE_PRIORITY = {"procedure": 4, "warning": 3, "error": 2, "discovery": 1, "command": 0}


def similarity_clusters(df: DataFrame, s: Settings, cross_type: bool = False, seeds: DataFrame | None = None) -> DataFrame:
    """(cluster, id, similarity, type): components over each seed's nearest rows of the same (or another) type.

    `seeds` (all rows if not given) are those due for a check; their similarity is 1, that of other members the best
    they have with a seed. Cross-type clusters hold two types.
    """
    threshold = s.cross_type_threshold if cross_type else s.consolidation_threshold
    seeds = df if seeds is None else seeds
    near = vectors.neighbours(seeds, df, s.consolidation_search_limit, threshold, same=() if cross_type else ("type",), differ="type" if cross_type else None)
    edges = written(near.select(F.col("id").alias("a"), F.col("other").alias("b"), "similarity"), "similar")
    labels = graph.components(edges)
    best = edges.groupBy(F.col("b").alias("id")).agg(F.max("similarity").alias("best"))
    mine = seeds.select("id", F.lit(1.0).alias("own"))
    rows = labels.join(best, "id", "left").join(mine, "id", "left").join(df.select("id", "type"), "id")
    rows = rows.withColumn("similarity", F.coalesce("own", "best"))
    if cross_type:
        mixed = rows.groupBy("cluster").agg(F.countDistinct("type").alias("n")).where("n > 1")
        rows = rows.join(mixed, "cluster", "left_semi")
    return rows.select("cluster", "id", "similarity", "type")


def capped(clusters: DataFrame, most: int, cross_type: bool = False) -> DataFrame:
    """The `most` best members of each cluster; a cross-type cluster left with one type swaps its last member for the
    best one of another type."""
    order = [F.desc("similarity"), "id"]
    rows = clusters.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(*order)))
    if not cross_type:
        return rows.where(F.col("place") <= most)
    whole = Window.partitionBy("cluster")
    lead_type = F.first("type").over(Window.partitionBy("cluster").orderBy("place"))
    rows = rows.withColumn("__lead", lead_type)
    rows = rows.withColumn("__other", F.min(F.when(F.col("type") != F.col("__lead"), F.col("place"))).over(whole))
    inside = F.coalesce(F.col("__other") <= most, F.lit(True))
    keep = (inside & (F.col("place") <= most)) | (~inside & ((F.col("place") < most) | (F.col("place") == F.col("__other"))))
    return rows.where(keep).drop("__lead", "__other")


def keepers(clusters: DataFrame, df: DataFrame, order: Iterable[Column] | None = None) -> DataFrame:
    """(cluster, id, keeper): success, last use and time decide, then the id."""
    order = list(order or [F.desc("success_count"), F.desc("last_used"), F.desc("ts_ms")])
    rows = clusters.select("cluster", "id").join(df, "id")
    # the first of each cluster is found before rows are shuffled, so no task holds a whole cluster
    first = mutate.first_by(rows, ["cluster"], [*order, F.col("id")]).select("cluster", F.col("id").alias("keeper"))
    return rows.select("cluster", "id").join(first, "cluster")


def fallback_order() -> list[Column]:
    """Type priority, uncapped usage ratio, usage, success, last use, time."""
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_PRIORITY.items() for x in kv])[F.col("type")], F.lit(-1))
    ratio = F.when(F.col("retrieval_count") > 0, F.col("usage_count") / F.col("retrieval_count")).otherwise(F.col("usage_count").cast("double"))
    return [F.desc(x) for x in (priority, ratio, F.col("usage_count"), F.col("success_count"), F.col("last_used"), F.col("ts_ms"))]


def merged(clusters: DataFrame, df: DataFrame, prefix: str = "consolidation") -> tuple[DataFrame, DataFrame]:
    """(keepers with summed counters, actions (id, reason, superseding) for the others)."""
    chosen = written(keepers(clusters, df), "keepers")
    sums = chosen.join(df, "id").groupBy("keeper").agg(
        *[F.sum(c).alias(c) for c in ("success_count", "failure_count", "retrieval_count", "usage_count")],
        F.max("last_used").alias("last_used"), F.count("*").alias("members"),
    )
    reason = F.concat(F.lit(f"{prefix}:merged-into:"), F.col("keeper"))
    actions = chosen.where("id <> keeper").select("id", reason.alias("reason"), F.col("keeper").alias("superseding"))
    return sums, actions


def first_group_wins(groups: DataFrame) -> DataFrame:
    """(group_no, keeper, id): merge groups without self merges and repeats; a contested id goes to its first group."""
    rows = groups.where("id <> keeper").dropDuplicates(["group_no", "id"])
    w = Window.partitionBy("id").orderBy("group_no")
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def verdict_key(policy: str, mode: Column, members: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(policy), mode, F.array_join(F.array_sort(members), ",")), 256)


def unsettled(clusters: DataFrame, verdicts: DataFrame, s: Settings, now: int) -> DataFrame:
    """Clusters (key, content_hash, ...) without a no-merge verdict on the same content within the backoff."""
    fresh = verdicts.where(F.col("checked_at") > now - s.no_merge_backoff_days * DAY_MS)
    return clusters.join(fresh.select("key", "content_hash"), ["key", "content_hash"], "left_anti")


def conflict_pairs(df: DataFrame, s: Settings) -> DataFrame:
    """(a, b, similarity): near rows of one project and type, each unordered pair once."""
    near = vectors.neighbours(df, df, s.conflict_limit, s.conflict_threshold, same=("project", "type"))
    pair = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "similarity")
    return pair.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def settled_verdict(verdict: Column, candidate_ms: Column, existing_ms: Column) -> Column:
    """An older candidate can't deprecate what came after it: both stay."""
    return F.when((verdict == "deprecate_existing") & (candidate_ms < existing_ms), "keep_both").otherwise(verdict)


def star_clusters(
    seeds: DataFrame, pool: DataFrame, threshold: float, most: int, near: int, by: list[str], member: Column | None = None,
    alone_is_used: bool = False, tail: int = TAIL,
) -> DataFrame:
    """(cluster, id): in (ts_ms, id) order an unused seed makes a cluster of itself and its unused near rows.

    A seed looks at its `near` nearest rows of the pool (equal in `by`) at or above the threshold, keeps those that are
    a `member`, and takes up to most - 1 unused ones. A seed that takes none is a cluster of its own; it stays free for
    a later seed (and then is no cluster any more) unless `alone_is_used`.

    The nearest rows come from cells of bounded size; `greedy_stars` settles who takes whom.
    """
    found = vectors.neighbours(seeds, pool, near, threshold, same=tuple(by)).select("id", "other", "rank")
    if member is not None:
        found = found.join(pool.where(member).select(F.col("id").alias("other")), "other", "left_semi")
    at = seeds.select("id", F.struct("ts_ms", "id").alias("at"))
    return greedy_stars(found, at, most, alone_is_used, tail)


def greedy_stars(listed: DataFrame, seeds: DataFrame, most: int, alone_is_used: bool = False, tail: int = TAIL) -> DataFrame:
    """(cluster, id) as in `star_clusters`. `listed`: id, other, rank of what each seed may take; `seeds`: id, at (their order).

    What one seed takes matters only to seeds of its connected component. A round settles the first `tail` open rows of
    each component in their order, many small components to a task, and then, where a component has more, every seed that is
    the first open one to touch itself and each row it lists. So a component of n rows takes at most n / tail rounds however
    long its chains are, and fewer where many seeds don't wait for each other. With `tail` 0 only the second step is taken.
    """
    pairs = written(listed, "star-pairs")
    waiting = written(seeds.select("id", "at"), "star-seeds")
    parts = graph.parts(pairs, "id", "other", tail)
    taken, alone = [], [waiting.join(parts, "id", "left_anti").select("id")]
    waiting = written(waiting.join(parts, "id"), "star-seeds")
    while not pairs.isEmpty():
        if tail:
            first = graph.first_rows(waiting.join(pairs, "id", "left"), tail, "rank")
            got = _settled(first, most, alone_is_used, tail)
            heads = got.where("cluster = id").select("id")
            members = got.where("cluster <> id")
            used = members.select("id").unionByName(heads if alone_is_used else members.select(F.col("cluster").alias("id"))).distinct()
            taken.append(members)
            alone.append(heads)
            waiting, pairs = _without(waiting, pairs, first.select("id").distinct(), used)
            if pairs.isEmpty():
                break
        touch = waiting.join(pairs, "id").select("id", "other", "at").unionByName(waiting.select("id", F.col("id").alias("other"), "at"))
        earliest = written(touch.groupBy("other").agg(F.min("at").alias("first")), "star-first")
        waits = touch.join(earliest, "other").where("at <> first").select("id").distinct()
        ready = written(waiting.join(waits, "id", "left_anti").select("id"), "star-ready")
        place = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
        got = pairs.join(ready, "id", "left_semi").withColumn("place", place).where(F.col("place") < most)
        got = written(got.select(F.col("id").alias("cluster"), F.col("other").alias("id")), "star-members")
        heads = got.select(F.col("cluster").alias("id")).distinct()
        taken.append(got)
        alone.append(ready)
        used = written(got.select("id").unionByName(ready if alone_is_used else heads).distinct(), "star-used")
        waiting, pairs = _without(waiting, pairs, ready, used)
    alone.append(waiting.select("id"))
    members = pairs.select(F.col("id").alias("cluster"), F.col("other").alias("id")).where(F.lit(False))
    members = written(reduce(DataFrame.unionByName, taken, members), "star-all")
    heads = members.select(F.col("cluster").alias("id")).distinct()
    lone = reduce(DataFrame.unionByName, alone).distinct()
    lone = lone.join(members.select("id"), "id", "left_anti").join(heads, "id", "left_anti").unionByName(heads)
    return members.unionByName(lone.select(F.col("id").alias("cluster"), "id"))


def _settled(rows: DataFrame, most: int, alone_is_used: bool, tail: int) -> DataFrame:
    """(cluster, id): whom the seeds of `rows` take one after the other, each open seed itself too; whole parts share tasks."""

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts_ms", "id", "rank"])
        used: set[str] = set()
        out = []
        for (_, seed), others in part.groupby(["ts_ms", "id"], sort=True)["other"]:
            if seed in used:
                continue
            members = [x for x in others.dropna() if x not in used][: most - 1]
            used.update(members)
            if members or alone_is_used:
                used.add(seed)
            out += [(seed, x) for x in [*members, seed]]
        return pd.DataFrame(out, columns=["cluster", "id"])

    dealt = graph.dealt(rows, tail).select("id", F.col("at.ts_ms").alias("ts_ms"), "other", "rank", "task")
    return written(dealt.groupBy("task").applyInPandas(settle, "cluster string, id string"), "star-settled")


def _without(waiting: DataFrame, pairs: DataFrame, done: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The seeds that still wait, and what they list that is still free."""
    waiting = written(waiting.join(done, "id", "left_anti").join(used, "id", "left_anti"), "star-seeds")
    pairs = pairs.join(waiting, "id", "left_semi").join(used.select(F.col("id").alias("other")), "other", "left_anti")
    return waiting, written(pairs.select("id", "other", "rank"), "star-pairs")


def currentness_clusters(df: DataFrame, s: Settings, seeds: DataFrame) -> DataFrame:
    """(cluster, id) of a project's active discoveries, from the `seeds` due for a check."""
    return star_clusters(seeds, df, s.currentness_threshold, s.currentness_max_cluster_size, s.currentness_search_limit, ["project"])


def warning_clusters(df: DataFrame, s: Settings, seeds: DataFrame) -> DataFrame:
    """(cluster, id, failures): from due commands and errors that failed often; of a seed's nearest rows of its project
    and type those that failed often too. `failures` is the cluster's sum, by which clusters are taken, most first."""
    often = F.col("failure_count") >= s.warning_min_failures
    found = star_clusters(seeds.where(often), df, s.warning_threshold, s.warning_limit + 1, s.warning_limit, ["project", "type"], often, True)
    rows = written(found.join(df.select("id", "failure_count"), "id"), "warning-clusters")
    sums = rows.groupBy("cluster").agg(F.sum("failure_count").alias("failures"))
    return rows.join(sums, "cluster").select("cluster", "id", "failures")


def duplicate_warnings(new: DataFrame, df: DataFrame, s: Settings) -> DataFrame:
    """(id, other, similarity): of each new warning the nearest active one of its project or of global scope, if near enough."""
    old = df.where((F.col("type") == "warning") & ~F.col("deprecated"))
    near = vectors.neighbours(new, old, 1, s.warning_dedup_threshold, same=("project",), or_global="pool")
    return near.select("id", "other", "similarity")
