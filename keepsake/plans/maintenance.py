"""Maintenance operations: each turns records into actions (id, action, reason); a run unites them and can apply them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators import clusters, graph, mutate, scans
from keepsake.runtime import written
from keepsake.settings import Settings

Operation = Callable[[DataFrame, Settings, int], DataFrame]


def _deprecate(df: DataFrame, reason: str) -> DataFrame:
    return df.select("id", F.lit("deprecate").alias("action"), F.lit(reason).alias("reason"))


def stale(df: DataFrame, s: Settings, now: int) -> DataFrame:
    return _deprecate(scans.stale(df, s, now), "stale")


def low_usage(df: DataFrame, s: Settings, now: int) -> DataFrame:
    return _deprecate(scans.low_usage(df, s), "low-usage")


def zero_usage(df: DataFrame, s: Settings, now: int) -> DataFrame:
    return _deprecate(scans.zero_usage(df, s), "zero-usage")


def stale_unused(df: DataFrame, s: Settings, now: int) -> DataFrame:
    return _deprecate(scans.stale_unused(df, s, now), "stale-unused")


def promotion(df: DataFrame, s: Settings, now: int) -> DataFrame:
    return scans.promotion_candidates(df, s, now).select("id", F.lit("promote").alias("action"), F.lit("useful in its project").alias("reason"))


def consolidation(df: DataFrame, s: Settings, now: int) -> DataFrame:
    live = df.where(scans.active())
    found = clusters.capped(clusters.similarity_clusters(live, s), s.consolidation_max_cluster_size)
    return clusters.merged(found, live)[1].select("id", F.lit("deprecate").alias("action"), "reason")


OPERATIONS: dict[str, Operation] = {
    "stale": stale, "low-usage": low_usage, "zero-usage": zero_usage, "stale-unused": stale_unused, "promotion": promotion, "consolidation": consolidation,
}


def actions(df: DataFrame, names: list[str], s: Settings, now: int) -> DataFrame:
    """(operation, id, action, reason) of the named operations, in the order of their names."""
    if unknown := [n for n in names if n not in OPERATIONS]:
        raise ValueError(f"no such operation: {unknown}")
    parts = [OPERATIONS[n](df, s, now).select(F.lit(n).alias("operation"), "id", "action", "reason") for n in names]
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Inputs:
    """What some operations need beside the records: events (session, id, ts_ms), entities (id, entity), edges (source,
    target), commands' validity (id, valid, reason), and reasons of the quality scan (id, reason)."""

    events: DataFrame | None = None
    entities: DataFrame | None = None
    edges: DataFrame | None = None
    validity: DataFrame | None = None
    quality: DataFrame | None = None
    options: dict[str, int] = field(default_factory=dict)


def _review(rows: DataFrame, action: str) -> DataFrame:
    """Members of clusters, for a later decision."""
    return rows.select("id", F.lit(action).alias("action"), F.concat(F.lit("cluster:"), F.col("cluster")).alias("reason"))


def _needed(rows: DataFrame | None, name: str) -> DataFrame:
    if rows is None:
        raise ValueError(f"the operation needs {name}")
    return rows


def cross_type(df: DataFrame, s: Settings, now: int, more: Inputs) -> DataFrame:
    live = df.where(scans.active())
    found = clusters.capped(clusters.similarity_clusters(live, s, cross_type=True), s.consolidation_max_cluster_size, cross_type=True)
    return clusters.merged(found, live, "cross-type-consolidation")[1].select("id", F.lit("deprecate").alias("action"), "reason")


def conflicts(df: DataFrame, s: Settings, now: int, more: Inputs) -> DataFrame:
    return clusters.conflict_pairs(df.where(scans.active()), s).select(F.col("a").alias("id"), F.lit("compare").alias("action"), F.concat(F.lit("conflict:"), "b").alias("reason"))


def currentness(df: DataFrame, s: Settings, now: int, more: Inputs) -> DataFrame:
    return _review(clusters.currentness_clusters(df, s, df.where(scans.active() & (F.col("type") == "discovery"))), "review-currentness")


def warnings(df: DataFrame, s: Settings, now: int, more: Inputs) -> DataFrame:
    seeds = df.where(scans.active() & F.col("type").isin("command", "error") & (F.col("failure_count") >= s.warning_min_failures))
    return _review(clusters.warning_clusters(df, s, seeds), "synthesise-warning")


def _link(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.select(F.col("source").alias("id"), F.lit(f"link:{kind}").alias("action"), F.col("target").alias("reason"))


def relations(df: DataFrame, s: Settings, now: int, more: Inputs) -> DataFrame:
    found = graph.discovered(_needed(more.events, "events"), df.where(scans.active()), "session", "id", "ts_ms", now, s.relation_days)
    return _link(found, "relates_to")


def entity_overlap(df: DataFrame, s: Settings, now: int, more: Inputs) -> DataFrame:
    live = df.where(scans.active()).select("id")
    rows = _needed(more.entities, "entities").join(live, "id", "left_semi")
    pairs = graph.entity_edges(rows, live.count())
    if more.edges is not None:
        pairs = graph.unrelated(pairs, more.edges)
    return _link(pairs.select(F.col("a").alias("source"), F.col("b").alias("target")), "shares_entity")


def quality(df: DataFrame, s: Settings, now: int, more: Inputs) -> DataFrame:
    found = _needed(more.quality, "quality").where("reason is not null").join(df.where(scans.active()).select("id"), "id", "left_semi")
    return found.select("id", F.lit("deprecate").alias("action"), "reason")


def validity(df: DataFrame, s: Settings, now: int, more: Inputs) -> DataFrame:
    found = _needed(more.validity, "validity").where("not valid").join(df.where(scans.active()).select("id"), "id", "left_semi")
    return found.select("id", F.lit("deprecate").alias("action"), "reason")


def documentation(df: DataFrame, s: Settings, now: int, more: Inputs) -> DataFrame:
    return scans.documentation_candidates(df).select("id", F.lit("document").alias("action"), F.col("project").alias("reason"))


FURTHER: dict[str, Callable[[DataFrame, Settings, int, Inputs], DataFrame]] = {
    "cross-type-consolidation": cross_type, "conflicts": conflicts, "currentness": currentness, "quality": quality, "validity": validity,
    "relations": relations, "entity-overlap": entity_overlap, "warnings": warnings, "documentation": documentation,
}
REPORT = "operation string, dry_run boolean, actions long, duration_ms long, error string"


def run_all(df: DataFrame, s: Settings, now: int, names: list[str] | None = None, more: Inputs | None = None, dry_run: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, actions, report): all operations (or the named ones), each on the records as they are at the start.

    Each operation's actions are written before the next begins; one that fails has its error in the report, no actions,
    and stops no other. `report`: operation, dry_run, actions, duration_ms, error. In a dry run the table stays as it is.
    """
    spark, more = df.sparkSession, more or Inputs()
    names = [*OPERATIONS, *FURTHER] if names is None else names
    found, report = [], []
    for name in names:  # a dozen or so
        began, n, error = time.monotonic(), 0, None
        try:
            if name not in OPERATIONS and name not in FURTHER:
                raise ValueError(f"no such operation: {name}")
            rows = OPERATIONS[name](df, s, now) if name in OPERATIONS else FURTHER[name](df, s, now, more)
            rows = written(rows.select(F.lit(name).alias("operation"), "id", "action", "reason"), "actions")
            n = rows.count()
            found.append(rows)
        except Exception as e:  # whatever an operation raises is its own result
            error = str(e).split("\n")[0][:500]
        report.append((name, dry_run, n, int(1000 * (time.monotonic() - began)), error))
    every = reduce(DataFrame.unionByName, found, spark.createDataFrame([], "operation string, id string, action string, reason string"))
    return df if dry_run else apply(df, every, now), every, spark.createDataFrame(report, REPORT)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("operation", "action").agg(F.count("*").alias("n"))


def apply(df: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """The table after the actions; of several reasons to deprecate a record the first operation's counts."""
    reasons = mutate.first_by(found.where("action = 'deprecate'"), ["id"], [F.col("operation"), F.col("reason")])
    marked = mutate.soft_delete(df, reasons.select("id", "reason", F.lit(None).cast("string").alias("superseding")), now)
    return mutate.promote(marked, found.where("action = 'promote'").select("id").distinct())
