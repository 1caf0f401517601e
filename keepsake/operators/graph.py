"""Connected components and edges between records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.runtime import written

MEMBERS = 1000  # members of one block of a large group


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, cluster): cluster is the smallest id that can be reached over (a, b) edges, read both ways.

    Labels move along edges and jump to their label's label until none changes; each round is written.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("cluster")), "clusters")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("cluster").alias("near"))
        least = labels.join(near, labels["id"] == near["a"]).select("id", F.col("cluster").alias("old"), F.least("cluster", "near").alias("least"))
        tops = labels.select(F.col("id").alias("least"), F.col("cluster").alias("top"))
        labels = written(least.join(tops, "least", "left").select("id", "old", F.least("least", F.coalesce("top", "least")).alias("cluster")), "clusters")
        if labels.where("cluster <> old").isEmpty():
            return labels.select("id", "cluster")
        labels = labels.select("id", "cluster")
    raise RuntimeError("clusters don't settle")


def parts(pairs: DataFrame, a: str, b: str, tail: int) -> DataFrame:
    """(id, part) of all ids in the pairs: their connected component, or one part where there are at most `tail` pairs."""
    if pairs.count() <= tail:
        return pairs.select(F.col(a).alias("id")).union(pairs.select(b)).distinct().withColumn("part", F.lit(""))
    return components(pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))).withColumnRenamed("cluster", "part")


def first_rows(rows: DataFrame, tail: int, *then: str) -> DataFrame:
    """The first `tail` rows of each part by `at` and `then`, without those of a last `at` that they may not hold whole."""
    totals = rows.groupBy("part").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("at", *then))
    first = rows.withColumn("place", place).where(F.col("place") <= tail).join(totals, "part")
    last = F.max("at").over(Window.partitionBy("part"))
    return written(first.withColumn("last", last).where((F.col("total") <= tail) | (F.col("at") < F.col("last"))).drop("total", "place", "last"), "first-rows")


def dealt(rows: DataFrame, tail: int) -> DataFrame:
    """`rows` with `task`: whole parts share tasks, of about `tail` rows each."""
    return rows.withColumn("task", F.pmod(F.xxhash64("part"), F.lit(max(1, -(-rows.count() // tail)))))


def co_injection_edges(events: DataFrame, group: str, member: str, at: str, min_count: int = 3, full: int = 10) -> DataFrame:
    """(a, b, n, last_at, weight): pairs seen in at least `min_count` groups; the weight is n / full, at most 1."""
    rows = events.groupBy(group, member).agg(F.max(at).alias("at"))
    rows = written(rows, "group-members")
    # members of a large group are dealt to blocks, and pairs of blocks to tasks; pairs are counted before they are shuffled
    blocks = written(rows.groupBy(group).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("__k")), "group-blocks")
    dealt = rows.join(blocks, group).withColumn("__own", F.pmod(F.xxhash64(member), F.col("__k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__k") - 1))
    x = dealt.select(group, F.col(member).alias("a"), "at", F.col("__own").alias("__i"), every.alias("__j"))
    y = dealt.select(group, F.col(member).alias("b"), F.col("at").alias("at_b"), F.col("__own").alias("__j"), every.alias("__i"))
    pairs = x.join(y, [group, "__i", "__j"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.max(F.greatest("at", "at_b")).alias("last_at"))
    return pairs.where(F.col("n") >= min_count).withColumn("weight", F.least(F.lit(1.0), F.col("n") / full))


def cap_edges(edges: DataFrame, n: int, kind: str | None = None) -> DataFrame:
    """The n strongest edges of each source: weight, reinforcement, recency, then target; other kinds stay as they are."""
    w = Window.partitionBy("source", "kind").orderBy(F.desc("weight"), F.desc("reinforcement"), F.desc("last_at"), "target")
    ranked = edges.withColumn("__r", F.row_number().over(w))
    keep = F.col("__r") <= n
    return ranked.where(keep if kind is None else keep | (F.col("kind") != kind)).drop("__r")


def upsert_edges(edges: DataFrame, new: DataFrame, mode: str = "max") -> DataFrame:
    """Edges by (source, target, kind): greatest weight and summed reinforcement (`max`), or the new ones (`set`).

    Weights are held in [0, 1]; edges to oneself go.
    """
    keys = ["source", "target", "kind"]
    a = edges.select(*keys, F.col("weight").alias("w0"), F.col("reinforcement").alias("r0"))
    b = new.select(*keys, F.col("weight").alias("w1"), F.col("reinforcement").alias("r1"))
    both = a.join(b, keys, "full").where("source <> target")
    if mode == "set":
        weight, count = F.coalesce("w1", "w0"), F.coalesce("r1", "r0")
    else:
        weight, count = F.greatest("w0", "w1"), F.coalesce("r0", F.lit(0)) + F.coalesce("r1", F.lit(0))
    return both.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)).alias("weight"), count.alias("reinforcement"))


def entity_edges(entities: DataFrame, n_records: int, share: float = 0.1, cap: int = 40, scale: float = 0.4, least: float = 0.1) -> DataFrame:
    """(a, b, weight, shared): records that share rare entities; an entity weighs its clamped idf.

    An entity counts if 2 to min(cap, max(2, share of all records)) records have it, so a group is at most `cap`.
    """
    rows = entities.select("id", "entity").distinct()
    most = min(cap, max(2, int(share * n_records)))
    df = rows.groupBy("entity").agg(F.count("*").alias("df")).where(F.col("df").between(2, most))
    low = F.lit(0.0)
    idf = low if n_records <= 2 else F.when(F.col("df") >= n_records, 0.0).otherwise(F.greatest(low, F.least(F.lit(1.0), F.ln(F.lit(float(n_records)) / F.col("df")) / F.ln(F.lit(n_records / 2)))))
    held = rows.join(df.withColumn("idf", idf), "entity")
    pairs = held.select("entity", F.col("id").alias("a"), "idf").join(held.select("entity", F.col("id").alias("b")), "entity").where("a < b")
    found = pairs.groupBy("a", "b").agg(F.least(F.lit(1.0), F.lit(scale) * F.sum("idf")).alias("weight"), F.count("*").alias("shared"))
    return found.where(F.col("weight") >= least)


def expand(results: DataFrame, edges: DataFrame, records: DataFrame, hops: int = 1, most: int = 5, decay: float = 0.6, entity_edges: bool = False) -> DataFrame:
    """(id, score, similarity, parent, hop) of records reached from `results` (id, score, similarity) over edges.

    A step multiplies by the edge's weight and the hop's decay. Known, missing and deprecated targets don't count;
    a target keeps its best score; the best `most` (score, then id) are taken over all hops together.
    """
    decay = min(1.0, max(0.1, decay))
    usable = edges.where("weight > 0") if entity_edges else edges.where("weight > 0 and kind <> 'shares_entity'")
    active = records.where(~F.col("deprecated")).select(F.col("id").alias("target"))
    known = results.select(F.col("id").alias("target"))
    front = results.select("id", F.col("score").alias("root_score"), F.col("similarity").alias("root_similarity"), F.lit(1.0).alias("walked"))
    kept: DataFrame | None = None
    for hop in range(1, hops + 1):
        step = front.join(usable.select(F.col("source").alias("id"), "target", "weight"), "id").join(active, "target", "left_semi").join(known, "target", "left_anti")
        step = step.withColumn("walked", F.col("walked") * F.col("weight"))
        factor = F.col("walked") * F.lit(decay**hop)
        step = step.select(
            F.col("target").alias("id"), (F.col("root_score") * factor).alias("score"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("root_similarity") * factor)).alias("similarity"),
            F.col("id").alias("parent"), F.lit(hop).alias("hop"), "root_score", "root_similarity", "walked",
        )
        best = Window.partitionBy("id").orderBy(F.desc("score"), "parent")
        step = step.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
        kept = step if kept is None else kept.unionByName(step)
        best = Window.partitionBy("id").orderBy(F.desc("score"), "hop")
        kept = kept.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r").orderBy(F.desc("score"), "id").limit(most)
        front = kept.where(F.col("hop") == hop).select("id", "root_score", "root_similarity", "walked")
    return kept.select("id", "score", "similarity", "parent", "hop") if kept is not None else results.select("id", "score", "similarity", F.lit("").alias("parent"), F.lit(0).alias("hop")).limit(0)


def discovered(events: DataFrame, live: DataFrame, group: str, member: str, at: str, now: int, days: int, min_count: int = 3) -> DataFrame:
    """(source, target, weight, reinforcement): both directions of pairs seen together in the last `days`, between ids of `live`."""
    recent = events.where((F.col(at) >= now - days * 86_400_000) & (F.col(at) <= now))
    ids = live.select(F.col(member)).distinct()
    pairs = co_injection_edges(recent.join(ids, member, "left_semi"), group, member, at, min_count).select("a", "b", "weight", "n")
    both = pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), "weight", F.col("n").alias("reinforcement"))
    return both.unionByName(pairs.select(F.col("b").alias("source"), F.col("a").alias("target"), "weight", F.col("n").alias("reinforcement")))


def unrelated(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) without an edge of any kind in either direction."""
    had = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.join(had, ["a", "b"], "left_anti")
