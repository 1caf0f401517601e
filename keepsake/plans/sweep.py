"""Retrieval for many prompts under several settings at once: every step is keyed by (arm, prompt)."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake import records
from keepsake.operators import needles as nd
from keepsake.operators import packing, vectors
from keepsake.runtime import written
from keepsake.settings import Settings

KEY = ["arm", "prompt"]


def under(rows: DataFrame, arms: dict[str, Settings], names: tuple[str, ...]) -> DataFrame:
    """Each row once an arm, with `s`: the arm's values of the named settings. Arms are a handful."""
    each = [F.struct(F.lit(arm).alias("arm"), F.struct(*[F.lit(asdict(s)[n]).alias(n) for n in names]).alias("s")) for arm, s in arms.items()]
    return rows.select("*", F.explode(F.array(*each)).alias("__arm")).select(*rows.columns, "__arm.arm", "__arm.s")


def _first(rows: DataFrame, order: list[Column], most: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def _pool(s: str = "s") -> Column:
    return 3 * F.col(f"{s}.max_records")


def candidates(records_df: DataFrame, prompts: DataFrame, needles: DataFrame, arms: dict[str, Settings]) -> DataFrame:
    """(arm, prompt, id, similarity, keyword_match, score, qualification, near): each arm's best records for each prompt.

    Records like the prompt come from the whole table: the nearest 3 * max_records, cut by least similarity and by least
    semantic score. Records with a needle come from the prompt's project, its ancestors or global scope: of each
    needle the first so many by id, of all of them the best used. Both are scored alike against the prompt; `near` is the plain cosine
    and `qualification` the score as a keyword match.
    """
    live = records_df.where(~F.col("deprecated"))
    widest, least = 3 * max(s.max_records for s in arms.values()), min(s.min_semantic_similarity for s in arms.values())
    facts = live.select("id", F.col("project").alias("__project"), F.col("scope").alias("__scope"), records.usage_ratio(F.col("usage_count"), F.col("retrieval_count")).alias("ratio"))

    like = vectors.neighbours(prompts.select(F.col("prompt").alias("id"), "embedding"), live.select("id", "embedding"), widest, least)
    like = like.select(F.col("id").alias("prompt"), F.col("other").alias("id"), "similarity", "rank")
    names = ("max_records", "min_semantic_similarity", "min_semantic_only_score", "usage_ratio_weight")
    like = under(like.join(facts.select("id", "ratio"), "id"), arms, names)
    enough = (F.col("similarity") >= F.col("s.min_semantic_similarity")) & (F.col("similarity") + F.col("ratio") * F.col("s.usage_ratio_weight") >= F.col("s.min_semantic_only_score"))
    like = like.where((F.col("rank") <= _pool()) & enough).select(*KEY, "id", "similarity", F.lit(False).alias("word"))

    # a prompt's words are looked for in the groups of records it can see; of each word and group only the first records count
    of_project, none = lambda c: F.concat(F.lit("in "), c), F.array().cast("array<string>")
    seen = F.concat(F.array("project"), F.coalesce("ancestors", none))
    groups = F.concat(F.transform(F.array_compact(F.array_distinct(seen)), of_project), F.array(F.lit("global")))
    wanted = needles.groupBy("prompt", "needle").agg(F.min("entity").alias("entity")).join(prompts.select("prompt", groups.alias("groups")), "prompt")
    wanted = written(wanted.select("prompt", "needle", "entity", F.explode("groups").alias("group")), "wanted")
    own = F.array_compact(F.array(of_project(F.col("project")), F.when(F.col("scope") == "global", "global")))
    most = 3 * max(s.max_records for s in arms.values())
    hits = nd.first_matches(live.select("id", F.explode(own).alias("group"), "exact_text"), wanted.select("needle", "group"), most + 1)  # one may be the prompt
    hits = wanted.join(hits, ["needle", "group"]).where(F.col("id") != F.col("prompt")).select("prompt", "needle", "entity", "id").distinct()
    first = F.row_number().over(Window.partitionBy("prompt", "needle").orderBy("id"))
    hits = hits.withColumn("__first", first).where(F.col("__first") <= most).join(facts.select("id", "ratio"), "id")
    hits = under(hits, arms, ("max_records", "enable_entity_keywords")).where((F.col("__first") <= _pool()) & (~F.col("entity") | F.col("s.enable_entity_keywords")))
    hits = hits.groupBy(*KEY, "id").agg(F.first("ratio").alias("ratio"), F.first("s").alias("s"))
    hits = _first(hits, [F.desc("ratio"), F.col("id")], _pool()).select(*KEY, "id", F.lit(0.0).alias("similarity"), F.lit(True).alias("word"))

    both = like.unionByName(hits).groupBy(*KEY, "id").agg(F.max("similarity").alias("__like"), F.max("word").alias("keyword_match"))
    pairs = both.select("prompt", "id").distinct().join(prompts.select("prompt", "project", F.col("embedding").alias("__e")), "prompt").join(live.select("id", "embedding"), "id")
    near = pairs.select("prompt", "id", "project", vectors.cosine(F.col("__e"), F.col("embedding")).alias("near")).join(facts, "id")
    names = ("max_records", "min_semantic_similarity", "semantic_weight", "keyword_bonus", "usage_ratio_weight", "project_match_bonus", "min_score")
    rows = under(near, arms, names).join(both, [*KEY, "id"])
    rows = rows.withColumn("similarity", F.when(F.col("__like") == 0, F.greatest(F.lit(0.0), "near")).otherwise(F.col("__like")))
    score = lambda similarity, word: _unified(similarity, word, F.coalesce(F.col("__project") == F.col("project"), F.lit(False)))
    rows = rows.withColumn("qualification", F.when(F.col("keyword_match"), score(F.col("near"), F.lit(True))))
    rows = rows.withColumn("score", F.greatest(score(F.col("similarity"), F.col("keyword_match")), "qualification")).where(F.col("score") >= F.col("s.min_score"))
    return _first(rows, [F.desc("score"), F.desc("similarity"), F.col("id")], _pool()).select(*KEY, "id", "similarity", "keyword_match", "score", "qualification", "near")


def _unified(similarity: Column, word: Column, in_project: Column) -> Column:
    s = lambda name: F.col(f"s.{name}")
    scale = F.when(s("min_semantic_similarity") > 0, F.least(similarity / s("min_semantic_similarity"), F.lit(1.0))).otherwise(1.0)
    bonus = F.when(word, scale * s("keyword_bonus")).otherwise(0.0)
    return similarity * s("semantic_weight") + bonus + F.col("ratio") * s("usage_ratio_weight") + F.when(in_project, s("project_match_bonus")).otherwise(0.0)


def anchored(found: DataFrame, records_df: DataFrame, prompts: DataFrame, arms: dict[str, Settings]) -> DataFrame:
    """All rows of an arm's prompt where one is near enough to it; else only keyword matches that qualify in its scope."""
    best = F.max(F.greatest(F.col("near"), F.lit(0.0))).over(Window.partitionBy(*KEY))  # at most 3 * max_records rows
    rows = found.withColumn("__best", best).join(records_df.select("id", F.col("project").alias("__project"), "scope"), "id").join(prompts.select("prompt", "project", "ancestors"), "prompt")
    limits = {arm: (s.semantic_anchor_threshold, s.min_score) for arm, s in arms.items()}
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for arm, v in limits.items() for x in (arm, v[i])]), F.col("arm"))
    own = (F.col("__project") == F.col("project")) | F.array_contains(F.coalesce("ancestors", F.array().cast("array<string>")), F.col("__project")) | (F.col("scope") == "global")
    held = (of(0) <= 0) | (F.col("__best") >= of(0)) | (F.col("keyword_match") & (F.col("qualification") >= of(1)) & F.coalesce(own, F.lit(False)))
    return rows.where(held).select(*found.columns)


def expanded(found: DataFrame, edges: DataFrame, records_df: DataFrame, arms: dict[str, Settings]) -> DataFrame:
    """`found` (arm, prompt, id, similarity, score) with parent and hop, and the records that edges lead to.

    A hop takes what room the hops before have left of `max_relation_expansions`, best score first. A step multiplies by
    the edge's weight and the hop's decay; records that are there, missing or deprecated don't count. Rows found over
    edges need `min_expanded_score`.
    """
    names = ("max_relation_hops", "max_relation_expansions", "relation_hop_decay", "enable_entity_edges", "min_expanded_score", "enable_relation_expansion")
    usable = edges.where("weight > 0").select(F.col("source").alias("id"), "target", "weight", "kind")
    active = records_df.where(~F.col("deprecated")).select(F.col("id").alias("target"))
    every = found.select(*KEY, "id", "similarity", "score", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hop"))
    front = found.select(*KEY, "id", F.col("score").alias("root_score"), F.col("similarity").alias("root_similarity"), F.lit(1.0).alias("walked"))
    hops = max([s.max_relation_hops for s in arms.values() if s.enable_relation_expansion], default=0)
    for hop in range(1, hops + 1):
        step = _arm_settings(front, arms, names).join(usable, "id")
        step = step.where(F.col("s.enable_relation_expansion") & (F.col("s.max_relation_hops") >= hop) & (F.col("s.enable_entity_edges") | (F.col("kind") != "shares_entity")))
        step = step.join(active, "target", "left_semi").join(every.select(*KEY, F.col("id").alias("target")), [*KEY, "target"], "left_anti")
        decay = F.pow(F.greatest(F.lit(0.1), F.least(F.lit(1.0), "s.relation_hop_decay")), F.lit(hop))
        step = step.withColumn("walked", F.col("walked") * F.col("weight")).withColumn("score", F.col("root_score") * F.col("walked") * decay).where("score > 0")
        best = F.row_number().over(Window.partitionBy(*KEY, "target").orderBy(F.desc("score"), "id"))
        step = step.withColumn("__r", best).where("__r = 1")
        taken = every.where("hop > 0").groupBy(*KEY).agg(F.count("*").alias("__taken"))
        room = F.col("s.max_relation_expansions") - F.coalesce("__taken", F.lit(0))
        step = _first(step.join(taken, KEY, "left"), [F.desc("score"), F.col("target")], room)
        near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("root_similarity") * F.col("walked") * decay))
        step = written(step.select(*KEY, F.col("target").alias("id"), near.alias("similarity"), "score", F.col("id").alias("parent"), F.lit(hop).alias("hop"), "root_score", "root_similarity", "walked"), "hop")
        every = every.unionByName(step.select(*every.columns))
        front = step.select(*front.columns)
    floor = F.element_at(F.create_map(*[F.lit(x) for arm, s in arms.items() for x in (arm, s.min_expanded_score)]), F.col("arm"))
    return every.where((F.col("hop") == 0) | (floor <= 0) | (F.col("score") >= floor))


def _arm_settings(rows: DataFrame, arms: dict[str, Settings], names: tuple[str, ...]) -> DataFrame:
    """Rows with `s`, the named settings of their own arm."""
    values = F.create_map(*[x for arm, s in arms.items() for x in (F.lit(arm), F.struct(*[F.lit(asdict(s)[n]).alias(n) for n in names]))])
    return rows.withColumn("s", F.element_at(values, F.col("arm")))


def sweep(records_df: DataFrame, edges: DataFrame, prompts: DataFrame, needles: DataFrame, arms: dict[str, Settings]) -> DataFrame:
    """(arm, prompt, place, id, score, similarity, tokens, parent, hop): what each arm would put into each prompt's context.

    `prompts`: prompt, project, ancestors, embedding; `needles`: prompt, needle, entity; `edges`: source, target, kind,
    weight. No record is suppressed, as sessions take no part. A prompt that finds nothing has no rows. A record that is
    the prompt itself (their ids are equal) doesn't find itself.
    """
    found = written(anchored(candidates(records_df, prompts, needles, arms), records_df, prompts, arms), "found")
    both = expanded(found, edges, records_df, arms)
    size = records.tokens(F.col("exact_text")).alias("size")  # of each record once; texts don't go along
    both = _arm_settings(both, arms, ("max_records", "mmr_lambda", "max_tokens")).join(records_df.select("id", size, "embedding"), "id")
    both = both.select(*KEY, "id", "similarity", "score", "parent", "hop", "size", "embedding", "s.max_records", "s.mmr_lambda", "s.max_tokens")
    order = packing.maximal_marginal_relevance(both, "max_records", "mmr_lambda", KEY)
    ranked = order.join(both.drop("embedding"), [*KEY, "id"])
    packed = packing.stop_at_overflow(ranked, F.col("size"), F.col("max_tokens"), [F.col("rank")], KEY)
    return packed.select(*KEY, "place", "id", "score", "similarity", "tokens", "parent", "hop")
