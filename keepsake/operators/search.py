"""Keyword, hybrid and scoped search with score parts and near misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake import filters, records
from keepsake.operators import vectors
from keepsake.settings import Settings


def keyword_rows(df: DataFrame, needles: list[str], limit: int, text: str = "exact_text") -> DataFrame:
    """Ids by needles, interleaved: the first row of each needle, the second of each, ... without repeats, `limit` in all.

    A needle gives at most ceil(limit / needles) rows in id order, so a broad one can't starve a rare one.
    """
    wanted = [n for n in needles if n.strip()]
    if not wanted:
        return df.select("id", F.lit(0).alias("needle"), F.lit(1).alias("place")).orderBy("id").limit(limit)
    per = max(1, -(-limit // len(wanted)))
    hits = F.array(*[F.when(F.lower(F.col(text)).contains(F.lower(F.lit(n))), F.lit(i)) for i, n in enumerate(wanted)])
    rows = df.select("id", F.explode(F.array_compact(hits)).alias("needle"))
    w = Window.partitionBy("needle").orderBy("id")
    rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per)
    first = rows.groupBy("id").agg(F.min(F.struct("place", "needle")).alias("x")).select("id", "x.needle", "x.place")
    return first.orderBy("place", "needle", "id").limit(limit)


def hybrid(
    df: DataFrame, vector: list[float], needles: list[str], s: Settings, limit: int = 10, keyword_weight: float = 0.3,
    vector_weight: float = 0.7, where=None, cut: bool = True,
) -> DataFrame:
    """id, similarity, keyword_match, score: keyword rows and vector rows by id, scored, cut and ranked.

    A keyword row whose similarity is below the minimum keeps 0. `min_score` only cuts where vectors have a weight.
    """
    rows = df if where is None else df.where(where)
    by_vector = vectors.top_k(rows, vector, limit, s.min_semantic_similarity).select("id", "similarity") if vector_weight > 0 else rows.select("id", F.lit(0.0).alias("similarity")).limit(0)
    by_word = keyword_rows(rows, needles, limit).select("id", F.lit(True).alias("word"))
    both = by_vector.join(by_word, "id", "full")
    both = both.select("id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("word", F.lit(False)).alias("keyword_match"))
    counts = rows.select("id", "usage_count", "retrieval_count")
    found = both.join(counts, "id").withColumn(
        "score",
        F.when(F.col("keyword_match"), F.lit(keyword_weight)).otherwise(0.0) + F.col("similarity") * vector_weight
        + records.usage_ratio(F.col("usage_count"), F.col("retrieval_count")) * s.usage_ratio_weight,
    ).select("id", "similarity", "keyword_match", "score")
    if not cut:
        return found
    if vector_weight > 0:
        found = found.where(F.col("score") >= s.min_score)
    return found.orderBy(F.desc("score"), F.desc("similarity"), "id").limit(limit)


def near_misses(df: DataFrame, vector: list[float], s: Settings, limit: int = 10, vector_weight: float = 0.7) -> DataFrame:
    """Rows of the widened search that fall short: id, reason, threshold, actual, gap."""
    wide = max(3 * limit, limit + 20)
    rows = vectors.top_k(df, vector, wide).select("id", "similarity", "usage_count", "retrieval_count")
    score = F.col("similarity") * vector_weight + records.usage_ratio(F.col("usage_count"), F.col("retrieval_count")) * s.usage_ratio_weight
    reason = lambda name, least, got: F.struct(F.lit(name).alias("reason"), F.lit(least).alias("threshold"), got.alias("actual"))
    far = F.col("similarity") < s.min_semantic_similarity
    low = ~far & (F.col("score") < s.min_score)
    found = rows.withColumn("score", score).select(
        "id",
        F.explode(F.array_compact(F.array(
            F.when(far, reason("similarity_below_threshold", s.min_semantic_similarity, F.col("similarity"))),
            F.when(low, reason("score_below_threshold", s.min_score, F.col("score"))),
        ))).alias("x"),
    )
    return found.select("id", "x.reason", "x.threshold", "x.actual", (F.col("x.threshold") - F.col("x.actual")).alias("gap"))


def unified_parts(similarity, keyword, ratio, in_project, s: Settings) -> dict[str, F.Column]:
    """The four parts of the unified score; the keyword bonus grows with similarity up to the minimum."""
    scale = F.least(similarity / s.min_semantic_similarity, F.lit(1.0)) if s.min_semantic_similarity > 0 else F.lit(1.0)
    return {
        "semantic": similarity * s.semantic_weight,
        "keyword_bonus": F.when(keyword, scale * s.keyword_bonus).otherwise(0.0),
        "usage": ratio * s.usage_ratio_weight,
        "project_boost": F.when(in_project, F.lit(s.project_match_bonus)).otherwise(0.0),
    }


def two_scope(df: DataFrame, vector: list[float], needles: list[str], project: str, s: Settings) -> DataFrame:
    """Keyword rows of the project (or global) and semantic rows of any project, merged by id and scored alike."""
    pool = 3 * s.max_records
    active = df.where(~F.col("deprecated"))
    words = keyword_rows(active.where(filters.scope_filter(project, with_global=True)), needles, pool).select("id", F.lit(True).alias("word"), F.lit(0.0).alias("similarity"))
    meaning = vectors.top_k(active, vector, pool, s.min_semantic_only_score).select("id", F.lit(False).alias("word"), "similarity")
    both = words.unionByName(meaning).groupBy("id").agg(F.max("word").alias("keyword_match"), F.max("similarity").alias("near"))
    both = both.join(active, "id").withColumn("similarity", F.greatest("near", F.when(F.col("keyword_match"), vectors.cosine_to(vector)).otherwise(0.0)))
    parts = unified_parts(F.col("similarity"), F.col("keyword_match"), records.usage_ratio(F.col("usage_count"), F.col("retrieval_count")), F.col("project") == project, s)
    found = both.select("id", "similarity", "keyword_match", *[c.alias(n) for n, c in parts.items()])
    found = found.withColumn("score", sum((F.col(n) for n in parts), F.lit(0.0))).where(F.col("score") >= s.min_score)
    return found.orderBy(F.desc("score"), F.desc("similarity"), "id").limit(pool)


def anchored(found: DataFrame, records_df: DataFrame, project: str, s: Settings) -> DataFrame:
    """All rows where the best similarity reaches the anchor; else only keyword rows of the project or global scope."""
    best = found.agg(F.max("similarity").alias("best"))
    rows = found.join(records_df.select("id", "project", "scope"), "id").join(F.broadcast(best))
    word = F.col("keyword_match") & (F.col("score") >= s.min_score) & ((F.col("project") == project) | (F.col("scope") == "global"))
    return rows.where((F.col("best") >= s.semantic_anchor_threshold) | word).select(*found.columns)


def suppressed(found: DataFrame, recent: DataFrame, s: Settings) -> DataFrame:
    """Recently injected ids: removed (`hard`), or their score cut by the penalty (`soft`); original_score tells."""
    if s.suppression_mode == "hard":
        return found.join(recent.select("id"), "id", "left_anti").withColumn("original_score", F.col("score"))
    marked = found.join(recent.select("id", F.lit(True).alias("seen")), "id", "left")
    score = F.when(F.col("seen"), F.col("score") * (1 - s.suppression_penalty)).otherwise(F.col("score"))
    return marked.withColumn("original_score", F.col("score")).withColumn("score", score).drop("seen")


def topic_shift(prompts: DataFrame, s: Settings) -> DataFrame:
    """session, seq, similarity with the session's previous prompt, and whether the topic changed."""
    before = F.lag("embedding").over(Window.partitionBy("session").orderBy("seq"))
    rows = prompts.withColumn("__before", before).where("__before is not null")
    rows = rows.withColumn("similarity", vectors.cosine(F.col("embedding"), F.col("__before")))
    return rows.select("session", "seq", "similarity", (F.col("similarity") < s.topic_change_threshold).alias("changed"))


def qualified(found: DataFrame, raw: DataFrame, df: DataFrame, vector: list[float] | None, project: str, s: Settings) -> DataFrame:
    """`found` with raw_match, qualification (null without a raw match), and similarity and score lifted by it.

    `raw`: (id, score) of the records that hold the prompt's own needles. With the prompt's vector a raw match is scored
    again against it, as a keyword match; without one its own score counts.
    """
    more = df.select("id", "project", "embedding", "usage_count", "retrieval_count")
    rows = found.join(raw.select("id", F.col("score").alias("__raw")), "id", "left").join(more, "id")
    rows = rows.withColumn("raw_match", F.col("__raw").isNotNull())
    if vector:
        near = vectors.cosine_to(vector)
        ratio = records.usage_ratio(F.col("usage_count"), F.col("retrieval_count"))
        total = sum(unified_parts(near, F.lit(True), ratio, F.coalesce(F.col("project") == project, F.lit(False)), s).values(), F.lit(0.0))
        rows = rows.withColumn("similarity", F.when(F.col("raw_match"), F.greatest("similarity", near)).otherwise(F.col("similarity")))
    else:
        total = F.col("__raw")
    rows = rows.withColumn("qualification", F.when(F.col("raw_match"), total)).withColumn("score", F.greatest("score", "qualification"))
    return rows.select(*found.columns, "raw_match", "qualification")


def raw_anchored(found: DataFrame, df: DataFrame, vector: list[float] | None, project: str, s: Settings, ancestors: list[str] | None = None) -> DataFrame:
    """All rows of `qualified` where the prompt's own vector comes near enough to one of them; else only raw keyword
    matches that qualify, of the project, an ancestor of it, or global scope. `anchor` is the greatest similarity."""
    rows = found.join(df.select("id", "project", "scope", "embedding"), "id")
    near = vectors.cosine_to(vector) if vector else F.lit(0.0)
    rows = rows.withColumn("anchor", F.max(F.greatest(near, F.lit(0.0))).over(Window.partitionBy(F.lit(0))))  # a pool of bounded size
    own = (F.col("project") == project) | F.col("project").isin(ancestors or []) | (F.col("scope") == "global")
    keeps = F.col("raw_match") & (F.col("qualification") >= s.min_score) & F.coalesce(own, F.lit(False))
    held = (F.lit(bool(vector)) & (F.col("anchor") >= s.semantic_anchor_threshold)) | keeps
    return rows.where(held).select(*found.columns, "anchor")


def tool_search(df: DataFrame, vector: list[float], needles: list[str], s: Settings, limit: int = 10) -> DataFrame:
    """Keyword weight 1; vector weight 1 with a vector, else 0; similarity and score to three places."""
    found = hybrid(df, vector, needles, s, limit, 1.0, 1.0 if vector else 0.0, ~F.col("deprecated"))
    return found.select("id", F.round("similarity", 3).alias("similarity"), "keyword_match", F.round("score", 3).alias("score"))


def chat_search(df: DataFrame, vector: list[float], s: Settings, offset: int, limit: int) -> DataFrame:
    """A page of the plain similarity order, without a least score and without usage."""
    found = vectors.top_k(df.where(~F.col("deprecated")), vector, offset + limit)
    return found.orderBy(F.desc("similarity"), "id").offset(offset).limit(limit).select("id", "similarity")


def paged_search(df: DataFrame, vector: list[float], needles: list[str], s: Settings, offset: int, limit: int) -> DataFrame:
    """A page of the hybrid order with `has_more` and `total`, a lower bound: one row past the page is looked for."""
    found = hybrid(df, vector, needles, s, offset + limit + 1)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.desc("similarity"), "id"))  # at most offset + limit + 1 rows
    rows = found.withColumn("place", place).withColumn("total", F.count("*").over(Window.partitionBy(F.lit(0))))
    page = rows.where((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return page.select("id", "similarity", "score", "place", (F.col("total") > offset + limit).alias("has_more"), "total")
