"""Maintenance scans: which records are stale, little used, due for promotion, or of no quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.filters import due
from keepsake.settings import DAY_MS, Settings

# fixed values: patterns of raw tool output and of metric dumps
TOOL_PREFIX = r'(?i)^\s*(?:\[Tool (?:Result|Call)\b|<local-command-(?:stdout|stderr)>|<command-(?:stdout|stderr)>|</?tool[_-]?result\b|\{\s*"(?:stdout|stderr|interrupted|isImage|noOutputExpected)")'
PERSISTED = r"(?i)<persisted-output>|Output too large|Full output saved to"
PERSISTED_STRIP = r"(?i)<persisted-output>|Output too large\.?|Full output saved to|[A-Za-z]:?[/\\][^\s]+|/[^\s]+"
EXTENSION_ERROR = r"(?i)\b(?:error:\s*)?(?:extension disconnected|chrome browser extension isn't connected|browser extension disconnected|extension timeout|extension timed out)\b"
GENERIC_REMEDY = r"(?i)^(?:n/a|none|unknown|retry|try again|no resolution|not resolved|same)$"
METRIC_LINE = r"(?i)^\s*(?:(?:mean\s+)?reward|ep[_\s-]?reward|episode[_\s-]?reward|equity|final\s+equity|checkpoint|saved\s+model|model\s+saved|timesteps?|iterations?|fps|loss|policy[_\s-]?loss|value[_\s-]?loss|entropy|approx[_\s-]?kl)\b.*(?:[-+]?\d|\$|/)"
CHECKPOINT_PATH = r"(?i)\b(?:checkpoint|model|weights)\b.*(?:/|\\).*\.(?:pt|pth|zip|ckpt|safetensors)\b"
PROSE = r"(?i)\b(?:because|therefore|indicates|shows|means|failed to|fails to|learned|profitable|unprofitable|strategy|bug|fix|resolved|root cause|works|does not work)\b"
WORD = r"[A-Za-z][A-Za-z0-9_-]*"


def active() -> Column:
    return ~F.col("deprecated")


def stale(df: DataFrame, s: Settings, now: int) -> DataFrame:
    return df.where(active() & (F.col("last_used") < now - s.stale_days * DAY_MS))


def low_usage(df: DataFrame, s: Settings) -> DataFrame:
    ratio = F.col("usage_count") / F.col("retrieval_count")
    return df.where(active() & (F.col("retrieval_count") >= s.low_usage_min_retrievals) & (ratio < s.low_usage_ratio_threshold))


def zero_usage(df: DataFrame, s: Settings) -> DataFrame:
    return df.where(active() & (F.col("retrieval_count") >= s.low_usage_high_retrieval_min) & (F.col("usage_count") == 0))


def stale_unused(df: DataFrame, s: Settings, now: int) -> DataFrame:
    return df.where(active() & (F.col("ts_ms") < now - s.stale_unused_days * DAY_MS) & (F.col("usage_count") == 0) & (F.col("retrieval_count") == 0))


def promotion_candidates(df: DataFrame, s: Settings, now: int, checked: str | None = None) -> DataFrame:
    """Project-scoped commands, errors and discoveries that proved useful, oldest check first when `checked` is named."""
    proved = F.when(F.col("type") == "command", F.col("success_count") >= s.promotion_min_success).otherwise(F.col("usage_count") >= s.promotion_min_success)
    ratio = F.col("usage_count") / F.greatest(F.col("retrieval_count"), F.lit(1))
    used = (F.col("retrieval_count") < s.promotion_min_retrievals) | (ratio >= s.promotion_min_usage_ratio)
    found = df.where(active() & (F.col("scope") == "project") & F.col("type").isin("command", "error", "discovery") & proved & used)
    return found if checked is None else found.where(due(F.col(checked), now - s.promotion_recheck_days * DAY_MS))


def documentation_candidates(df: DataFrame) -> DataFrame:
    """Active procedures used five times and verified discoveries used three times; without a project they are global."""
    kept = ((F.col("type") == "procedure") & (F.col("usage_count") >= 5)) | ((F.col("type") == "discovery") & (F.col("usage_count") >= 3) & (F.col("confidence") == "verified"))
    project = F.trim(F.coalesce("project", F.lit("")))
    return df.where(active() & kept).withColumn("project", F.when(project.isin("", "unknown"), "global").otherwise(project))


def suggested_notes(records: DataFrame) -> DataFrame:
    """(target, n, text): the discoveries to add to each target's notes, as markdown grouped by where they hold.

    `records`: target, id, where, what, evidence, project, usage_count, last_used, ts_ms. Groups come in the order of their
    names, records without a place under General; in a group the most used come first, then the last used, the latest, the
    least id. White space runs become one blank; evidence stands in brackets. The scope line names the projects in
    ascending order. A target holds a batch of candidates (`Settings.promotion_batch_size`), so its text is one row.
    """
    inline = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    what, evidence = inline(F.col("what")), inline(F.col("evidence"))
    line = F.concat(F.lit("- "), what, F.when(evidence == "", "").otherwise(F.concat(F.lit(" (Evidence: "), evidence, F.lit(")"))))
    group = F.when(inline(F.col("where")) == "", "General").otherwise(inline(F.col("where")))
    project = F.trim(F.coalesce("project", F.lit("")))
    named = F.when((project != "") & (F.lower(project) != "unknown"), project)
    order = F.struct((-F.col("usage_count")).alias("u"), (-F.col("last_used")).alias("l"), (-F.col("ts_ms")).alias("t"), "id", line.alias("line"))
    groups = records.groupBy("target", group.alias("name")).agg(F.sort_array(F.collect_list(order)).alias("rows"), F.collect_set(named).alias("projects"))
    body = F.concat(F.lit("## "), F.col("name"), F.lit("\n"), F.array_join("rows.line", "\n"))
    targets = groups.groupBy("target").agg(
        F.sum(F.size("rows")).alias("n"), F.sort_array(F.collect_list(F.struct("name", body.alias("body")))).alias("groups"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("projects")))).alias("projects"),
    )
    many, all_names = F.size("projects"), F.array_join("projects", ", ")
    scope = F.when(many == 0, "Scope: Global").when(many == 1, F.concat(F.lit("Scope: Project-specific\nProject: "), all_names))
    scope = scope.otherwise(F.concat(F.lit("Scope: Multiple projects\nProjects: "), all_names))
    return targets.select("target", "n", F.concat(scope, F.lit("\n\n"), F.array_join("groups.body", "\n\n"), F.lit("\n")).alias("text"))


def _generic(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")))
    return (bare == "") | bare.rlike(GENERIC_REMEDY)


def quality_reason(kind: Column, primary: Column, secondary: Column, workarounds: list[Column], summaries: list[Column]) -> Column:
    """The first of four heuristics that a record meets, or null.

    `workarounds` (what to do instead) save a vague error; a metric dump is also saved by `summaries` (cause or reason).
    """
    worked = reduce(Column.__or__, [~_generic(r) for r in workarounds], F.lit(False))
    remedied = reduce(Column.__or__, [~_generic(r) for r in summaries], worked)
    words_left = F.size(F.regexp_extract_all(F.regexp_replace(primary, PERSISTED_STRIP, " "), F.lit(WORD), F.lit(0)))
    text = F.when(primary.contains("\n"), primary).otherwise(secondary)
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    metric = F.size(F.filter(lines, lambda x: x.rlike(METRIC_LINE) | x.rlike(CHECKPOINT_PATH)))
    dump = kind.isin("command", "error", "warning") & ~remedied & ~text.rlike(PROSE) & (F.size(lines) >= 3) & (metric >= 0.8 * F.size(lines))
    vague = kind.isin("error", "warning") & (F.char_length(primary) < 60) & primary.rlike(EXTENSION_ERROR) & ~worked
    return (
        F.when(primary.rlike(TOOL_PREFIX), "quality:tool-result-prefix")
        .when(primary.rlike(PERSISTED) & (words_left <= 8), "quality:persisted-output-pointer")
        .when(vague, "quality:vague-extension-error")
        .when(dump, "quality:raw-metric-dump")
    )


def similarity_tier(top1: Column, margin: Column) -> Column:
    return F.when(top1.isNull() | (top1 < 0.65), "none").when(top1 >= 0.85, F.when(margin >= 0.05, "strong").otherwise("multi")).otherwise("weak")
