"""Validity of commands, patches of kept records, trims of edges, excerpts around a find, and verdict-gated merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import commands
from keepsake.operators import writes
from keepsake.runtime import written
from keepsake.schema import PAYLOAD
from keepsake.settings import DAY_MS, Settings

# fixed values: the fields of each type that a synthesis may set, and the values of those that have a list
PATCHED = {
    "command": ("command", "resolution", "exitCode", "outcome"),
    "error": ("errorText", "errorType", "cause", "resolution"),
    "discovery": ("what", "where", "evidence", "confidence"),
    "procedure": ("name", "verification", "steps"),
    "warning": ("avoid", "useInstead", "reason", "severity"),
}
PATCHED_CONTEXT = {"command": ("project", "cwd", "intent"), "error": ("project", "file", "tool"), "procedure": ("project",)}
LISTED = {"outcome": ("success", "failure", "partial"), "confidence": ("verified", "inferred", "tentative"), "severity": ("caution", "warning", "critical")}
MAX_RECORD_CHARS, AROUND, MAX_EXCERPT = 16_000, 3, 8000
POLICY = "1"


def validity(df: DataFrame, known: DataFrame, command: str = "exact_text") -> DataFrame:
    """(id, valid, reason) of commands: the program is known, a path, or runs what the project brings along. `known`: program."""
    rows = df.where("type = 'command'").withColumn("p", commands.parsed(F.col(command))["program"])
    there = known.select(F.col("program").alias("p"), F.lit(True).alias("there")).distinct()
    rows = rows.join(there, "p", "left").withColumn("valid", F.col("p").isNotNull() & (F.coalesce("there", F.lit(False)) | commands.project_local(F.col("p"))))
    reason = F.when(~F.col("valid"), F.concat_ws(":", F.lit("missing-command"), "p"))
    return rows.select("id", "valid", reason.alias("reason"))


def patched(keepers: DataFrame, proposed: DataFrame) -> DataFrame:
    """(id, payload, refused): each keeper's payload with the proposed fields its type allows, and the names of the others.

    `keepers`: id, type, payload; `proposed`: id, fields (a map of strings, one row an id). Blank values do nothing; an
    exit code must be a number, a listed field one of its values, steps a JSON array or lines, and a context a JSON
    object, of which the type's own keys are taken.
    """
    rows = keepers.join(proposed.select("id", F.col("fields").alias("__fields")), "id")
    clean = F.map_filter(F.transform_values("__fields", lambda k, v: F.trim(v)), lambda k, v: F.coalesce(v != "", F.lit(False)))
    rows = rows.withColumn("__fields", F.transform_keys(clean, lambda k, v: F.trim(k)))
    value = lambda f: F.element_at("__fields", F.lit(f))
    allowed = lambda f: F.col("type").isin([t for t, fs in PATCHED.items() if f in fs])
    new: dict[str, Column] = {}
    for f in sorted({f for fs in PATCHED.values() for f in fs}):
        v = value(f)
        if f == "exitCode":
            v = F.try_to_number(v, F.lit("S999999999999")).cast("long")
        elif f == "steps":
            lines = F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")), F.split(v, "\n"))
            lines = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
            v = F.when(F.size(lines) > 0, lines)
        elif f in LISTED:
            v = F.when(v.isin(*LISTED[f]), v)
        new[f] = F.when(allowed(f), v)
    context = F.from_json(F.when(value("context").startswith("{"), value("context")), PAYLOAD["context"].dataType)
    old = F.col("payload.context")
    parts = []
    for f in PAYLOAD["context"].dataType.names:
        own = F.col("type").isin([t for t, fs in PATCHED_CONTEXT.items() if f in fs])
        parts.append(F.coalesce(F.when(own & (F.trim(context[f]) != ""), F.trim(context[f])), old[f]).alias(f))
    has_context = F.col("type").isin(*PATCHED_CONTEXT) & context.isNotNull()
    merged = [F.when(has_context, F.struct(*parts)).otherwise(old).alias(f) if f == "context" else (F.coalesce(new[f], F.col(f"payload.{f}")) if f in new else F.col(f"payload.{f}")).alias(f) for f in PAYLOAD.names]
    taken = F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(f)) for f, v in new.items()], F.when(has_context, F.lit("context"))))
    return rows.select("id", F.struct(*merged).alias("payload"), F.array_sort(F.array_except(F.map_keys("__fields"), taken)).alias("refused"))


def trimmed_edges(edges: DataFrame, sizes: DataFrame, kind: str = "shares_entity", most: int = MAX_RECORD_CHARS) -> DataFrame:
    """`edges` without the weakest of `kind` of each source whose record would be longer than `most` characters.

    `sizes`: source, size (the record without its edges). An edge's size is that of its JSON and a comma; other kinds
    count and all stay. Of equal weights the greater target goes first.
    """
    cost = F.char_length(F.to_json(F.struct("target", "kind", "weight", "reinforcement"))) + 1
    rows = edges.withColumn("__cost", cost)
    fixed = rows.where(F.col("kind") != kind).groupBy("source").agg(F.sum("__cost").alias("__fixed"))
    rows = rows.where(F.col("kind") == kind).join(fixed, "source", "left").join(sizes.select("source", F.col("size").alias("__size")), "source", "left")
    w = Window.partitionBy("source").orderBy(F.desc("weight"), "target").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("__cost").over(w) + F.coalesce("__fixed", F.lit(0)) + F.coalesce("__size", F.lit(0))
    kept = rows.withColumn("__total", total).where(F.col("__total") <= most)
    return edges.where(F.col("kind") != kind).unionByName(kept.select(*edges.columns))


def segments(events: DataFrame, finds: DataFrame, by: str = "conv_id", seq: str = "turn", around: int = AROUND, most: int = MAX_EXCERPT) -> DataFrame:
    """(id, by, excerpt): the events within `around` places of a find, with its paired tool event, joined by a blank line.

    `events`: by, seq, kind, tool_id, text; `finds`: id, by, seq. The first result of the found call, or the call of the
    found result, comes along wherever it is. Where the text is longer than `most`, events farthest from the find go
    first (of equally far ones the earlier), and the find alone is cut.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(seq))
    rows = written(events.join(finds.select(by).distinct(), by, "left_semi").withColumn("__p", place).select(by, seq, "__p", "kind", "tool_id", "text"), "places")
    at = finds.select("id", by, seq).join(rows.select(by, seq, F.col("__p").alias("__at"), "kind", "tool_id"), [by, seq])
    near = at.select("id", by, "__at", F.explode(F.sequence(F.col("__at") - around, F.col("__at") + around)).alias("__p"))
    other = F.when(F.col("kind") == "tool_call", "tool_result").when(F.col("kind") == "tool_result", "tool_call")
    first = rows.where("tool_id is not null").groupBy(by, F.col("kind").alias("__other"), "tool_id").agg(F.min("__p").alias("__p"))
    paired = at.withColumn("__other", other).join(first, [by, "__other", "tool_id"]).select("id", by, "__at", "__p")
    blocks = near.unionByName(paired).distinct().join(rows.select(by, "__p", "kind", "text"), [by, "__p"])
    text = F.trim(F.coalesce("text", F.lit("")))
    label = F.concat(F.lit("["), "kind", F.lit("]"))
    blocks = blocks.withColumn("__text", F.when(text == "", label).otherwise(F.concat(label, F.lit("\n"), text)))
    kept = Window.partitionBy("id", by).orderBy(F.abs(F.col("__p") - F.col("__at")), F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("__total", F.sum(F.char_length("__text") + 2).over(kept) - 2).where((F.col("__total") <= most) | (F.col("__p") == F.col("__at")))
    joined = blocks.groupBy("id", by).agg(F.sort_array(F.collect_list(F.struct("__p", "__text"))).alias("x"))  # at most 2 * around + 2 events
    whole = F.array_join(F.transform("x", lambda e: e["__text"]), "\n\n")
    return joined.select("id", by, F.when(F.char_length(whole) > most, F.concat(F.substring(whole, 1, most - 3), F.lit("..."))).otherwise(whole).alias("excerpt"))


def verdict_keys(clusters: DataFrame, df: DataFrame, mode: str, policy: str = POLICY) -> DataFrame:
    """(cluster, key, content_hash, ids): the digest of policy, mode and sorted ids, and that of the members' contents.

    `df`: id, content (JSON). Clusters are capped, so a cluster's ids are few.
    """
    rows = clusters.select("cluster", "id").distinct().join(df.select("id", writes.canonical_hash(F.col("content")).alias("__hash")), "id")
    ids = F.array_sort(F.collect_list(F.struct("id", "__hash")))
    rows = rows.groupBy("cluster").agg(ids.alias("__m")).where(F.size("__m") >= 2).withColumn("ids", F.transform("__m", lambda x: x["id"]))
    content = F.array_join(F.transform("__m", lambda x: F.concat(x["id"], F.lit("="), x["__hash"])), "|")
    return rows.select("cluster", F.sha2(F.concat_ws("|", F.lit(policy), F.lit(mode), F.array_join("ids", "|")), 256).alias("key"), F.sha2(content, 256).alias("content_hash"), "ids")


def gated(clusters: DataFrame, df: DataFrame, verdicts: DataFrame, answers: DataFrame, s: Settings, now: int, mode: str = "same-type", dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, actions, verdicts): what a run does with each cluster, in one pass.

    A cluster with a no-merge verdict of its key and content inside the backoff is `cached`. Of the others the answer
    decides: `merge` with a keeper among the members deprecates the others, `no_merge` is a new verdict; an answer that is
    missing, unknown or names another keeper makes the cluster `failed`, with its `problem`, and no other.
    `verdicts`: key, content_hash, checked_at, reason; `answers`: key, verdict, keeper, reason, one a key. Outcomes are
    (cluster, key, outcome, problem, checked): members of clusters that an answer decided count as checked. Verdicts past
    the backoff or of other contents go. In a dry run nothing counts as checked, and actions and verdicts stay as they were.
    """
    keyed = written(verdict_keys(clusters, df, mode), "verdict-keys")
    fresh = verdicts.where(F.col("checked_at") + max(1, s.no_merge_backoff_days) * DAY_MS > now)
    held = fresh.groupBy("key", "content_hash").agg(F.max("checked_at").alias("__held"))
    rows = keyed.join(held, ["key", "content_hash"], "left").join(answers, "key", "left")
    named = F.coalesce(F.array_contains("ids", F.col("keeper")), F.lit(False))
    outcome = (
        F.when(F.col("__held").isNotNull(), "cached").when((F.col("verdict") == "merge") & named, "merged").when(F.col("verdict") == "no_merge", "rejected").otherwise("failed")
    )
    problem = F.when(F.col("verdict").isNull(), "no answer").when(F.col("verdict") == "merge", "keeper is no member").otherwise("unknown verdict")
    rows = written(rows.withColumn("outcome", outcome).withColumn("problem", F.when(F.col("outcome") == "failed", problem)), "verdict-run")
    outcomes = rows.select("cluster", "key", "outcome", "problem", (F.col("outcome").isin("merged", "rejected") & F.lit(not dry_run)).alias("checked"))
    gone = rows.where("outcome = 'merged'").select(F.explode("ids").alias("id"), "keeper").where("id <> keeper")
    actions = gone.select("id", F.concat(F.lit("consolidation:merged-into:"), F.col("keeper")).alias("reason"), F.col("keeper").alias("superseding"))
    if dry_run:
        return outcomes, actions.limit(0), verdicts
    other = keyed.select("key", F.col("content_hash").alias("__now"))
    kept = fresh.join(other, "key", "left").where(F.col("__now").isNull() | (F.col("__now") == F.col("content_hash"))).select(*verdicts.columns)
    new = rows.where("outcome = 'rejected'").select("key", "content_hash", F.lit(now).cast("long").alias("checked_at"), "reason")
    return outcomes, actions, kept.unionByName(new.select(*verdicts.columns))
