"""Extraction runs, their records, reviews and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake import records
from keepsake.operators import mutate
from keepsake.schema import PAYLOAD


def run_page(runs: DataFrame, needle: str, offset: int, limit: int) -> DataFrame:
    """Runs whose session id has the needle (whatever its case), newest first, with the number of all such runs."""
    found = runs.where(F.lower("session").contains(needle.lower()))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("ts_ms"), "run_id").offset(offset).limit(limit).join(F.broadcast(total))


def last_good(runs: DataFrame) -> DataFrame:
    """The newest run of each session that has an event count and did not fail."""
    return mutate.first_by(runs.where("events is not null and not failed"), ["session"], [F.desc("ts_ms"), F.col("run_id")])


def new_events(events: DataFrame, consumed: DataFrame, overlap: int, by: str = "conv_id", seq: str = "turn") -> DataFrame:
    """Events past each key's consumed count, with the last `overlap` user turns before them as context (`is_new` tells).

    Keys without new events give no rows. `consumed`: key, n.
    """
    w = Window.partitionBy(by).orderBy(seq)
    rows = events.withColumn("__p", F.row_number().over(w)).join(consumed.select(by, F.col("n").alias("__n")), by, "left")
    rows = rows.withColumn("is_new", F.col("__p") > F.coalesce("__n", F.lit(0)))
    back = Window.partitionBy(by).orderBy(F.desc(seq))
    old_user = ((F.col("role") == "user") & ~F.col("is_new")).cast("int")
    rows = rows.withColumn("__turns", F.sum(old_user).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__before", F.col("__turns") - old_user).withColumn("__any", F.max(F.col("is_new").cast("int")).over(Window.partitionBy(by)))
    return rows.where((F.col("__any") == 1) & (F.col("is_new") | (F.col("__before") < overlap))).drop("__p", "__n", "__turns", "__before", "__any")


def from_prompt(events: DataFrame, prompts: DataFrame, by: str = "conv_id", seq: str = "turn", head: int = 200) -> DataFrame:
    """Events from the first user event that begins with the prompt's head; all events of keys where none does."""
    joined = events.join(prompts.select(by, F.substring("prompt", 1, head).alias("__head")), by)
    hit = F.when((F.col("role") == "user") & F.col("text").startswith(F.col("__head")), F.col(seq))
    first = F.min(hit).over(Window.partitionBy(by))
    return joined.withColumn("__first", first).where(F.col("__first").isNull() | (F.col(seq) >= F.col("__first"))).drop("__first", "__head")


def excerpts(events: DataFrame, texts: DataFrame, by: str = "conv_id", seq: str = "turn", around: int = 3, most: int = 8000) -> DataFrame:
    """(id, key, excerpt): around the first event that holds a record's text (in any case), joined and cut at `most`.

    `texts`: id, key, needle. Only events of the record's own key are looked at.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(seq))
    rows = events.withColumn("__p", place)
    hit = rows.join(texts, by).where(F.lower("text").contains(F.lower("needle"))).groupBy("id", by).agg(F.min("__p").alias("__at"))
    near = hit.join(rows, by).where(F.abs(F.col("__p") - F.col("__at")) <= around)
    joined = near.groupBy("id", by).agg(F.sort_array(F.collect_list(F.struct("__p", "text"))).alias("x"))
    return joined.select("id", by, F.substring(F.array_join(F.transform("x", lambda e: e["text"]), "\n"), 1, most).alias("excerpt"))


def coerce(outputs: DataFrame) -> DataFrame:
    """(run_id, pos, type, payload) of the valid records in a run's JSON array `output`; what can't be read is left out."""
    shape = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), *PAYLOAD.fields]))
    rows = outputs.select("run_id", F.posexplode(F.from_json("output", shape)).alias("pos", "r"))
    rows = rows.select("run_id", "pos", F.col("r.type").alias("type"), F.struct(*[F.col(f"r.{f}").alias(f) for f in PAYLOAD.names]).alias("payload"))
    return rows.where(records.is_valid(F.col("type"), F.col("payload")))


def without_run(table: DataFrame, runs: DataFrame, run_id: Column | str) -> tuple[DataFrame, DataFrame]:
    """The records without those the run inserted or updated, and the runs without it."""
    gone = runs.where(F.col("run_id") == run_id)
    ids = gone.select(F.explode(F.array_union("inserted", "updated")).alias("id")).distinct()
    return mutate.delete_ids(table, ids), runs.where(F.col("run_id") != run_id)


def decided(candidates: DataFrame, decisions: DataFrame, fallback: Column) -> DataFrame:
    """Candidates that their first decision promotes; without one the fallback decides. `decisions`: id, pos, promote."""
    first = mutate.first_by(decisions, ["id"], [F.col("pos")]).select("id", "promote")
    return candidates.join(first, "id", "left").where(F.coalesce("promote", fallback)).drop("promote")


def fresh_hints(hints: DataFrame, seen: DataFrame) -> DataFrame:
    """Hints by tool id (those without one all stay), without those the earlier run had: by tool id, else (ts, name)."""
    named = mutate.first_by(hints.where("tool_id is not null"), ["tool_id"], [F.col("ts_ms"), F.col("name")])
    named = named.join(seen.where("tool_id is not null").select("tool_id"), "tool_id", "left_anti").select(*hints.columns)
    bare = hints.where("tool_id is null").join(seen.select("ts_ms", "name"), ["ts_ms", "name"], "left_anti").select(*hints.columns)
    return named.unionByName(bare)


def timing_line(timings: Column, stages: list[str]) -> Column:
    """'name:ms' of the stages that ran, in the fixed order."""
    parts = [F.when(timings[s].isNotNull(), F.concat(F.lit(f"{s}:"), timings[s].cast("string"))) for s in stages]
    return F.concat_ws(",", *parts)


def audit(groups: DataFrame, known: DataFrame) -> DataFrame:
    """(id, reason, superseding) of audit groups with two or more known ids: duplicates keep their first id, conflicts the
    id they name (else the first). `groups`: group_no, kind, keep, pos, id."""
    rows = groups.join(known.select("id"), "id", "left_semi")
    w = Window.partitionBy("group_no")
    rows = rows.withColumn("__n", F.count("*").over(w)).where("__n >= 2")
    rows = rows.withColumn("__named", F.max((F.col("id") == F.col("keep")).cast("int")).over(w))
    first = F.first("id").over(w.orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    stays = F.when((F.col("kind") == "conflict") & (F.col("__named") == 1), F.col("keep")).otherwise(first)
    rows = rows.withColumn("superseding", stays).where("id <> superseding")
    return rows.select("id", F.concat(F.lit("audit:"), F.col("kind")).alias("reason"), "superseding")


def run_detail(runs: DataFrame, table: DataFrame, reviews: DataFrame) -> DataFrame:
    """(run_id, place, id, type, review): each run's records in its order, null where gone, and the latest review of the run.

    `runs`: run_id, ids. `reviews`: run_id, ts_ms, review.
    """
    latest = mutate.first_by(reviews, ["run_id"], [F.desc("ts_ms"), F.col("review")]).select("run_id", "review")
    rows = runs.select("run_id", F.posexplode_outer("ids").alias("place", "id"))
    return rows.join(table.select("id", "type"), "id", "left").join(latest, "run_id", "left").select("run_id", "place", "id", "type", "review")


def outcomes(found: DataFrame, table: DataFrame) -> DataFrame:
    """Outcomes (run_id, id, outcome, stored_id) with the stored record's type and whether it is still there."""
    stored = table.select(F.col("id").alias("stored_id"), "type")
    return found.join(stored, "stored_id", "left").select("run_id", "id", "outcome", "stored_id", "type", F.col("type").isNotNull().alias("present"))


def helpful(named: DataFrame, allowed: DataFrame) -> DataFrame:
    """(key, id): the ids a verdict names, once each, that were among the key's own."""
    return named.join(allowed, ["key", "id"], "left_semi").select("key", "id").distinct()


def review_texts(reviews: DataFrame, most: int = 2000) -> DataFrame:
    """(key, text): the distinct non-blank texts to embed for a review: prompt, errors, commands, and all of them joined.

    The joined text keeps both ends where it is longer than `most`.
    """
    from keepsake.functions import text as tx

    every = F.concat(F.array("prompt"), F.coalesce("errors", F.array().cast("array<string>")), F.coalesce("commands", F.array().cast("array<string>")))
    clean = F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    rows = reviews.select("key", clean.alias("parts")).where(F.size("parts") > 0)
    joined = tx.head_and_tail(F.array_join("parts", "\n"), most)
    return rows.select("key", F.explode(F.array_distinct(F.concat("parts", F.array(joined)))).alias("text"))


def first_verdicts(injected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(key, id, verdict) of every injected id: the first verdict named for it, else unknown; ids not injected are dropped."""
    first = mutate.first_by(verdicts.where(F.col("verdict").isin("helpful", "partial", "unhelpful", "unknown")), ["key", "id"], [F.col("pos")])
    return injected.join(first.select("key", "id", "verdict"), ["key", "id"], "left").select("key", "id", F.coalesce("verdict", F.lit("unknown")).alias("verdict"))
