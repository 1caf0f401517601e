"""Inserts, batch updates, deep merges, ingest with de-duplication, and whole-table maintenance of the record table."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake import records, schema
from keepsake.operators import graph, mutate, vectors
from keepsake.runtime import written
from keepsake.settings import Settings

TAIL = 20_000  # open rows of an ingest that one task settles
CONTEXT_TYPES = ("command", "error", "procedure")


def problem(payload: Column, dims: int | None = None) -> Column:
    """Why a record can't be stored, or null: its type, its fields, then its vector's length."""
    known = F.coalesce(F.col("type").isin("command", "error", "discovery", "procedure", "warning"), F.lit(False))
    wrong_size = F.lit(False) if dims is None else F.col("embedding").isNotNull() & (F.size("embedding") != dims)
    return (
        F.when(~known, "unknown type").when(~F.coalesce(records.is_valid(F.col("type"), payload), F.lit(False)), "missing fields")
        .when(wrong_size, "vector length")
    )


def validated(new: DataFrame, now: int, dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the table's schema, (id, problem) of what can't be stored).

    `new` has id, type, content (JSON) and any columns of the table; texts are derived from the payload, counters that
    are missing are 0, a missing time is `now`, and a missing scope is the project's.
    """
    rows = records.parse_payload(new).withColumn("problem", problem(F.col("payload"), dims))
    refused = rows.where("problem is not null").select("id", "problem")
    rows = rows.where("problem is null").withColumn("exact_text", records.exact_text(F.col("type"), F.col("payload")))
    stamp = F.coalesce(F.col("timestamp"), F.lit(now)) if "timestamp" in new.columns else F.lit(now)
    full = schema.migrate(rows.withColumn("timestamp", stamp))
    filled = [F.coalesce(F.col(c), F.lit(v)).alias(c) if (v := schema.DEFAULTS.get(c)) is not None else F.col(c) for c in full.columns]
    return full.select(*filled), refused


def deep_merge(old: Column, new: Column, kind: Column, fields: T.StructType = schema.PAYLOAD) -> Column:
    """The payload with the new one's non-null fields; for commands, errors and procedures `context` merges field by field."""
    context = fields["context"].dataType
    each = F.struct(*[F.coalesce(new["context"][f], old["context"][f]).alias(f) for f in context.names])
    both = F.when(new["context"].isNull(), old["context"]).when(kind.isin(*CONTEXT_TYPES), each).otherwise(new["context"])
    return F.struct(*[both.alias("context") if f == "context" else F.coalesce(new[f], old[f]).alias(f) for f in fields.names])


def batch_update(target: DataFrame, ids: DataFrame, changes: dict[str, Column], accept: Column) -> tuple[DataFrame, DataFrame]:
    """(the table with `changes` on the rows of `ids` that `accept` passes afterwards, (id, stage) of the rows that fail).

    A row that fails keeps its old values and stops no other.
    """
    rows = target.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    named = {f"__{c}": v for c, v in changes.items()}
    rows = rows.withColumns(named)
    after = rows.select("*").withColumns({f"__old_{c}": F.col(c) for c in changes}).withColumns({c: F.col(f"__{c}") for c in changes})
    after = after.withColumn("__ok", F.coalesce(F.col("__hit") & accept, F.lit(False)))
    out = after.withColumns({c: F.when(F.col("__ok"), F.col(c)).otherwise(F.col(f"__old_{c}")) for c in changes})
    failed = after.where(F.col("__hit") & ~F.col("__ok")).select("id", F.lit("prepare").alias("stage"))
    return out.select(*target.columns), failed


def supersede(target: DataFrame, actions: DataFrame, edges: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, edges, failures): marks `id` deprecated by `superseding` and adds a supersedes edge of weight 1.

    An action whose superseding record is not in the table fails as a whole; one whose id is not there does nothing.
    Of several actions on one id the least (superseding, reason) counts.
    """
    first = mutate.first_by(actions, ["id"], [F.col("superseding"), F.col("reason")])
    there = target.select(F.col("id").alias("superseding"), F.lit(True).alias("there"))
    checked = written(first.join(there, "superseding", "left").join(target.select("id"), "id", "left_semi"), "supersede")
    good = checked.where("superseding is null or there").select("id", "reason", "superseding")
    failed = checked.where("superseding is not null and there is null").select("id", F.lit("superseding record is missing").alias("problem"))
    new = good.where("superseding is not null").select(
        F.col("superseding").alias("source"), F.col("id").alias("target"), F.lit("supersedes").alias("kind"), F.lit(1.0).alias("weight"), F.lit(1).cast("long").alias("reinforcement"),
    )
    return mutate.soft_delete(target, good, now), graph.upsert_edges(edges, new, "set"), failed


def ingest(new: DataFrame, target: DataFrame, s: Settings, tail: int = TAIL) -> DataFrame:
    """(id, action, target, similarity): each new record, in (seq, id) order, updates its nearest record or is inserted.

    The nearest is that of its project and type at or above the threshold, among the table's active records and the new
    ones inserted before it; an update that changes no field is `skipped` (`same_as`: the digest of what would change,
    equal on both sides). Of new records that are equal in project, type and vector only the first can be inserted: what is
    near to it, or it itself, is near to all later ones. So new records are joined with the table's best and with these heads
    alone, and many copies in a batch don't make all their pairs. Heads are settled as seeds of `clusters.greedy_stars`
    are: the first `tail` rows of each connected component a round, then all that wait for no other.
    """
    by = ("project", "type")
    old = vectors.neighbours(new, target.where(~F.col("deprecated")), 1, s.dedup_threshold, same=by)
    old = old.select("id", F.struct((-F.col("similarity")).alias("far"), "other").alias("old"))
    state = written(new.select("id", F.struct("seq", "id").alias("at")).join(old, "id", "left"), "ingest-state")
    # above such a threshold rounding may part equal vectors: each record is its own head
    apart = F.lit("") if s.dedup_threshold <= 1 - 1e-6 else F.col("id")
    heads = new.groupBy("project", "type", "embedding", apart.alias("apart")).agg(F.min(F.struct("seq", "id")).alias("at"))
    heads = written(heads.select("at.id", "at", "project", "type", "embedding"), "ingest-heads")
    near = vectors.neighbours(new, heads, 2**31 - 1, s.dedup_threshold, same=by).select("id", "other", "similarity")
    before = near.join(state.select("id", "at"), "id").join(heads.select(F.col("id").alias("other"), F.col("at").alias("other_at")), "other").where("other_at < at")
    pairs = written(before.select("id", "other", "similarity"), "ingest-pairs")
    settled = _settled_heads(state.join(heads.select("id"), "id", "left_semi"), pairs.join(heads.select("id"), "id", "left_semi"), tail)
    later = _nearer(state.join(heads.select("id"), "id", "left_anti"), pairs, settled)
    found = settled.unionByName(later.select("id", _action(), "old"))
    digest = target.select(F.col("id").alias("target"), F.col("same_as").alias("was")).unionByName(new.select(F.col("id").alias("target"), F.col("same_as").alias("was")))
    found = found.select("id", "action", F.col("old.other").alias("target"), (-F.col("old.far")).alias("similarity")).join(digest, "target", "left").join(new.select("id", "same_as"), "id")
    action = F.when((F.col("action") == "update") & F.col("same_as").eqNullSafe(F.col("was")), "skipped").otherwise(F.col("action"))
    return found.select("id", action.alias("action"), "target", "similarity")


def _action() -> Column:
    return F.when(F.col("old").isNull(), "insert").otherwise("update").alias("action")


def _nearer(state: DataFrame, pairs: DataFrame, done: DataFrame) -> DataFrame:
    """`state` with the inserted ones of `done` among what a record may be nearest to; the least id of equally near ones."""
    inserted = done.where("action = 'insert'").select(F.col("id").alias("other"))
    best = pairs.join(inserted, "other", "left_semi").groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "other")).alias("x"))
    return state.join(best, "id", "left").withColumn("old", F.least("old", "x")).drop("x")


def _settled_heads(state: DataFrame, pairs: DataFrame, tail: int) -> DataFrame:
    """(id, action, old) of all records of `state` (id, at, old), each after the earlier ones that it is near to."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        inserted: set[str] = set()
        out = []
        for (_, id_), mine in rows.sort_values(["seq", "id"]).groupby(["seq", "id"], sort=True):
            old = mine[["far", "best"]].iloc[0]
            found = [] if pd.isna(old["far"]) else [(old["far"], old["best"])]
            found += [(-x, o) for o, x in zip(mine["other"], mine["similarity"]) if o in inserted]
            if not found:
                inserted.add(id_)
            out.append((id_, *(("update", *min(found)) if found else ("insert", None, None))))
        return pd.DataFrame(out, columns=["id", "action", "far", "other"])

    rest = written(pairs, "ingest-open")
    parts = graph.parts(rest, "id", "other", tail)
    settled = [written(state.join(parts, "id", "left_anti").select("id", _action(), "old"), "ingest-alone")]
    waiting = written(state.join(parts, "id"), "ingest-waiting")

    def without(done: DataFrame) -> tuple[DataFrame, DataFrame]:
        settled.append(done)
        left = written(_nearer(waiting.join(done.select("id"), "id", "left_anti"), rest, done), "ingest-waiting")
        open_ = rest.join(done.select(F.col("id").alias("other")), "other", "left_anti").join(left.select("id"), "id", "left_semi")
        return left, written(open_.select("id", "other", "similarity"), "ingest-open")

    while not waiting.isEmpty():
        if tail:
            first = graph.dealt(graph.first_rows(waiting.join(rest, "id", "left"), tail, "other"), tail)
            flat = first.select("task", "id", "at.seq", F.col("old.far").alias("far"), F.col("old.other").alias("best"), "other", "similarity")
            done = flat.groupBy("task").applyInPandas(settle, "id string, action string, far double, other string")
            done = done.select("id", "action", F.when(F.col("far").isNotNull(), F.struct("far", "other")).alias("old"))
            waiting, rest = without(written(done, "ingest-done"))
            if waiting.isEmpty():
                break
        ready = waiting.join(rest.select("id").distinct(), "id", "left_anti").select("id", _action(), "old")
        waiting, rest = without(written(ready, "ingest-ready"))
    return reduce(DataFrame.unionByName, settled)


def compact(df: DataFrame, path: str, files: int) -> DataFrame:
    """`df` rewritten in `files` files; raises where the rows don't come back all, and the old files stay as they are."""
    before = df.count()
    df.repartition(files).write.parquet(path)
    after = df.sparkSession.read.schema(df.schema).parquet(path)
    if (n := after.count()) != before:
        raise RuntimeError(f"compaction changed the number of rows from {before} to {n}")
    return after


def clone(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reset(df: DataFrame) -> DataFrame:
    """An empty table of the same schema."""
    return df.where(F.lit(False))


def refreshed(df: DataFrame, embeddings: DataFrame) -> DataFrame:
    """`df` with the new vector of each id that has one. `embeddings`: one row an id."""
    new = embeddings.select("id", F.col("embedding").alias("__new"))
    return df.join(new, "id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).select(*df.columns)


def exported(df: DataFrame) -> DataFrame:
    """(id, json): every column but the vector, as one JSON object a row."""
    return df.select("id", F.to_json(F.struct(*[c for c in df.columns if c != "embedding"])).alias("json"))


def canonical_hash(json: Column, unordered: str = "sourceRecordIds") -> Column:
    """sha256 of a flat JSON object's fields in key order, nulls dropped and the `unordered` array of strings sorted."""
    fields = F.from_json(json, "map<string, string>")
    ids = F.array_sort(F.from_json(F.get_json_object(json, f"$.{unordered}"), "array<string>"))
    entries = F.array_sort(F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull()))
    parts = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.when((e["key"] == unordered) & ids.isNotNull(), F.array_join(ids, ",")).otherwise(e["value"])))
    return F.sha2(F.array_join(parts, "\n"), 256)
