"""From a prompt's vector and keywords to the records that go into its context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake import records
from keepsake.operators import packing, search
from keepsake.plans import sweep
from keepsake.runtime import written
from keepsake.settings import Settings

PROMPT = "prompt string, project string, ancestors array<string>, embedding array<double>"


def retrieve(
    df: DataFrame, edges: DataFrame, vector: list[float], needles: list[str], project: str, recent: DataFrame, s: Settings, ancestors: list[str] | None = None
) -> DataFrame:
    """(id, place, score, tokens, parent): search, anchor gate, relations, suppression, variety, then packing.

    The steps of `sweep` for one prompt and one settings value, with the ids injected lately (`recent`) removed or lowered.
    `df` holds the records (id, type, project, scope, exact_text, embedding, counters, deprecated), `edges` source,
    target, kind and weight. The records themselves are read by the two searches and by the joins on ids.
    """
    spark = df.sparkSession
    prompts = spark.createDataFrame([("", project, list(ancestors or []), [float(x) for x in vector])], PROMPT)
    wanted = spark.createDataFrame([("", n, False) for n in needles], "prompt string, needle string, entity boolean")
    arms = {"": s}
    found = written(sweep.anchored(sweep.candidates(df, prompts, wanted, arms), df, prompts, arms), "found")
    both = sweep.expanded(found, edges, df, arms).select("id", "score", "similarity", "parent")
    both = search.suppressed(both, recent, s).join(df.select("id", "exact_text", "embedding"), "id")
    order = packing.maximal_marginal_relevance(both.withColumn("query_id", F.lit(0)), s.max_records, s.mmr_lambda).select("id", "rank")
    ranked = order.join(both, "id")
    packed = packing.stop_at_overflow(ranked, records.tokens(F.col("exact_text")), s.max_tokens, [F.col("rank")])
    return packed.select("id", "place", "score", "tokens", "parent")


def left_out(found: DataFrame, chosen: DataFrame, limit: int) -> DataFrame:
    """Rows of the plain best `limit` that variety left out."""
    best = found.orderBy(F.desc("score"), F.desc("similarity"), "id").limit(limit)
    return best.join(chosen.select("id"), "id", "left_anti")
