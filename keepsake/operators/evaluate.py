"""Offline comparison of retrieval arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.runtime import written


def arm_metrics(results: DataFrame, verdicts: DataFrame, baseline: str) -> DataFrame:
    """Per arm: prompts, injected, judged, helpful, precision, and helpful ids the baseline lacks.

    `results`: arm, prompt, id. `verdicts`: prompt, id, helpful.
    """
    base = results.where(F.col("arm") == baseline).select("prompt", "id", F.lit(True).alias("in_base"))
    rows = results.join(verdicts, ["prompt", "id"], "left").join(base, ["prompt", "id"], "left")
    found = rows.groupBy("arm").agg(
        F.countDistinct("prompt").alias("prompts"), F.count("*").alias("injected"), F.count("helpful").alias("judged"),
        F.count_if("helpful").alias("helpful"), F.count_if(F.col("helpful") & F.col("in_base").isNull()).alias("discoveries"),
    )
    return found.withColumn("precision", F.when(F.col("judged") > 0, F.col("helpful") / F.col("judged")))


def overlap(results: DataFrame, a: str, b: str) -> DataFrame:
    """prompt, jaccard of the ids of two arms (1 where both are empty)."""
    ids = results.where(F.col("arm").isin(a, b)).groupBy("prompt").agg(
        F.collect_set(F.when(F.col("arm") == a, F.col("id"))).alias("x"), F.collect_set(F.when(F.col("arm") == b, F.col("id"))).alias("y")
    )
    every = F.size(F.array_union("x", "y"))
    return ids.select("prompt", F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / every).alias("jaccard"))


def blind_union(results: DataFrame, seed: str) -> DataFrame:
    """prompt, id, place: distinct ids over all arms in an order that doesn't tell the arm."""
    w = Window.partitionBy("prompt").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256), "id")
    return results.select("prompt", "id").distinct().withColumn("place", F.row_number().over(w))


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, repeats counted, with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def arm_report(results: DataFrame, verdicts: DataFrame, baseline: str) -> DataFrame:
    """Per arm: strict precision (helpful of judged), lenient (also partly), counts a kind of edge, displacement, gold rate.

    `results`: arm, prompt, id, kind (how the record came in). `verdicts`: prompt, id, verdict (helpful, partial,
    unhelpful), gold. Displaced are the baseline's helpful ids that the arm lacks; the gold rate is the share of prompts
    with a gold record in the arm.
    """
    rows = results.join(verdicts, ["prompt", "id"], "left")
    good, part = F.col("verdict") == "helpful", F.col("verdict").isin("helpful", "partial")
    found = rows.groupBy("arm").agg(
        F.countDistinct("prompt").alias("prompts"), F.count("*").alias("injected"), F.count("verdict").alias("judged"),
        (F.count_if(good) / F.count("verdict")).alias("strict"), (F.count_if(part) / F.count("verdict")).alias("lenient"),
        F.count_if(F.col("kind") == "relates_to").alias("related"), F.count_if(F.col("kind") == "shares_entity").alias("by_entity"),
        (F.countDistinct(F.when(F.col("gold"), F.col("prompt"))) / F.countDistinct("prompt")).alias("gold_rate"),
    )
    mine = results.select("arm").distinct().join(rows.where((F.col("arm") == baseline) & good).select("prompt", "id"))  # arms are few
    lost = mine.join(results.select("arm", "prompt", "id"), ["arm", "prompt", "id"], "left_anti").groupBy("arm").agg(F.count("*").alias("displaced"))
    return found.join(lost, "arm", "left").withColumn("displaced", F.coalesce("displaced", F.lit(0)))


def percentiles(runs: DataFrame, by: str, value: str, percents: list[int]) -> DataFrame:
    """(by, p<percent>...): the value at place floor(percent * n / 100) of the n sorted ones, counted from 0.

    Equal values are counted before they are ordered, so a group's order holds its distinct values only.
    """
    counts = runs.groupBy(by, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(by)
    sums = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__all", F.sum("__n").over(w))
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("__all") / 100), F.col("__all") - 1)
    return sums.groupBy(by).agg(*[F.min(F.when(F.col("__upto") > at(p), F.col(value))).alias(f"p{p}") for p in percents])


def eval_report(runs: DataFrame, injected: DataFrame, verdicts: DataFrame, gold: DataFrame, baseline: str) -> DataFrame:
    """One row an arm: precision, how rows came in, times, and what the arm finds and loses against the baseline.

    `runs`: arm, prompt, ms (one row a prompt that the arm ran). `injected`: arm, prompt, id, via (kind of the edge that led to
    it, or null), keyword. `verdicts`: prompt, id, verdict (relevant, partially_relevant, irrelevant, unknown). `gold`:
    prompt, id, helped. Rows of the last three are distinct in their keys. Against the baseline count prompts that both ran:
    discoveries are relevant or partly so and not in the baseline (`strict_found`: relevant ones), displaced its
    relevant ids that the arm lacks, `overlap` the mean Jaccard of ids (1 where both are empty). Ratios without a base
    and, for the baseline, what compares with it are null; discoveries a hundred prompts count all prompts of the runs.
    """
    injected = written(injected, "injected")  # read five times below
    base_runs = runs.where(F.col("arm") == baseline).select("prompt")
    base = injected.where(F.col("arm") == baseline).select("prompt", "id")
    rows = injected.join(verdicts.select("prompt", "id", "verdict"), ["prompt", "id"], "left").join(gold.select("prompt", "id", "helped"), ["prompt", "id"], "left")
    rows = rows.join(base.withColumn("in_base", F.lit(True)), ["prompt", "id"], "left").join(base_runs.withColumn("both_ran", F.lit(True)), "prompt", "left")
    strict, some = F.col("verdict") == "relevant", F.col("verdict").isin("relevant", "partially_relevant")
    fresh = F.col("in_base").isNull() & F.col("both_ran")
    count = lambda c, name: F.count_if(c).alias(name)
    sums = rows.groupBy("arm").agg(
        F.count("*").alias("injected"), F.count("verdict").alias("judged"), count(strict, "relevant"), count(some, "some"),
        count(F.col("via") == "shares_entity", "by_entity"), count(F.col("via") == "relates_to", "related"),
        count(fresh & some, "discoveries"), count(fresh & strict, "strict_found"), count(fresh & some & (F.col("via") == "shares_entity"), "entity_found"),
        count(fresh & some & F.col("via").isNull() & F.col("keyword"), "keyword_found"),
        F.count("helped").alias("gold_judged"), count("helped", "gold_helped"), count(fresh & F.col("helped"), "gold_found"),
    )
    others = runs.where(F.col("arm") != baseline).select("arm", "prompt").join(base_runs, "prompt", "left_semi")
    lost = base.join(verdicts.where(strict).select("prompt", "id"), ["prompt", "id"], "left_semi").join(others, "prompt")
    lost = lost.join(injected.select("arm", "prompt", "id"), ["arm", "prompt", "id"], "left_anti").groupBy("arm").agg(F.count("*").alias("displaced"))
    sizes = rows.groupBy("arm", "prompt").agg(F.count("*").alias("mine"), F.count("in_base").alias("shared"))
    sizes = others.join(sizes, ["arm", "prompt"], "left").join(base.groupBy("prompt").agg(F.count("*").alias("theirs")), "prompt", "left").na.fill(0)
    union = F.col("mine") + F.col("theirs") - F.col("shared")
    overlap = sizes.groupBy("arm").agg(F.avg(F.when(union == 0, 1.0).otherwise(F.col("shared") / union)).alias("overlap"))
    total = runs.agg(F.countDistinct("prompt").alias("all_prompts"))
    found = runs.groupBy("arm").agg(F.count("*").alias("prompts")).join(percentiles(runs, "arm", "ms", [50, 95]), "arm")
    counts = [c for c in sums.columns if c != "arm"]
    found = found.join(sums, "arm", "left").join(lost, "arm", "left").na.fill(0, [*counts, "displaced"]).join(overlap, "arm", "left").join(F.broadcast(total))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    compared = lambda c, name: F.when(F.col("arm") != baseline, c).alias(name)
    return found.select(
        "arm", "prompts", "injected", "judged", share("relevant", "judged").alias("strict"), share("some", "judged").alias("lenient"), "by_entity", "related", "p50", "p95",
        *[compared(F.col(c), c) for c in ("discoveries", "strict_found", "entity_found", "keyword_found", "displaced", "gold_found")],
        compared(F.col("strict_found") - F.col("displaced"), "net"), compared(100 * share("discoveries", "all_prompts"), "per_100"), "overlap",
        "gold_judged", "gold_helped", share("gold_helped", "gold_judged").alias("gold_rate"),
    )


def compare_tables(a: DataFrame, b: DataFrame, fields: list[str], by: tuple[str, ...] = ("type", "scope")) -> DataFrame:
    """(check, key, a, b, same): two states of the record table, over all their records.

    Rows in all, rows a value of each column of `by`, deprecated rows, ids that only one side has, and for each of `fields`
    (and whether there is a vector) how many shared ids differ in it (counted in `a` and `b` alike). Ids are distinct.
    """
    one = F.lit("all")

    def counts(df: DataFrame) -> DataFrame:
        keys = [("total", one, F.lit(True)), *[(c, F.col(c).cast("string"), F.lit(True)) for c in by], ("deprecated", one, F.col("deprecated"))]
        each = F.inline(F.array(*[F.struct(F.lit(n).alias("check"), k.alias("key"), hit.alias("hit")) for n, k, hit in keys]))
        return df.select(each).groupBy("check", "key").agg(F.count_if("hit").alias("n"))

    left, right = counts(a).withColumnRenamed("n", "a"), counts(b).withColumnRenamed("n", "b")
    numbers = left.join(right, (left["check"] == right["check"]) & left["key"].eqNullSafe(right["key"]), "full")
    numbers = numbers.select(F.coalesce(left["check"], right["check"]).alias("check"), F.coalesce(left["key"], right["key"]).alias("key"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    has = F.coalesce(F.size("embedding") > 0, F.lit(False))
    side = lambda df, name: df.select("id", F.struct(*fields, has.alias("has_vector")).alias(name))
    both = side(a, "x").join(side(b, "y"), "id", "full")
    shared = F.col("x").isNotNull() & F.col("y").isNotNull()
    gone = both.agg(F.count_if(F.col("y").isNull()).alias("a"), F.count_if(F.col("x").isNull()).alias("b")).select(F.lit("only here").alias("check"), one.alias("key"), "a", "b")
    names = [*fields, "has_vector"]
    differ = both.where(shared).agg(*[F.count_if(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))).alias(c) for c in names])
    differ = differ.select(F.inline(F.array(*[F.struct(F.lit("differs").alias("check"), F.lit(c).alias("key"), F.col(c).alias("a"), F.col(c).alias("b")) for c in names])))
    same = F.when(F.col("check").isin("differs", "only here"), (F.col("a") == 0) & (F.col("b") == 0)).otherwise(F.col("a") == F.col("b"))
    return numbers.unionByName(gone).unionByName(differ).withColumn("same", same)


def compare_results(queries: DataFrame, a: DataFrame, b: DataFrame, drift: float = 0.05, enough: int = 70) -> DataFrame:
    """(query, n_a, n_b, overlap, same_order, drifted, verdict) of two result lists (query, id, rank, similarity) a query.

    The overlap is the whole percentage of a's ids that b has (of no ids: 100 where b has none either, else 0), `drifted`
    the shared ids whose similarities are further apart than `drift`. Verdicts: same, order (equal ids in another order),
    near (an overlap of at least `enough`), far. Ids are distinct within a query; queries without results give a row.
    """
    left = a.select("query", "id", F.col("rank").alias("ra"), F.col("similarity").alias("sa"))
    right = b.select("query", "id", F.col("rank").alias("rb"), F.col("similarity").alias("sb"))
    both = left.join(right, ["query", "id"], "full")
    sums = both.groupBy("query").agg(
        F.count("ra").alias("n_a"), F.count("rb").alias("n_b"), F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("shared"),
        F.count_if(F.col("ra") == F.col("rb")).alias("in_place"), F.count_if(F.abs(F.col("sa") - F.col("sb")) > drift).alias("drifted"),
    )
    rows = queries.select("query").join(sums, "query", "left").na.fill(0, ["n_a", "n_b", "shared", "in_place", "drifted"])
    share = F.when(F.col("n_a") > 0, F.floor(100 * F.col("shared") / F.col("n_a") + 0.5)).when(F.col("n_b") == 0, 100).otherwise(0).cast("int")
    rows = rows.withColumn("overlap", share).withColumn("same_order", (F.col("in_place") == F.col("n_a")) & (F.col("n_a") == F.col("n_b")))
    whole = (F.col("shared") == F.col("n_a")) & (F.col("n_a") == F.col("n_b"))
    verdict = F.when(F.col("same_order"), "same").when(whole, "order").when(F.col("overlap") >= enough, "near").otherwise("far")
    return rows.select("query", "n_a", "n_b", "overlap", "same_order", "drifted", verdict.alias("verdict"))


def prompts(events: DataFrame, least: int = 15) -> DataFrame:
    """(key, session, ts_ms, prompt): prompts of at least so many characters that are no bare slash command.

    The key is the first 16 digits of the sha256 of session, time and text.
    """
    text = F.trim("prompt")
    rows = events.where((F.char_length(text) >= least) & ~text.rlike(r"^/[A-Za-z0-9_:-]+$"))
    key = F.substring(F.sha2(F.concat_ws(":", "session", F.col("ts_ms").cast("string"), "prompt"), 256), 1, 16)
    return rows.select(key.alias("key"), "session", "ts_ms", "prompt")
