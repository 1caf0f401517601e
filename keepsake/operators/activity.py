"""Time buckets with zero fill, totals, snapshots, retention and run health. All days and weeks are UTC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.runtime import written
from keepsake.settings import DAY_MS


def bucket_of(ms: Column, period: str) -> Column:
    """The date of the UTC day, or of the Monday that begins the week."""
    return F.date_trunc(period, F.timestamp_millis(ms)).cast("date")


def calendar(spark: SparkSession, period: str, n: int, now: int) -> DataFrame:
    """The last n day or week buckets up to `now` (days at most 365, weeks at most 104)."""
    n = min(max(1, n), 365 if period == "day" else 104)
    last = bucket_of(F.lit(now), period)
    step = 1 if period == "day" else 7
    return spark.range(n).select(F.date_sub(last, (F.col("id") * step).cast("int")).alias("bucket"))


def activity(events: DataFrame, ms: str, period: str, n: int, now: int) -> DataFrame:
    counts = events.groupBy(bucket_of(F.col(ms), period).alias("bucket")).agg(F.count("*").alias("n"))
    days = calendar(events.sparkSession, period, n, now)
    return days.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def token_totals(events: DataFrame, period: str, n: int, now: int, source: str | None = None) -> DataFrame:
    """Sums of input and output tokens a bucket (cache tokens are no part of the total)."""
    rows = events if source is None else events.where(F.col("source") == source)
    clean = lambda c: F.sum(F.greatest(F.col(c), F.lit(0)))
    sums = rows.groupBy(bucket_of(F.col("ts_ms"), period).alias("bucket")).agg(clean("input_tokens").alias("i"), clean("output_tokens").alias("o"))
    days = calendar(events.sparkSession, period, n, now).join(sums, "bucket", "left")
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    return days.select("bucket", i.alias("input_tokens"), o.alias("output_tokens"), (i + o).alias("total_tokens"))


def latest_snapshots(snapshots: DataFrame, ms: str, value: str, period: str, n: int, now: int) -> DataFrame:
    """The value of the latest snapshot of each bucket (of equal times the smallest value), null where none is."""
    best = snapshots.groupBy(bucket_of(F.col(ms), period).alias("bucket")).agg(F.max_by(value, F.struct(F.col(ms), -F.col(value))).alias(value))
    return calendar(snapshots.sparkSession, period, n, now).join(best, "bucket", "left").select("bucket", value)


def retained(events: DataFrame, ms: str, days: int, now: int) -> DataFrame:
    """Events of the days that are not older than `days`."""
    return events.where(bucket_of(F.col(ms), "day") >= bucket_of(F.lit(now - days * DAY_MS), "day"))


def snapshot_if_new_day(snapshots: DataFrame, new: DataFrame, ms: str) -> DataFrame:
    """`snapshots` and those of `new` whose day has none yet (the earliest of a day)."""
    day = bucket_of(F.col(ms), "day")
    had = snapshots.select(day.alias("__day")).distinct()
    fresh = new.withColumn("__day", day).join(had, "__day", "left_anti")
    fresh = fresh.withColumn("__r", F.row_number().over(Window.partitionBy("__day").orderBy(ms))).where("__r = 1").drop("__r", "__day")
    return snapshots.unionByName(fresh)


def pool_stats(df: DataFrame) -> DataFrame:
    """(dimension, key, n): totals and counts by type, project (null: unknown) and scope."""
    rows = df.select("type", F.coalesce("project", F.lit("unknown")).alias("project"), "scope", "deprecated")
    sets = rows.groupingSets([["type"], ["project"], ["scope"], []], "type", "project", "scope")
    counts = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("deprecated").alias("old"))
    name = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "project").when(F.col("g") == 6, "scope").otherwise("total")
    key = F.when(F.col("g") == 7, "all").otherwise(F.coalesce("type", "project", "scope"))
    by = counts.select(name.alias("dimension"), key.alias("key"), "n")
    return by.unionByName(counts.where("g = 7").select(F.lit("deprecated").alias("dimension"), F.lit("all").alias("key"), F.col("old").alias("n")))


def usage_summary(df: DataFrame) -> DataFrame:
    """Averages over retrieved rows; the usage ratio is the ratio of the sums."""
    return df.where("retrieval_count > 0").agg(
        F.count("*").alias("n"), F.avg("retrieval_count").alias("avg_retrievals"), F.avg("usage_count").alias("avg_usages"),
        (F.sum("usage_count") / F.sum("retrieval_count")).alias("avg_usage_ratio"),
    )


def _by_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` dealt to ascending ranges of `order`, which `__range` numbers; equal rows may go to several."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order, F.xxhash64(F.monotonically_increasing_id()))
    return written(dealt.withColumn("__range", F.spark_partition_id()), "ranges")


def at_ranks(df: DataFrame, value: str, by: list[str], ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """(by, value, rank): of each group the values at `ranks` of its size, counted from 1 in ascending order.

    Rows are dealt to ascending ranges; a row a group and range tells which one holds a rank, and only that is sorted.
    """
    dealt = _by_ranges(df.select(*by, value), [*by, value])
    group = Window.partitionBy(*by)
    sizes = dealt.groupBy(*by, "__range").agg(F.count("*").alias("__c"))
    sizes = sizes.withColumn("__end", F.sum("__c").over(group.orderBy("__range"))).withColumn("__n", F.sum("__c").over(group))
    held = sizes.withColumn("rank", F.explode(F.array_distinct(F.array(*ranks(F.col("__n"))))))
    held = held.withColumn("__at", F.col("rank") - F.col("__end") + F.col("__c")).where("__at between 1 and __c").select(*by, "__range", "rank", "__at")
    held = written(held, "range-of-rank")  # its size is known, so it is broadcast only where it is small
    places = written(held.groupBy(*by, "__range").agg(F.collect_list(F.struct("rank", "__at")).alias("__held")), "ranks")
    rows = dealt.alias("d").join(places.alias("h"), [F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*by, "__range")])
    rows = rows.select(*[F.col(f"d.{c}") for c in (*by, value, "__range")], "__held")
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(value)))
    return rows.select(*by, value, "__r", F.explode("__held").alias("x")).where("__r = x.__at").select(*by, value, "x.rank")


def nearest_rank(df: DataFrame, value: str, p: float, by: list[str]) -> DataFrame:
    """sorted[min(n - 1, floor(p / 100 * n))] of each group: no interpolation."""
    found = at_ranks(df, value, by, lambda n: [F.least(n - 1, F.floor(F.lit(p / 100.0) * n)) + 1])
    return found.select(*by, F.col(value).alias("percentile"))


def median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, median): the middle value of each group, or the mean of the two middle ones; nulls don't count."""
    found = at_ranks(df.where(F.col(value).isNotNull()), value, by, lambda n: [F.floor((n - 1) / 2) + 1, F.floor(n / 2) + 1])
    return found.groupBy(*by).agg(F.avg(value).alias("median"))


def gaps(df: DataFrame, by: str, at: str) -> DataFrame:
    """(by, gap): the time from each row to the one before it of its key, without the first ones.

    Rows are dealt to ascending ranges, so that a key's rows need not be in one task; a range's first row looks at the
    last one of the ranges before.
    """
    dealt = _by_ranges(df.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, at), [by, at])
    ends = dealt.groupBy(by, "__range").agg(F.max(at).alias("__end"))
    ends = written(ends.select(by, "__range", F.lag("__end").over(Window.partitionBy(by).orderBy("__range")).alias("__before")), "range-ends")
    inside = F.lag(at).over(Window.partitionBy(by, "__range").orderBy(at))
    rows = dealt.withColumn("__inside", inside).join(ends, [by, "__range"])
    return rows.select(by, (F.col(at) - F.coalesce("__inside", "__before")).alias("gap")).where("gap is not null")


def run_status(error, skip_reason, failed, recorded) -> Column:
    return F.when(error.isNotNull(), "failed").when(skip_reason.isNotNull(), "skipped").when(failed > 0, F.when(recorded > 0, "partial").otherwise("failed")).otherwise("completed")


def run_health(runs: DataFrame, now: int) -> DataFrame:
    """Per source: 24-hour failures and their rate, gaps between successes, and the alerts that follow.

    `runs` has source, ts_ms, failed. A failure-rate alert needs 3 runs, 2 failures and half of the runs failed; a
    stall needs 4 successes and longer silence than 3 days and 4 median gaps.
    """
    day = (F.col("ts_ms") >= now - DAY_MS) & (F.col("ts_ms") <= now)
    recent = runs.groupBy("source").agg(F.count_if(day).alias("runs"), F.count_if(day & F.col("failed")).alias("failures"))
    good = runs.where(~F.col("failed"))
    middle = median(gaps(good, "source", "ts_ms").where("gap > 0"), "gap", ["source"]).withColumnRenamed("median", "median_gap")
    ends = good.groupBy("source").agg(F.count("*").alias("successes"), F.max("ts_ms").alias("last"))
    rows = recent.join(ends.join(middle, "source", "left"), "source", "left")
    rate = (F.col("runs") >= 3) & (F.col("failures") >= 2) & (F.col("failures") >= 0.5 * F.col("runs"))
    silent = F.lit(now) - F.col("last")
    stalled = (F.col("successes") >= 4) & (silent > F.greatest(F.lit(3.0 * DAY_MS), 4 * F.col("median_gap")))
    return rows.select("source", "runs", "failures", "successes", "median_gap", rate.alias("failing"), F.coalesce(stalled, F.lit(False)).alias("stalled"))


def run_alerts(runs: DataFrame, now: int) -> DataFrame:
    """(source, alert, n, last_ms): what went wrong within the last day, both ends counted.

    `runs`: source, ts_ms, kind, code, status (of the error, or null), records, failed_records. Rate limits are API
    errors of status 429 or that code, authorisation errors those of 401 or 403 or without credentials; internal errors
    by kind; store failures where records failed in a run that did not fail as a whole (no error, or some records).
    """
    rows = runs.where((F.col("ts_ms") >= now - DAY_MS) & (F.col("ts_ms") <= now))
    api = F.coalesce(F.col("kind") == "api_error", F.lit(False))
    whole = F.col("kind").isNotNull() & (F.coalesce("records", F.lit(0)) == 0)
    hits = {
        "rate_limited": api & ((F.col("code") == "rate_limit_error") | (F.col("status") == 429)),
        "auth": (F.col("kind") == "no_auth") | (api & F.col("status").isin(401, 403)),
        "internal_error": F.col("kind") == "internal_error",
        "record_store_failures": ~whole & (F.col("failed_records") > 0),
    }
    alerts = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(a)) for a, c in hits.items()])))
    return rows.select("source", "ts_ms", alerts.alias("alert")).groupBy("source", "alert").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_ms"))
