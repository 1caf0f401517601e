"""Groups that hold most rows: the same results as plain Python, and no window over a whole group."""

import statistics

from pyspark.sql import functions as F

from keepsake.operators import activity, clusters, packing
from keepsake.plans import context
from keepsake.settings import Settings


def test_gaps_and_median_over_ranges(spark):
    rows = [("hot", (i * 7919) % 100_003) for i in range(5000)] + [("two", 5), ("two", 9), ("one", 3), ("same", 4), ("same", 4), (None, 1), (None, 8), ("odd", 1), ("odd", 2), ("odd", 10), ("odd", None)]
    df = spark.createDataFrame(rows, "source string, at long").repartition(4)
    want = {}
    for k in {r[0] for r in rows if r[0]}:
        at = sorted(t for s, t in rows if s == k and t is not None)
        want[k] = sorted(b - a for a, b in zip(at[:-1], at[1:], strict=True))
    got = activity.gaps(df, "source", "at").groupBy("source").agg(F.sort_array(F.collect_list("gap")).alias("g"))
    assert {r["source"]: r["g"] for r in got.collect()} == {k: g for k, g in want.items() if g}
    found = activity.median(activity.gaps(df, "source", "at"), "gap", ["source"]).collect()
    assert {r["source"]: r["median"] for r in found} == {k: statistics.median(g) for k, g in want.items() if g}
    assert activity.median(activity.gaps(df.where("false"), "source", "at"), "gap", ["source"]).count() == 0


def test_keepers_of_one_large_cluster(spark):
    df = spark.range(20_000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), (F.col("id") % 7).alias("success_count"), (F.col("id") % 11).alias("last_used"), (F.col("id") % 13).alias("ts_ms"))
    found = clusters.keepers(df.select((F.col("ts_ms") % 1).alias("cluster"), "id"), df)
    best = min((-(i % 7), -(i % 11), -(i % 13), f"r{i}") for i in range(20_000))[3]
    assert found.count() == 20_000 and found.select("keeper").distinct().collect() == [(best,)]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_packing_takes_the_first_rows_before_the_sum(spark):
    df = spark.range(10_000).select((F.col("id") % 1).alias("project"), F.col("id").alias("place"), F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.lit("discovery").alias("type"), F.lit("x" * 30).alias("entry"), F.lit(False).alias("deprecated"))
    found = packing.stop_at_overflow(df, F.lit(10), 45, [F.col("id")], ["project"], 8)
    assert [r["id"] for r in found.orderBy("id").collect()] == [f"r{i:06}" for i in range(4)]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    text = context.assemble(df, Settings(max_records=3), "project")
    assert text.first()["ids"] == ["r000000", "r000001", "r000002"] and "WindowGroupLimit" in text._jdf.queryExecution().executedPlan().toString()
