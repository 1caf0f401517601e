"""Re-ranking and packing of results under budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.operators import vectors
from keepsake.runtime import written


def stop_at_overflow(df: DataFrame, size: Column, budget: int | Column, order: list[Column], by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The longest prefix in `order` whose sizes sum to at most `budget`; what follows the first overflow is out.

    Sizes are not negative, so the running sum says where that is. `by` packs each group on its own.
    """
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    rows = df.withColumn("tokens", size).withColumn("place", F.row_number().over(w))
    if most is not None:  # taken before rows are shuffled, so a group has at most so many rows in the running sum
        rows = rows.where(F.col("place") <= most)
    return rows.withColumn("running", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("running") <= budget)


def ranked(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """`columns` of all rows with their `place` in a total order, counted from 1.

    Rows are dealt to ascending ranges of the order and numbered inside them, from the sizes of the ranges before, so
    no task holds more than its range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    base, total = [], 0
    for r in sorted(dealt.groupBy("__range").count().collect()):  # one number a range
        base.append((r["__range"], total))
        total += r["count"]
    bases = spark.createDataFrame(base, "__range int, __base long")
    place = F.col("__base") + F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(bases), "__range").withColumn("place", place).select(*columns, "place")


def newest_within(df: DataFrame, size: Column, budget: int, order: list[Column], by: list[str]) -> DataFrame:
    """The longest suffix (`order` is newest first) within the budget, and the newest row in any case."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("size", size).withColumn("running", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("place", F.row_number().over(w)).where((F.col("running") <= budget) | (F.col("place") == 1))


def maximal_marginal_relevance(df: DataFrame, limit: int | str, weight: float | str, by: str | list[str] = "query_id") -> DataFrame:
    """(by, id, rank): the best score first, then the best of weight * score - (1 - weight) * similarity to the chosen.

    Ties go to the better score, then the smaller id; rows without a vector come last. Each query is one small group.
    `limit` and `weight` may name columns that are constant within a query.
    """
    by = [by] if isinstance(by, str) else list(by)
    df = df.withColumns({"__limit": F.col(limit) if isinstance(limit, str) else F.lit(limit), "__weight": F.col(weight) if isinstance(weight, str) else F.lit(float(weight))})

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        limit, weight = int(rows["__limit"].iloc[0]), float(rows["__weight"].iloc[0])
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        has = rows["embedding"].map(lambda v: v is not None and len(v) > 0).to_numpy()
        order: list[int] = []
        if has.any():
            at = np.flatnonzero(has)
            x = np.stack([np.asarray(v, float) for v in rows.loc[has, "embedding"]])
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
            score, near, free = rows.loc[has, "score"].to_numpy(float), np.full(len(at), -np.inf), np.ones(len(at), bool)
            while free.any() and len(order) < limit:
                gain = score if not order else weight * score - (1 - weight) * near
                best = int(np.argmax(np.where(free, gain, -np.inf)))
                order.append(int(at[best]))
                free[best] = False
                near = np.maximum(near, x @ x[best])
        order = [*order, *np.flatnonzero(~has)][: max(0, limit)]
        out = rows.loc[order, [*by, "id"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "id string, rank int"])
    return df.select(*by, "id", "score", "embedding", "__limit", "__weight").groupBy(*by).applyInPandas(pick, schema)


def diversity_exclusions(pool: DataFrame, chosen: DataFrame, limit: int, weight: float, by: str = "query_id") -> DataFrame:
    """(by, id, threshold, actual, gap, similar_to, similarity): the best `limit` by score that variety left out, and why.

    `pool`: by, id, score, similarity, embedding; `chosen`: by, id, rank. `actual` is the row's value against all chosen
    rows, `threshold` that of the row chosen last against those before it (of the only one chosen: its weighted score), and
    `similar_to` the chosen row it is nearest to, the earliest of equally near ones. Pools are small.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.desc("similarity"), "id"))
    taken = chosen.join(pool.select(by, "id", F.col("score").alias("__score"), F.col("embedding").alias("__e")), [by, "id"]).select(by, F.col("id").alias("__id"), "rank", "__score", "__e")
    out = pool.withColumn("__place", place).where(F.col("__place") <= limit).join(chosen.select(by, "id"), [by, "id"], "left_anti")
    near = out.join(taken, by).withColumn("__near", vectors.cosine(F.col("embedding"), F.col("__e")))
    best = F.max_by(F.struct(F.col("__id").alias("similar_to"), F.col("__near").alias("similarity")), F.struct("__near", -F.col("rank")))
    rows = near.groupBy(by, "id", "score").agg(best.alias("x")).select(by, "id", "score", "x.similar_to", "x.similarity")
    last = taken.withColumn("__last", F.max("rank").over(Window.partitionBy(by))).where("rank = __last")
    before = last.select(by, "__last", F.col("__score").alias("s"), F.col("__e").alias("e")).join(taken, by, "left").where("rank < __last or __last = 1")
    value = F.when(F.first("__last") == 1, weight * F.first("s")).otherwise(weight * F.first("s") - (1 - weight) * F.max(vectors.cosine(F.col("e"), F.col("__e"))))
    limits = before.groupBy(by).agg(value.alias("threshold"))
    actual = weight * F.col("score") - (1 - weight) * F.col("similarity")
    return rows.join(limits, by).select(by, "id", "threshold", actual.alias("actual"), (F.col("threshold") - actual).alias("gap"), "similar_to", "similarity")
