"""Exact top-k search by inner product, pruned by multi-resolution segment statistics.

Vectors are turned into integers floor(64 x). For segments of s components with means m and deviations d, the
inner product of q and c is at most the sum over segments of s (m_q m_c + d_q d_c): in terms of distances, a lower
bound of |q - c|^2 = |q|^2 + |c|^2 - 2 q.c. Coarse bounds of all pairs of a cell choose each query's first candidates,
whose exact scores give a floor from the start; bounds are then taken coarse to fine (LEVELS segments), a pair is
dropped as soon as its bound is below the floor, and the survivors get exact scores. How many are dropped depends on how
well segments tell the vectors: nearly all pairs of clustered ones, none of vectors whose components are independent.

Queries and candidates are dealt to a grid: a cell holds one group of queries and one of candidates, each of
bounded size, and returns at most k rows a query; a window merges the cells. Ties go to the smaller vec_id.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; vectors of different
lengths are only compared with their like; repeated rows of a vec_id count as candidates each; of a repeated
query the least vector is used, and it never meets its own vec_id; fewer than k candidates give fewer rows; rows without a vec_id take no part; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.runtime import table

K, EVERY, UNIT = 20, 20, 64
QUERY_GROUP, CANDIDATE_GROUP, STEP = 2048, 16_384, 2048
LEVELS = (4, 16)


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of `segments` near-equal segments, each times the root of the segment's length."""
    cuts = np.linspace(0, vectors.shape[1], segments + 1).astype(int)
    cuts = np.unique(cuts)
    size = np.diff(cuts)
    mean = np.add.reduceat(vectors, cuts[:-1], axis=1) / size
    square = np.add.reduceat(vectors**2, cuts[:-1], axis=1) / size
    deviation = np.sqrt(np.maximum(square - mean**2, 0))
    return np.concatenate((mean, deviation), axis=1) * np.sqrt(np.concatenate((size, size)))


def products(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b that are alive; where few are, of these pairs alone (the others are 0)."""
    i, j = np.nonzero(alive) if (few := np.count_nonzero(alive) * 16 < alive.size) else ((), ())
    if not few:
        return a @ b.T
    out = np.zeros(alive.shape)
    out[i, j] = exact(a, b, i, j)
    return out


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of a with the rows j of b."""
    out = np.empty(len(i))
    for at in range(0, len(i), 100_000):
        out[at : at + 100_000] = np.einsum("nd,nd->n", a[i[at : at + 100_000]], b[j[at : at + 100_000]])
    return out


def widest(values: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k greatest values, in no order."""
    return np.argpartition(-values, k - 1, axis=1)[:, :k] if k < values.shape[1] else np.tile(np.arange(values.shape[1]), (len(values), 1))


def floors(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, stats: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """A score that each query's k-th best reaches: the k-th best exact score of its 4k candidates of greatest coarse bound."""
    short = min(4 * k, len(candidates))
    rows = np.arange(len(queries))[:, None]
    bound, at = np.full((len(queries), 0), 0.0), np.zeros((len(queries), 0), np.int64)
    for a in range(0, len(candidates), STEP):
        now = stats[0][0] @ stats[0][1][a : a + STEP].T
        now[own[:, None] == np.arange(a, a + now.shape[1])] = -np.inf
        pick = widest(now, min(short, now.shape[1]))
        bound, at = np.concatenate((bound, now[rows, pick]), axis=1), np.concatenate((at, pick + a), axis=1)
        best = widest(bound, short)
        bound, at = bound[rows, best], at[rows, best]
    score = exact(queries, candidates, np.repeat(rows[:, 0], at.shape[1]), at.ravel()).reshape(at.shape)
    score[~np.isfinite(bound)] = -np.inf
    return np.partition(score, -k, axis=1)[:, -k] if at.shape[1] >= k else np.full(len(queries), -np.inf)


def best_in_cell(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int = K, seen: dict[str, int] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of each query's k best candidates among these. Into `seen` go numbers of pairs.

    Coarse bounds of all pairs choose a few candidates a query, whose exact scores give a floor. Then, level by level,
    only pairs whose bound reaches the floor are looked at again, and only those that pass all levels get exact scores;
    the floor rises with them.
    """
    order = np.argsort(ids, kind="stable")
    ids, candidates = ids[order], candidates[order]
    repeated = len(np.unique(ids)) < len(ids)  # rows of one vec_id: a query may meet itself more than once
    own = np.searchsorted(ids, query_ids)
    own = np.where(ids[np.minimum(own, len(ids) - 1)] == query_ids, own, -1) if not repeated else np.full(len(queries), -1)
    stats = [(segment_statistics(queries, s), segment_statistics(candidates, s)) for s in LEVELS]
    floor = floors(queries, candidates, own, stats, k) if not repeated else np.full(len(queries), -np.inf)
    best, best_id = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    for a in range(0, len(ids), STEP):
        block, block_ids = candidates[a : a + STEP], ids[a : a + STEP]
        alive = query_ids[:, None] != block_ids[None, :]
        for q, c in stats:
            bound = products(q, c[a : a + STEP], alive)
            alive &= bound + 1e-9 * (1 + np.abs(bound)) >= floor[:, None]
        left = np.count_nonzero(alive)
        if seen is not None:
            seen["pairs"], seen["exact"] = seen.get("pairs", 0) + alive.size, seen.get("exact", 0) + left
        if not left:
            continue
        score = products(queries, block, alive)
        score[~alive] = -np.inf
        rows = np.flatnonzero(alive.any(axis=1))
        merged, merged_id = np.concatenate((best[rows], score[rows]), axis=1), np.concatenate((best_id[rows], np.broadcast_to(block_ids, (len(rows), len(block_ids)))), axis=1)
        kth = np.partition(merged, -k, axis=1)[:, [-k]]
        # what is above the k-th best stays, and of its equals those of the smallest ids: they are told apart in a short list
        high = np.count_nonzero(merged >= kth, axis=1).max()
        pick = widest(merged, int(min(high, merged.shape[1])))
        every = np.arange(len(rows))[:, None]
        merged, merged_id = merged[every, pick], merged_id[every, pick]
        top = np.lexsort((merged_id, -merged), axis=1)[:, :k]
        best[rows], best_id[rows] = merged[every, top], merged_id[every, top]
        floor = np.maximum(floor, best[:, -1])
    held = np.isfinite(best)
    return np.repeat(query_ids, held.sum(1)), best_id[held], best[held].astype(np.int64)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * UNIT).cast("double")).alias("v"))
    rows = rows.withColumn("dims", F.size("v"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("q")).first()
    across = max(1, -(-counts["q"] // QUERY_GROUP))
    down = max(-(-counts["n"] // CANDIDATE_GROUP), min(12, -(-counts["n"] // 1024)), 1)
    spread = F.xxhash64("vec_id", "v")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    queries = queries.withColumn("i", F.pmod(spread, F.lit(across)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    places = rows.withColumn("j", F.pmod(spread, F.lit(down)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def cell(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(others):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = best_in_cell(mine["vec_id"].to_numpy(), np.stack(mine["v"]), others["vec_id"].to_numpy(), np.stack(others["v"]), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["i", "j", "dims"]
    found = queries.groupBy(*keys).cogroup(places.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
