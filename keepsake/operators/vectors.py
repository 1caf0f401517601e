"""Exact cosine search and similarity joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.runtime import written

# rows of the seeds and of the pool in a cell of the similarity join, and of those worked on at a time
SEEDS, GROUP, BLOCK = 16_384, 131_072, 512
# where each seed may have more neighbours than MANY, both sides of a cell have at most SMALL rows
MANY, SMALL = 1024, 4096
# a cell of more than PAIRS pairs is cut into further groups of seeds, up to SPREAD
PAIRS, SPREAD = 2**29, 24


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty and zero vectors and for different lengths."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size), F.lit(0.0))


def cosine_to(vector: list[float], column: str = "embedding") -> Column:
    """Cosine with one query vector, whose norm is worked out once."""
    length = math.sqrt(sum(x * x for x in vector))
    if not vector or length == 0:
        return F.lit(0.0)
    other = F.array(*[F.lit(x / length) for x in vector])
    own = norm(F.col(column))
    return F.coalesce(F.when((F.size(column) == len(vector)) & (own > 0), dot(F.col(column), other) / own), F.lit(0.0))


def max_cosine_to(vectors: list[list[float]], column: str = "embedding") -> Column:
    return F.greatest(F.lit(0.0), *[cosine_to(v, column) for v in vectors], F.lit(0.0))


def top_k(df: DataFrame, vector: list[float], k: int, threshold: float | None = None, where: Column | None = None) -> DataFrame:
    """The k most similar of the rows that pass `where`, then those at or above the threshold: `similarity`."""
    rows = df if where is None else df.where(where)
    found = rows.withColumn("similarity", cosine_to(vector)).where(~F.isnan("similarity"))
    found = found.orderBy(F.desc("similarity"), "id").limit(k)
    return found if threshold is None else found.where(F.col("similarity") >= threshold)


def valid(column: str = "embedding") -> Column:
    """Whether there is a vector: not empty, all components finite, not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def neighbours(
    seeds: DataFrame, pool: DataFrame, k: int, threshold: float, same: tuple[str, ...] = (), differ: str | None = None, or_global: bool | str = False
) -> DataFrame:
    """(id, other, similarity, rank): for each seed the k most similar rows of the pool at or above the threshold.

    `same` columns must be equal, `differ` unequal; with `or_global` the first of `same` may differ where the pool's
    row has global scope or the seed has (`or_global="pool"`: only where the pool's row has). Rows without a valid vector
    take no part, and vectors are compared with those of their length. Equal similarities go to the smaller `other`.

    Global rows are compared in joins of their own, so only they meet other groups. Both sides of a join are dealt to
    cells of bounded size: a grid inside equal `same` values, sized by that group, so rows of small groups are not
    copied. A cell is worked through in blocks of rows, keeps at most k a seed, and a window merges the cells. All pairs
    are compared, so products grow with the square of a group; what is shuffled is a row for every SEEDS rows of the
    other side.
    """
    keep = ["id", "embedding", *dict.fromkeys([*same, *([differ] if differ else []), *(["scope"] if or_global else [])])]
    seeds, pool = (df.select(*[F.col(c).alias(c) for c in keep]).where(valid()).withColumn("dims", F.size("embedding")) for df in (seeds, pool))  # new columns, also of one table
    unlike = (differ,) if differ else ()
    found = _grid(seeds, pool, k, threshold, same, unlike)
    if or_global:
        rest, unlike, far = same[1:], (*unlike, same[0]), F.col("scope") == "global"
        found = found.unionByName(_grid(seeds, pool.where(far), k, threshold, rest, unlike))
        if or_global != "pool":
            found = found.unionByName(_grid(seeds.where(far), pool.where(~F.coalesce(far, F.lit(False))), k, threshold, rest, unlike))
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_of_each_row(close: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k greatest finite values; of equal ones at the end the leftmost."""
    if k >= close.shape[1]:
        return np.nonzero(np.isfinite(close))
    least = np.partition(close, close.shape[1] - k, axis=1)[:, [close.shape[1] - k]]
    above, equal = close > least, close == least
    spare = k - above.sum(1, keepdims=True)
    return np.nonzero((above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= spare))) & np.isfinite(close))


def cosines(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Products of the rows of x with the columns of y, which do not depend on where these are."""
    out = np.empty(len(rows))
    for a in range(0, len(rows), 8192):
        out[a : a + 8192] = np.einsum("nd,nd->n", x[rows[a : a + 8192]], y[cols[a : a + 8192]])
    return out


def places_reaching(close: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the values that reach their row's `low`; rows whose greatest value doesn't are not searched."""
    low = low.astype(close.dtype)
    some = np.flatnonzero(close.max(axis=1) >= low)
    rows, cols = np.divmod(np.flatnonzero(close[some] >= low[some, None]), close.shape[1])
    return some[rows], cols


def first_copies(y: np.ndarray, codes: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the rows of y that can be among a seed's k best: of rows equal in vector and in all codes but the first,
    that of the id, those of the k + 1 smallest ids, as one may be the seed's own. Rows are in the order of their ids."""
    salt = np.random.default_rng(0).integers(1, 2**62, y.shape[1], dtype=np.int64) * 2 + 1
    rows = pd.DataFrame({"vector": ((y + 0.0).view(np.int64) * salt).sum(axis=1), **{str(i): c for i, c in enumerate(codes[1:])}})
    groups = rows.groupby(list(rows.columns), sort=False)
    if groups.size().max() <= k + 1:
        return np.arange(len(y))
    group = groups.ngroup().to_numpy()
    lead = np.unique(group, return_index=True)[1][group]
    _, first, which = np.unique(codes[0], return_index=True, return_inverse=True)
    place = pd.Series(first[which]).groupby(group, sort=False).rank("dense").to_numpy()  # first places of ids are in their order
    return np.flatnonzero((place <= k + 1) | (y != y[lead]).any(axis=1))


def best_in_cell(x: np.ndarray, y: np.ndarray, mine: list[np.ndarray], others: list[np.ndarray], k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, cosine): of each row of x the k rows of y of greatest cosine at or above the threshold, of equal ones the leftmost; pairs that agree in a code of `mine` and `others` take no part. Vectors are of length one.

    Products in single precision tell which pairs can be among these: those that reach the row's floor, the k-th best so
    far, but for the error of such a product. These pairs alone get products in double precision.
    """
    error = (x.shape[1] + 4) * 2.0**-23  # twice the bound for unit vectors
    thin_x, thin_y, parts = x.astype(np.float32), y.astype(np.float32), []
    for a in range(0, len(x), BLOCK):
        n = min(BLOCK, len(x) - a)
        floor, found, waiting = np.full(n, float(threshold)), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        for c in range(0, len(y), BLOCK):
            m = min(BLOCK, len(y) - c)
            close = thin_x[a : a + n] @ thin_y[c : c + m].T
            rows, cols = places_reaching(close, floor - error)
            if len(rows) > 4 * k * n:  # many: the block's own k-th best is a floor
                for u, v in zip(mine, others, strict=True):
                    close[u[a : a + n, None] == v[None, c : c + m]] = -np.inf
                floor = np.maximum(floor, np.partition(close, m - k, axis=1)[:, m - k] - error)
                rows, cols = places_reaching(close, floor - error)
            for u, v in zip(mine, others, strict=True):
                unlike = u[rows + a] != v[cols + c]
                rows, cols = rows[unlike], cols[unlike]
            value = cosines(x, y, rows + a, cols + c)
            enough = value >= floor[rows]
            rows, cols, value = rows[enough], cols[enough], value[enough]
            if len(rows) > 4 * k * n:  # still many: about as near as each other
                whole = np.full((n, m), -np.inf)
                whole[rows, cols] = value
                rows, cols = best_of_each_row(whole, k)
                value = whole[rows, cols]
            found.append((rows, cols + c, value))
            waiting += len(rows)
            if waiting > 2 * k * n or (k < len(y) and c + m == len(y)):
                rows, cols, value = (np.concatenate(p) for p in zip(*found, strict=True))
                order = np.lexsort((cols, -value, rows))
                rows, cols, value = rows[order], cols[order], value[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                last = place == k - 1
                floor[rows[last]] = value[last]
                found, waiting = [(rows[place < k], cols[place < k], value[place < k])], 0
        parts += [(rows + a, cols, value) for rows, cols, value in found]
    rows, cols, value = (np.concatenate(p) for p in zip(*parts, strict=True))
    return rows, cols, value


def _grid(seeds: DataFrame, pool: DataFrame, k: int, threshold: float, same: tuple[str, ...], unlike: tuple[str, ...]) -> DataFrame:
    """(id, other, similarity): at most k a seed and cell, `same` and dims equal, `unlike` columns different."""
    fixed = ("dims", *same)
    group = F.struct(*fixed)
    rows_of = lambda df, name: df.groupBy(group.alias("g")).agg(F.count("*").alias(name))
    a, b = (min(most, GROUP) for most in ((SEEDS, GROUP) if k <= MANY else (SMALL, SMALL)))
    ni = F.greatest(F.ceil(F.col("seeds") / a), F.least(F.ceil(F.col("seeds").cast("double") * F.col("pool") / PAIRS), F.lit(SPREAD), F.col("seeds")))
    # written first, so that the rows' join alone is dealt by group and a hot one can be split
    sizes = rows_of(seeds, "seeds").join(rows_of(pool, "pool"), "g")
    sizes = written(sizes.select("g", ni.cast("int").alias("ni"), F.ceil(F.col("pool") / b).cast("int").alias("nj")), "grid-sizes")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = seeds.withColumn("g", group).join(sizes, "g").withColumn("i", deal("ni")).withColumn("j", every("nj")).drop("g", "ni", "nj")
    right = pool.withColumn("g", group).join(sizes, "g").withColumn("j", deal("nj")).withColumn("i", every("ni")).drop("g", "ni", "nj")

    def unit(rows: pd.DataFrame) -> np.ndarray:
        x = np.stack(rows["embedding"].to_numpy()).astype(float)
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # so that no square is out of range
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def cell(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(others):
            return pd.DataFrame({"id": [], "other": [], "similarity": []}).astype({"id": object, "other": object, "similarity": float})
        others = others.sort_values("id", kind="stable")  # so that the leftmost of equal values is the smaller id
        n, y = len(mine), unit(others)
        codes = [pd.factorize(np.concatenate((mine[c].to_numpy(object), others[c].to_numpy(object))))[0] for c in ("id", *unlike)]
        own, their = [c[:n] for c in codes], [c[n:] for c in codes]
        kept = first_copies(y, their, k)
        rows, cols, close = best_in_cell(unit(mine), y[kept], own, [c[kept] for c in their], k, threshold)
        return pd.DataFrame({"id": mine["id"].to_numpy(object)[rows], "other": others["id"].to_numpy(object)[kept[cols]], "similarity": close})

    keys = [*fixed, "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "id string, other string, similarity double")
