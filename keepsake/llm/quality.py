"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

A text gives the statistics named in STATISTICS, each transformed towards symmetry. For labels 0 and 1 their mean and
covariance are summed over all labelled training rows by Spark; each covariance is shrunk towards the pooled one
and that towards a multiple of the identity. A score is the logistic of the difference of the two Gaussian log
densities (Mahalanobis distances from cached Cholesky factors) plus the log prior odds.

Training rows are those whose crc32 of doc_id as text, mod 5, is not 0. A score reads only the text.

Defined cases: null and empty texts have all-zero statistics and a score like any other; where training has no
row of a class, every score is the share of label 1 (0.5 without any rows); labels other than 0 and 1 count as
none; repeated label rows count each time; an empty table gives an empty result; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.batches import map_batches
from keepsake.llm.language_id import held_out
from keepsake.llm.numerics import code_points, letters, polynomial_sums, spaces, text_slices, word_signs
from keepsake.runtime import table, written

STATISTICS = (
    "log_chars", "letters", "capitals", "blanks", "digits", "common_marks", "other_marks", "exclamations", "bars",
    "newlines", "repeated_words", "distinct_words", "word_length", "word_spread", "short_words", "capital_words",
)
POOLED, SPHERE, THRESHOLD = 0.1, 0.02, 0.3


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS a text, for all texts at once."""
    n = len(texts)
    codes = code_points("\n".join(texts) + "\n")
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    end = np.cumsum(sizes) - 1
    real = np.ones(len(codes), bool)
    real[end] = False
    per = lambda mask: np.bincount(owner[mask & real], minlength=n).astype(float)
    is_letter, is_space, is_word = letters()[codes], spaces()[codes], word_signs()[codes]
    upper = is_letter & np.array([chr(c).isupper() for c in range(0x250)] + [False], bool)[np.minimum(codes, 0x250)]
    chars = np.maximum(sizes - 1.0, 0)
    some = np.maximum(chars, 1)
    common = np.isin(codes, np.array([ord(c) for c in ".,;:'\"?-()"], np.uint32))
    exclaim, bar = codes == ord("!"), codes == ord("|")
    other = ~is_word & ~is_space & ~common & ~exclaim & ~bar
    edge = np.diff((is_word & real).astype(np.int8), prepend=0, append=0)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    mine, length = owner[begin], (stop - begin).astype(float)
    words = np.bincount(mine, minlength=n).astype(float)
    count = np.maximum(words, 1)
    lowered = np.where(upper & (codes < 0x80), codes + 32, codes)
    sums, down = polynomial_sums(lowered)
    with np.errstate(over="ignore"):
        hashed = (sums[stop] - sums[begin]) * down[begin]
    again = (hashed[1:] == hashed[:-1]) & (mine[1:] == mine[:-1])
    order = np.lexsort((hashed, mine))
    first = np.ones(len(order), bool)
    first[1:] = (hashed[order][1:] != hashed[order][:-1]) | (mine[order][1:] != mine[order][:-1])
    distinct = np.bincount(mine[order][first], minlength=n)
    mean = np.bincount(mine, length, n) / count
    spread = np.sqrt(np.maximum(np.bincount(mine, length**2, n) / count - mean**2, 0))
    share = lambda mask: np.sqrt(per(mask) / some)
    columns = [
        np.log1p(chars), per(is_letter) / some, np.sqrt(per(upper) / np.maximum(per(is_letter), 1)), per(is_space) / some,
        share(is_word & ~is_letter), share(common), share(other), share(exclaim), share(bar), share(codes == 10),
        np.sqrt(np.bincount(mine[1:][again], minlength=n) / count), np.log1p(distinct) / np.log1p(count) * (words > 0), np.log1p(mean), np.log1p(spread),
        np.bincount(mine[length <= 3], minlength=n) / count, np.sqrt(np.bincount(mine[upper[begin]], minlength=n) / count),
    ]
    return np.stack(columns, axis=1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and `stats` (little-endian float32 of STATISTICS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_slices(batch):
                rows = [r.tobytes() for r in statistics(texts).astype("<f4")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), pa.array(rows, pa.binary())], ["doc_id", "stats"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, stats binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, len(STATISTICS)).astype(float)


def moments(stats: DataFrame, labels: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(rows, sums, sums of products) a label, over all labelled rows that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("labelled"), "quality")
    rows = stats.where(~held_out()).join(known, F.col("doc_id") == F.col("labelled")).select("stats", F.col("quality").cast("int").alias("label"))
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (d + 1) * (d + 1)))
        for batch in batches:
            x = np.concatenate((np.ones((batch.num_rows, 1)), _matrix(batch.column("stats"))), axis=1)
            label = batch.column("label").to_numpy()
            for k in (0, 1):
                total[k] += (x[label == k].T @ x[label == k]).ravel()
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "value"])

    found = map_batches(rows, run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 * (d + 1) ** 2)
    for r in found:  # two classes of (d + 1)^2 numbers
        total[r["at"]] = r["value"]
    both = total.reshape(2, d + 1, d + 1)
    return {k: (both[k][0, 0], both[k][0, 1:], both[k][1:, 1:]) for k in (0, 1)}


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> dict:
    """Means, inverse Cholesky factors and log determinants of both classes, and the log prior odds."""
    n = {k: s[0] for k, s in sums.items()}
    if min(n.values()) < 2:
        return {"constant": float(n[1] / sum(n.values())) if sum(n.values()) else 0.5}
    mean = {k: s[1] / s[0] for k, s in sums.items()}
    cov = {k: s[2] / s[0] - np.outer(mean[k], mean[k]) for k, s in sums.items()}
    total = sum(n.values())
    centre = (sums[0][1] + sums[1][1]) / total
    scale = np.sqrt(np.maximum((sums[0][2] + sums[1][2]).diagonal() / total - centre**2, 1e-8))
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total / np.outer(scale, scale)
    model: dict = {"centre": centre, "scale": scale, "odds": float(np.log(n[1] / n[0]))}
    for k in (0, 1):
        own = (1 - POOLED) * cov[k] / np.outer(scale, scale) + POOLED * pooled
        own = (1 - SPHERE) * own + SPHERE * np.trace(own) / len(own) * np.eye(len(own))
        factor = np.linalg.cholesky(own)
        model[k] = ((mean[k] - centre) / scale, np.linalg.inv(factor), 2 * np.log(factor.diagonal()).sum())
    return model


def scores(model: dict, stats: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(stats), model["constant"])
    x = (stats - model["centre"]) / model["scale"]
    density = []
    for k in (0, 1):
        mean, inverse, log_det = model[k]
        density.append(-0.5 * ((((x - mean) @ inverse.T) ** 2).sum(1) + log_det))
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + model["odds"], -500, 500)))


def score_documents(stats: DataFrame, model: dict) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(shared.value, _matrix(batch.column("stats"))))], ["doc_id", "score"])

    return map_batches(stats, run, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(with_statistics(table(spark, sf_dir, "documents")), "statistics")
    found = score_documents(stats, fit(moments(stats, table(spark, sf_dir, "labels"))))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
