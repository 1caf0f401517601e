"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. One binary classifier a bit (logistic regression over hashed
character 1- to 3-grams) predicts it; loss-weighted decoding picks the codeword of least weighted loss, where a
bit counts for a language as often as it was right on that language's training rows. A small gap between the two
least losses flags the row as ambiguous.

The classifiers are fitted on a bounded sample: at most `per_language` rows a language, chosen by a hash of
doc_id, from rows that are not held out (crc32 of doc_id as text, mod 5, is not 0). Prediction reads only text.

Defined cases: a null text, or one without a letter, is `und` with score 0; with no labelled rows every text is
`und`; with one language every text with a letter has it, with score 1; an empty table gives an empty result;
rows may repeat; very long texts are read whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.batches import map_batches
from keepsake.llm.numerics import code_points, letters, text_slices
from keepsake.runtime import table

DIMS = 4096
PER_LANGUAGE = 500
AMBIGUOUS = 0.02
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(text: str | None) -> np.ndarray | None:
    """Unit-length square roots of hashed n-gram counts; None where no letter is."""
    codes = code_points((text or "").lower())
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, np.uint32(32))
    codes = np.concatenate(([np.uint32(32)], codes, [np.uint32(32)]))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    counts = np.zeros(DIMS)
    hashed = codes * np.uint32(0x9E3779B1)
    for order in range(3):
        if order:
            hashed = hashed[:-1] * np.uint32(31) + codes[order:] * np.uint32(0x85EBCA6B)
        folded = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        counts += np.bincount(folded >> np.uint32(20), minlength=DIMS)
    values = np.sqrt(counts)
    return (values / np.linalg.norm(values)).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords: all distinct splits up to 7 languages, else the best spread of 50 random dense codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = [[1 if j == 0 or (c >> (j - 1)) & 1 else -1 for j in range(n)] for c in range(2 ** (n - 1) - 1)]
        return np.array(bits, float).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = [np.where(rng.random((n, width)) < 0.5, -1.0, 1.0) for _ in range(50)]
    tries = [t[:, np.abs(t.sum(0)) < n] for t in tries]
    spread = lambda t: (t.shape[1] - t @ t.T)[~np.eye(n, dtype=bool)].min()
    return max(tries, key=spread)


def fit(vectors: np.ndarray, labels: np.ndarray, n: int, steps: int = 160, ridge: float = 1e-5) -> dict:
    """Bit classifiers by full-batch gradient steps with momentum, and the weight of each bit for each language."""
    code = codewords(n)
    if not code.shape[1]:
        return {"code": code, "w": np.zeros((DIMS, 0), np.float32), "b": np.zeros(0, np.float32), "trust": np.ones((n, 0))}
    share = np.bincount(labels, minlength=n)
    row = (1.0 / np.maximum(share, 1))[labels]
    row = (row / row.sum()).astype(np.float32)[:, None]
    target = code[labels].astype(np.float32)
    w, b = np.zeros((DIMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        pull = -target / (1 + np.exp(np.clip(target * (vectors @ w + b), -30, 30))) * row
        vw = 0.9 * vw - 12.0 * (vectors.T @ pull + ridge * w)
        vb = 0.9 * vb - 1.0 * pull.sum(0)
        w, b = w + vw, b + vb
    right = (np.sign(vectors @ w + b) == target).astype(float)
    trust = np.array([right[labels == k].mean(0) if (labels == k).any() else np.ones(code.shape[1]) for k in range(n)])
    trust = np.maximum(trust, 1e-3)
    return {"code": code, "w": w, "b": b, "trust": trust / trust.sum(1, keepdims=True)}


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Fits on at most `per_language` rows of each language; each gives its whole text and one short piece of it."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return {"names": [], "code": np.ones((0, 0))}
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, per_language / counts[k]))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = len(text) * 7919 % max(1, len(text) - 60)
                for piece in (text, text[at : at + 20 + len(text) % 60]):
                    if (x := features(piece)) is not None:
                        langs.append(lang)
                        out.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "x"])

    rows = map_batches(chosen.select("lang", "text"), vectors, "lang string, x binary")
    rows = rows.limit(3 * per_language * len(names)).collect()  # the bound holds whatever the hashes are
    if not rows:
        return {"names": names[:1], "code": np.ones((1, 0))} | fit(np.zeros((0, DIMS), np.float32), np.zeros(0, int), 1)
    matrix = np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in rows]).astype(np.float32)
    labels = np.array([names.index(r["lang"]) for r in rows])
    return {"names": names} | fit(matrix, labels, len(names))


def decode(model: dict, vector: np.ndarray | None) -> tuple[str, float, bool]:
    """(language, share of the best codeword, whether the second one is about as near)."""
    names = model["names"]
    if vector is None or not names:
        return UNKNOWN, 0.0, True
    if len(names) == 1:
        return names[0], 1.0, False
    margin = model["code"] * (vector @ model["w"] + model["b"])[None, :]
    loss = (np.logaddexp(0, -margin) * model["trust"]).sum(1)
    order = np.argsort(loss, kind="stable")
    near = np.exp(-(loss - loss[order[0]]) * model["code"].shape[1])
    return names[order[0]], float(1 / near.sum()), bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with lang_pred, lang_score and lang_ambiguous in place of any columns so named."""
    added = ["lang_pred", "lang_score", "lang_ambiguous"]
    docs = docs.drop(*added)
    schema = docs.schema
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # DIMS x bits weights: a size set by the parameters

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_slices(batch):
                found = [decode(shared.value, features(t)) for t in texts]
                columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, *columns], [*batch.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_batches(docs, score, f"{fields}, lang_pred string, lang_score double, lang_ambiguous boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select(
        "doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous")
    )
