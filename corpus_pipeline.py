"""A corpus pipeline: language, repeated lines, near duplicates, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined cases, for every stage: an empty table gives an empty result; further columns, whatever their names, keep their
values; rows may repeat; texts are read whole. A null text counts as empty, except that language identification drops
it (as every text without a letter). A null doc_id is a document of its own text; a null source is a source of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import byte_pairs, language_id, line_dedup, mixing, near_dedup
from keepsake.runtime import shared_folder, table, written


OWN = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_further_columns(stage: Stage) -> Stage:
    """Further columns go through `stage` under numbered names, so that they can't clash with those the operators use."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"further_{i}_of_input" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])

    return run_stage


@with_further_columns
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or with two languages about as near; fills in an unknown lang."""
    found = language_id.identify(docs, language_id.train(docs))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("lang_ambiguous"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@with_further_columns
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common to three documents stay in the last of them; documents stay, with their new text and n_chars."""
    kept = line_dedup.drop_lines(docs).withColumn("text", F.col("kept_text"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@with_further_columns
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the texts of each group of near copies one stays, that of the smallest doc_id; rows equal to it go too."""
    return near_dedup.keep_first(docs)


@with_further_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixture: the last stage takes their places from the order in the files."""
    return mixing.mix(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, mix_slot, mix_place, n_tokens, ids, and digests of the ids and of the bytes they decode to.

    The place in the mixture is that of the row in the files that mix_sources wrote: sorted by (mix_slot, mix_place) the
    rows are the mixture. Of rows that are not read from files, which have no order, it is worked out again.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select("doc_id", "lang", "source", "text")
    placed = mixing.places_of_files(rows) if docs.inputFiles() else mixing.schedule(rows)
    placed = written(placed.select("doc_id", "lang", "source", "mix_slot", "mix_place", "text"), "placed")
    encoded = byte_pairs.encode(placed, path, public_tokenizers.PATTERN).drop("text")
    both = byte_pairs.decode(encoded, path)
    return both.select(
        "doc_id", "lang", "source", "mix_slot", "mix_place", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mix_sources", mix_sources),
    ("byte_bpe", to_token_ids),
]

# models, minimum-size searches and schedules are not SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
