"""The record table's schema and its additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELATION = T.StructType([
    T.StructField("target_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.DoubleType()),
    T.StructField("created_at", T.LongType()), T.StructField("last_reinforced_at", T.LongType()), T.StructField("reinforcement_count", T.LongType()),
])

_TEXT = ["id", "type", "content", "exact_text", "project", "scope"]
_COUNTS = ["timestamp", "success_count", "failure_count", "retrieval_count", "usage_count", "last_used"]
_CHECKS = [
    "last_generalization_check", "last_global_check", "last_consolidation_check", "last_conflict_check",
    "last_currentness_check", "last_warning_synthesis_check",
]

RECORDS = T.StructType([
    *[T.StructField(c, T.StringType(), False) for c in _TEXT],
    *[T.StructField(c, T.LongType(), False) for c in _COUNTS],
    T.StructField("deprecated", T.BooleanType(), False), T.StructField("deprecated_at", T.LongType()),
    T.StructField("deprecated_reason", T.StringType()), T.StructField("superseding_record_id", T.StringType()),
    T.StructField("generalized", T.BooleanType(), False),
    *[T.StructField(c, T.LongType(), False) for c in _CHECKS],
    T.StructField("source_session_id", T.StringType()), T.StructField("source_excerpt", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType()), False),
])

# payload fields of all five types in one wide struct; `type` says which count
PAYLOAD = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (
        "command", "outcome", "resolution", "errorText", "errorType", "cause", "what", "where", "evidence", "confidence",
        "name", "verification", "avoid", "useInstead", "reason", "severity",
    )],
    T.StructField("exitCode", T.LongType()), T.StructField("steps", T.ArrayType(T.StringType())),
    T.StructField("context", T.StructType([T.StructField(c, T.StringType()) for c in ("project", "cwd", "intent", "file", "tool")])),
])

DEFAULTS = {"deprecated": False, "generalized": False, "scope": "project", **dict.fromkeys([*_COUNTS, *_CHECKS], 0)}


def migrate(df: DataFrame, schema: T.StructType = RECORDS) -> DataFrame:
    """`df` with every column of `schema`, in its order: missing ones get their default or a typed null, others go."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
