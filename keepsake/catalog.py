"""All queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepsake.queries import base, batch, logs, maintaining, measuring, more, plans, reporting, runs, searching, store, streams, upkeeping  # noqa: F401  they register themselves


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine top-k with a prefilter."""
    return searching.topk_cosine(spark, sf_dir)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
