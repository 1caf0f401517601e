"""Ingest by similarity as a stream: each batch is decided against the table as of the batch before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators import writes
from keepsake.runtime import written
from keepsake.settings import Settings

DELTAS = ("success_count", "failure_count")


def _batches(spark: SparkSession, path: str, before: int, like: DataFrame) -> DataFrame:
    """Rows that the batches before `before` wrote to `path`."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [n for n in range(before) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}/_SUCCESS"))]
    parts = [spark.read.schema(like.schema).parquet(f"{path}/batch={n}") for n in found]
    return reduce(DataFrame.unionByName, parts, like.limit(0))


def as_of(table: DataFrame, path: str, batch: int) -> DataFrame:
    """`table` with what the batches before `batch` inserted and changed.

    An update adds its counts, lifts the scope to global, and fills in a missing project. Changes are kept as rows and
    summed here, so a batch writes only what is new.
    """
    spark = table.sparkSession
    changes = table.select(F.col("id").alias("target"), *DELTAS, F.lit(True).alias("to_global"), "project", "seq")
    changes = _batches(spark, f"{path}/changes", batch, changes)
    sums = changes.groupBy("target").agg(
        *[F.sum(c).alias(f"__{c}") for c in DELTAS], F.max("to_global").alias("__global"),
        F.min_by("project", F.when(F.col("project").isNotNull(), F.col("seq"))).alias("__project"),
    )
    rows = table.unionByName(_batches(spark, f"{path}/inserted", batch, table)).join(sums, F.col("id") == F.col("target"), "left").drop("target")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in DELTAS})
    rows = rows.withColumn("scope", F.when(F.col("__global"), "global").otherwise(F.col("scope"))).withColumn("project", F.coalesce("project", "__project"))
    return rows.select(*table.columns)


def ingest_batch(new: DataFrame, table: DataFrame, path: str, batch: int, s: Settings) -> None:
    """Decides the batch's records against the table as of the batch before, and writes what it does in its own folders.

    A batch that comes again finds the same table and replaces its own folders with the same rows.
    """
    now = as_of(table, path, batch)
    new = written(new.select(*table.columns), "ingest-batch")
    found = written(writes.ingest(new, now, s), "ingest-found")
    found.write.mode("overwrite").parquet(f"{path}/actions/batch={batch}")
    fresh = new.join(found.where("action = 'insert'").select("id"), "id", "left_semi").select(*table.columns)
    fresh.write.mode("overwrite").parquet(f"{path}/inserted/batch={batch}")
    changed = found.where("action = 'update'").select("id", "target").join(new, "id")
    changed = changed.select("target", *DELTAS, F.coalesce(F.col("scope") == "global", F.lit(False)).alias("to_global"), "project", "seq")
    changed.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")


def ingest_stream(records: DataFrame, table: DataFrame, path: str, checkpoint: str, s: Settings):
    """Starts the stream over all there is; `path` gets folders actions, inserted and changes by batch."""
    return (
        records.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, table, path, batch, s))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def actions(spark: SparkSession, path: str) -> DataFrame:
    """What all batches did: id, action, target, similarity, batch."""
    return spark.read.parquet(f"{path}/actions")
