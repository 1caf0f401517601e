"""Event logs, keyed JSON documents and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("timestamp", T.LongType()),
    T.StructField("groupId", T.StringType()), T.StructField("coInjectedIds", T.ArrayType(T.StringType())),
])
BLOCK = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "text", "id", "name", "input", "tool_use_id", "content")])
LINE = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("cwd", T.StringType()),
    T.StructField("isSidechain", T.BooleanType()), T.StructField("isMeta", T.BooleanType()),
    T.StructField("message", T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])),
])


def write_events(events: DataFrame, path: str, now: int) -> None:
    """Appends JSON lines, one folder a UTC day; an event without a finite time is put at `now`."""
    ms = F.coalesce(F.col("timestamp"), F.lit(now))
    day = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
    events.withColumn("timestamp", ms).withColumn("date", day).write.partitionBy("date").mode("append").json(path)


def read_events(spark: SparkSession, path: str, since_ms: int | None = None, schema: T.StructType = EVENT) -> DataFrame:
    """Events; lines that don't parse are left out, and days before `since_ms` aren't read."""
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("date", T.StringType())])).option("mode", "DROPMALFORMED").json(path)
    if since_ms is not None:
        day = F.date_format(F.timestamp_millis(F.lit(since_ms)), "yyyy-MM-dd")
        found = found.where((F.col("date") >= day) & (F.col("timestamp") >= since_ms))
    return found


def days(spark: SparkSession, path: str) -> DataFrame:
    return read_events(spark, path).select("date").distinct()


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document a file, with `key`: the file's name without its ending."""
    key = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("key", key)


# fixed values: who uses tokens, and the counts of a use
TOKEN_SOURCES = ("extraction", "haiku-query", "usefulness-rating", "maintenance")
TOKEN_COUNTS = ("inputTokens", "outputTokens", "cacheCreationInputTokens", "cacheReadInputTokens")


def token_events(raw: DataFrame) -> DataFrame:
    """Uses of tokens fit to be kept: those of a known source, with whole counts of at least 0 and a named model.

    A count that is missing or no number is 0; uses without any token go, as do blank optional ids.
    """
    whole = lambda c: F.greatest(F.lit(0), F.coalesce(F.expr(f"try_cast(try_cast(`{c}` as double) as long)"), F.lit(0)))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    rows = raw.where(F.col("source").isin(*TOKEN_SOURCES)).withColumns({c: whole(c) for c in TOKEN_COUNTS if c in raw.columns})
    rows = rows.withColumn("model", F.coalesce(blank("model"), F.lit("unknown"))).withColumns({c: blank(c) for c in ("sessionId", "runId") if c in raw.columns})
    return rows.where(sum((F.col(c) for c in TOKEN_COUNTS if c in raw.columns), F.lit(0)) > 0)


def parse_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, errors): how many lines of each transcript are neither blank nor JSON."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    bad = (F.col("value") != "") & F.expr("try_parse_json(value)").isNull()
    return lines.groupBy("file").agg(F.count_if(bad).alias("errors"))


def transcript(spark: SparkSession, path: str, marker: str | None = None) -> DataFrame:
    """file, line, place, kind (user, assistant, tool_call, tool_result), text, tool_id, name, input of transcripts' lines.

    Side chains, meta lines (but those whose list of blocks holds `marker`) and lines that don't parse are skipped. A result takes the name and input of the latest
    earlier call of its id in its file; only rows with an id are brought together for that.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.from_json("value", LINE).alias("x")).where("x.type is not null")
    content = F.ltrim("x.message.content")
    marked = F.lit(False) if marker is None else F.coalesce((content.startswith("[") | content.startswith("{")) & F.contains("x.message.content", F.lit(marker)), F.lit(False))
    lines = lines.where(~F.coalesce("x.isSidechain", F.lit(False)) & (~F.coalesce("x.isMeta", F.lit(False)) | marked))
    blocks = F.from_json("x.message.content", T.ArrayType(BLOCK))
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("x.message.content").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")]))
    is_list = F.ltrim("x.message.content").startswith("[")
    rows = lines.select("file", "line", F.col("x.message.role").alias("role"), F.posexplode(F.when(is_list, F.coalesce(blocks, plain)).otherwise(plain)).alias("place", "b"))
    kind = F.when(F.col("b.type") == "tool_use", "tool_call").when(F.col("b.type") == "tool_result", "tool_result").otherwise(F.col("role"))
    rows = rows.select("file", "line", "place", kind.alias("kind"), F.coalesce("b.text", "b.content").alias("text"), F.coalesce("b.tool_use_id", "b.id").alias("tool_id"), "b.name", "b.input")
    w = Window.partitionBy("file", "tool_id").orderBy("line", "place").rowsBetween(Window.unboundedPreceding, 0)
    call = F.when(F.col("kind") == "tool_call", F.struct("name", "input"))
    own = rows.where("tool_id is null").withColumn("call", F.lit(None).cast("struct<name: string, input: string>"))
    rows = own.unionByName(rows.where("tool_id is not null").withColumn("call", F.last(call, ignorenulls=True).over(w)))
    from_call = lambda c: F.when(F.col("kind") == "tool_result", F.col(f"call.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("file", "line", "place", "kind", "text", "tool_id", from_call("name"), from_call("input"))
