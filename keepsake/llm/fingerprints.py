"""Document fingerprints: a canonical exact digest.

A text is normalised (Unicode NFKC), case-folded and its white space folded; four seeded 64-bit xxhash lanes
over the result make a 256-bit fingerprint. `exact_groups` groups equal fingerprints and compares the canonical
bytes inside each bucket, so that texts which merely collide land in different groups. The digest is exact:
the likeness of two fingerprints is 1 where they (and the canonical bytes) are equal, else 0.

Defined cases: a null text counts as empty; an empty table gives an empty result; rows may repeat (they share
a group); rows with equal doc_id are ordered by fingerprint; a null doc_id sorts below all others; further
columns of the input are ignored. Everything here is DataFrame functions; NFKC is a method of a class in Spark's own jars,
called in the JVM by reflection (outside code generation), as Spark has no function for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.runtime import table, written

LANES = 4


def canonical(text: Column) -> Column:
    """NFKC, upper then lower case (so that one-to-many folds agree), runs of white space to one blank, trimmed."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.trim(F.regexp_replace(F.lower(F.upper(composed)), r"(?U)\s+", " "))


def wide_digest(canon: Column, lanes: int = LANES) -> Column:
    """`lanes` xxhash64 values of differently seeded runs, as one binary."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(lane), canon)), 16, "0")) for lane in range(lanes)])


def _order_buckets(keyed: DataFrame, key: str, buckets: int) -> Column | None:
    """A bucket number that rises with `key`, from approximate quantiles of it: two short searches in literals."""
    side = max(2, int(buckets**0.5))
    cuts = keyed.agg(F.percentile_approx(key, [i / (side * side) for i in range(1, side * side)], 100_000)).first()[0]
    if cuts is None:
        return None
    coarse = cuts[side - 1 :: side]
    fine = [cuts[i * side : i * side + side - 1] for i in range(side)]
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    at = F.size(F.filter(longs(coarse), lambda c: c <= F.col(key)))
    within = F.size(F.filter(F.element_at(F.array(*[longs(f) for f in fine]), at + 1), lambda c: c <= F.col(key)))
    return at * side + within


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def with_next(docs: DataFrame, marks: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Columns key, doc_id, text, digest, next_text, next_digest, first_key: next means by descending doc_id.

    Ids are dealt to quantile buckets; every bucket also gets a copy of the row that follows its last one, so that
    `lead` never leaves the bucket and no task holds more than its share of the order. `marks` (key, digest,
    first_key) travel to the same buckets and set first_key on their rows without another shuffle of texts.
    """
    spark = docs.sparkSession
    plain = _keyed(docs)
    bucket = _order_buckets(plain, "key", buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    digested = lambda df: df.withColumn("canon", canonical(F.col("text"))).withColumn("digest", wide_digest(F.col("canon"))).drop("canon")
    rows = digested(plain)
    if bucket is None:
        empty = rows.select("*", F.lit("").alias("next_text"), F.col("digest").alias("next_digest"), F.lit(0).cast("long").alias("first_key"))
        return empty.where(F.lit(False))
    # at most `buckets` rows: the largest key of each bucket
    firsts = rows.select("key", bucket.alias("bucket")).groupBy("bucket").agg(F.max("key").alias("key")).collect()
    firsts = sorted((r["bucket"], r["key"]) for r in firsts)
    edge = spark.createDataFrame([(b, firsts[i - 1][1]) for i, (b, _) in enumerate(firsts)], "bucket int, key long")
    head = digested(plain.join(F.broadcast(edge.select("key").distinct()), "key", "left_semi"))
    head = head.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("digest"))).where("n = 1").drop("n")
    order = ["bucket", "extra", "key", "doc_id", "text", "digest", "first_key"]
    none = F.lit(None).cast("long")
    every = rows.select(bucket.alias("bucket"), F.lit(0).alias("extra"), "*", none.alias("first_key")).select(order)
    every = every.unionByName(head.join(F.broadcast(edge), "key").select("*", F.lit(1).alias("extra"), none.alias("first_key")).select(order))
    if marks is not None:
        marked = marks.select(bucket.alias("bucket"), F.lit(2).alias("extra"), "key", none.alias("doc_id"), F.lit(None).cast("string").alias("text"), "digest", "first_key")
        every = every.withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(marked)
    w = Window.partitionBy("bucket").orderBy("extra", F.desc("key"), "digest")
    ahead = every.withColumn("next_text", F.lead("text").over(w)).withColumn("next_digest", F.lead("digest").over(w))
    same = Window.partitionBy("bucket", "key", "digest")
    return ahead.withColumn("first_key", F.max("first_key").over(same)).where("extra = 0").drop("bucket", "extra")


def shared_digests(docs: DataFrame, digest=wide_digest) -> DataFrame:
    """(key, digest, first_key) of the texts whose digest occurs more than once; first_key is the smallest of them."""
    rows = _keyed(docs).select("key", canonical(F.col("text")).alias("canon")).select("key", digest(F.col("canon")).alias("digest"))
    rows = written(rows, "digests")
    bucket = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("key").alias("first_key")).where("n > 1")
    # written first, so that the join alone is dealt by digest and a hot one can be split
    return written(rows.join(written(bucket, "digest-counts"), "digest").select("key", "digest", "first_key").distinct(), "shared-digests")


def compare_bytes(found: DataFrame) -> DataFrame:
    """(key, digest, group_key, group_size) from (key, digest, first_key, canon) of all rows with shared digests.

    Each text is compared with that of its bucket's smallest key; the few that differ are ranked by their bytes.
    What is joined by digest is counted and written before, so that the joins of hot digests can be split.
    """
    first = written(found.where("key = first_key").groupBy("digest").agg(F.min("canon").alias("first_canon")), "first-texts")
    same = F.col("canon") == F.col("first_canon")
    slim = written(found.join(first, "digest").select("key", "digest", F.when(~same, F.col("canon")).alias("odd")), "byte-compare")
    odd = slim.where("odd is not null").select("digest", "odd").distinct()
    odd = written(odd.withColumn("part", F.row_number().over(Window.partitionBy("digest").orderBy("odd"))), "odd-texts")
    parts = slim.join(odd, ["digest", "odd"], "left").select("key", "digest", F.coalesce("part", F.lit(0)).alias("part"))
    parts = written(parts, "parts")
    sizes = written(parts.groupBy("digest", "part").agg(F.min("key").alias("group_key"), F.count("*").alias("group_size")), "group-sizes")
    return parts.distinct().join(sizes, ["digest", "part"]).select("key", "digest", "group_key", "group_size")


def exact_groups(docs: DataFrame, digest=wide_digest) -> DataFrame:
    """(key, digest, group_key, group_size) of every text whose canonical bytes share their digest with another's."""
    marks = shared_digests(docs, digest)
    texts = _keyed(docs).join(marks.select("key").distinct(), "key").select("key", canonical(F.col("text")).alias("canon"))
    texts = texts.select("*", digest(F.col("canon")).alias("digest"))
    return compare_bytes(written(texts.join(marks, ["key", "digest"]), "shared-texts"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its digest, that of its edited text, the likenesses, and its exact group.

    The edited text replaces the last floor(n/2) code points by the first as many of the next document.
    """
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs, shared_digests(docs)).select("*", edited.alias("edited"))
    rows = rows.select("*", canonical(F.col("edited")).alias("edited_canon"))
    rows = rows.select("*", wide_digest(F.col("edited_canon")).alias("edited_digest"))
    alike = lambda d, other: F.when(F.col("digest") != F.col(d), 0.0).when(canonical(F.col("text")) == other, 1.0).otherwise(0.0)
    base = written(
        rows.select(
            "doc_id", "key", n.cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited_sha"), "digest", "edited_digest",
            alike("edited_digest", F.col("edited_canon")).alias("near_edited"),
            alike("next_digest", canonical(F.col("next_text"))).alias("near_next"),
            "first_key", F.when(F.col("first_key").isNotNull(), canonical(F.col("text"))).alias("canon"),
        ),
        "fingerprints",
    )
    groups = compare_bytes(base.where("first_key is not null").select("key", "digest", "first_key", "canon"))
    text = lambda c: F.lower(F.hex(c))
    return base.drop("canon").join(groups, ["key", "digest"], "left").select(
        "doc_id", "n_chars", text("edited_sha").alias("edited_sha256"), text("digest").alias("fingerprint"),
        text("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next",
        F.coalesce("group_key", "key").alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
