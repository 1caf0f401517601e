"""Line dedup through sharded minimal perfect hashes.

Lines are keyed (white space stripped at both ends, A-Z lower-cased) and hashed to 128 bits. Each distinct line
hash is counted over documents; the hashes are dealt to shards of bounded size, and each shard gets a minimal
perfect hash (levels of bit sets without collisions, ranked by running popcounts) that indexes compact arrays:
a fingerprint, the count of documents and the largest doc_id. Documents send packed probes (hash and
place) to the shards and look the arrays up; lines themselves are never joined. Shards with over SHARD_PROBES probes
are copied under several salts, so no task gets many more than that, however common a line is.

Every probed hash is in its shard's index, so a lookup cannot hit a foreign slot; two different lines are taken
for one only if all 128 bits agree.

Defined cases: a null or empty text has one empty line; each row counts as a document, and repeated rows of the
largest doc_id all keep their lines; null doc_ids count as documents and sort below all others; an empty table
gives an empty result; further columns pass through `drop_lines`.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.numerics import mix64
from keepsake.runtime import table, written

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS, MIN_SHARDS, SHARD_PROBES = 32_768, 64, 250_000
BLANKS = " \t\n\x0b\x0c\r"
LEVELS, LOAD = 24, 2.0


def line_key(line: Column) -> Column:
    """The line with blanks stripped at both ends and A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.char_length(bare) == F.octet_length(bare)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, upper, upper.lower()))


def _level_slots(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(hashes ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)


def build_index(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(bit set of each level, hashes in slot order) of distinct uint64 hashes."""
    levels, placed, rest = [], [], hashes
    for level in range(LEVELS):
        if not len(rest):
            break
        size = max(64, int(LOAD * len(rest)) + 63 & ~63)
        slots = _level_slots(rest, level, size)
        alone = np.bincount(slots, minlength=size) == 1
        levels.append(alone)
        mine = alone[slots]
        placed.append(rest[mine][np.argsort(slots[mine])])
        rest = rest[~mine]
    if len(rest):  # what no level separates is kept sorted at the end
        placed.append(np.sort(rest))
    return levels, np.concatenate(placed) if placed else hashes


def look_up(levels: list[np.ndarray], tail: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The slot of each hash."""
    out, base, todo = np.full(len(hashes), -1, np.int64), 0, np.arange(len(hashes))
    for level, bits in enumerate(levels):
        if not len(todo):
            return out
        slots = _level_slots(hashes[todo], level, len(bits))
        ranks = np.concatenate(([0], np.cumsum(bits)))
        mine = bits[slots]
        out[todo[mine]] = base + ranks[slots[mine]]
        todo, base = todo[~mine], base + int(ranks[-1])
    if len(todo) and len(tail):
        out[todo] = base + np.minimum(np.searchsorted(tail, hashes[todo]), len(tail) - 1)
    return out


def pack_index(h1: np.ndarray, h2: np.ndarray, n_docs: np.ndarray, last: np.ndarray) -> bytes:
    """Bit sets, fingerprints, counts and largest ids, in slot order, as bytes."""
    levels, order = build_index(h1)
    at = np.argsort(h1)[np.searchsorted(np.sort(h1), order)]
    in_levels = sum(int(b.sum()) for b in levels)
    parts = [struct.pack("<qqq", len(levels), len(order), in_levels)]
    for bits in levels:
        parts += [struct.pack("<q", len(bits)), np.packbits(bits).tobytes()]
    parts += [h2[at].tobytes(), n_docs[at].astype(np.int64).tobytes(), last[at].tobytes(), order[in_levels:].tobytes()]
    return b"".join(parts)


def unpack_index(blob: bytes) -> tuple:
    n_levels, n, in_levels = struct.unpack_from("<qqq", blob)
    at, levels = 24, []
    for _ in range(n_levels):
        (size,) = struct.unpack_from("<q", blob, at)
        levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, size // 8, at + 8)).astype(bool))
        at += 8 + size // 8
    marks = np.frombuffer(blob, np.uint64, n, at)
    counts = np.frombuffer(blob, np.int64, n, at + 8 * n)
    last = np.frombuffer(blob, np.int64, n, at + 16 * n)
    return levels, np.frombuffer(blob, np.uint64, n - in_levels, at + 24 * n), marks, counts, last


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """key, th (of the row), pos, h1, h2 of every line whose key is long enough."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64("text").alias("th"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"),
    ).select("key", "th", "pos", line_key(F.col("line")).alias("line"))
    rows = rows.where(F.char_length("line") >= min_chars)
    return rows.select("key", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def build_shards(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, int]:
    """(shard, probes, blob) rows in the shared folder, and the number of shards."""
    lines = _lines(docs, min_chars)
    # a text repeats a line n times and a repeated row repeats the text: lines at one place count rows
    places = lines.groupBy("h1", "h2", "key", "th", "pos").agg(F.count("*").alias("rows"))
    each = places.groupBy("h1", "h2", "key", "th").agg(F.max("rows").alias("rows"), F.sum("rows").alias("n"))
    found = each.groupBy("h1", "h2").agg(F.sum("rows").alias("n_docs"), F.sum("n").alias("n_lines"), F.max("key").alias("last"))
    counts = written(found, "line-counts")
    shards = max(MIN_SHARDS, -(-counts.count() // SHARD_KEYS))

    def build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = rows["h1"].to_numpy(np.int64).view(np.uint64), rows["h2"].to_numpy(np.int64).view(np.uint64)
        blob = pack_index(_joint(h1, h2), h2, rows["n_docs"].to_numpy(), rows["last"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [shard[0]], "probes": [int(rows["n_lines"].sum())], "blob": [blob]})

    dealt = counts.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInPandas(build, "shard int, probes long, blob binary"), "line-shards"), shards


def _joint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """One 64-bit index hash of both halves."""
    return mix64(h1 ^ mix64(h2))


def dropped_places(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, th, drops): the sorted places of the lines each document loses; documents that lose none are absent."""
    shards, n = build_shards(docs, min_chars)
    copies = F.greatest(F.lit(1), F.ceil(F.col("probes") / SHARD_PROBES)).cast("int")
    # written, so that its size is known: it is broadcast below the session's threshold and joined by shard above it
    hot = written(shards.select("shard", copies.alias("copies")).where("copies > 1"), "hot-shards")
    index = shards.select("shard", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), "blob")
    probes = _lines(docs, min_chars).withColumn("shard", F.pmod("h1", F.lit(n)).cast("int"))
    probes = probes.join(hot, "shard", "left")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("key", "th", "pos"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")

    def probe(lines: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(index):
            return lines[["key", "th", "pos"]].iloc[:0]
        levels, tail, marks, counts, last = unpack_index(index["blob"].iloc[0])
        h1, h2 = lines["h1"].to_numpy(np.int64).view(np.uint64), lines["h2"].to_numpy(np.int64).view(np.uint64)
        slot = look_up(levels, tail, _joint(h1, h2))
        lost = (marks[slot] == h2) & (counts[slot] >= min_docs) & (last[slot] != lines["key"].to_numpy(np.int64))
        return lines.loc[lost, ["key", "th", "pos"]]

    found = probes.groupBy("shard", "salt").cogroup(index.groupBy("shard", "salt")).applyInPandas(probe, "key long, th long, pos int")
    return found.groupBy("key", "th").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with kept_text, n_lines and n_dropped in place of any columns so named."""
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    key, th = F.coalesce(F.col("d.doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64("d.text")
    lost = dropped_places(docs, min_chars, min_docs).alias("x")
    rows = docs.alias("d").join(lost, (key == F.col("x.key")) & (th == F.col("x.th")), "left")
    lines = F.split(F.coalesce("d.text", F.lit("")), "\n")
    rows = rows.select(*names, lines.alias("__lines"), F.col("x.drops").alias("__drops"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops"))
    kept = F.array_join(F.transform(keep, lambda i: F.get("__lines", i)), "\n")
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("__drops").isNull(), F.array_join("__lines", "\n")).otherwise(kept).alias("kept_text"),
        F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH rows AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, rid, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM rows),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT rid) >= 3),
marked AS (SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id <> common.last AS lost FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS INT)) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id, rid
"""
