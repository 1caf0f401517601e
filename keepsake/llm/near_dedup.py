"""MinHash near-deduplication by weighted Jaccard similarity of word 5-shingles.

Signatures are BagMinHash: a shingle that occurs w times covers the weight range [0, w), cut into the levels
[0, 1), [1, 2), [2, 4), [4, 8), ...; each (shingle, level) is a Poisson process whose points carry a time, a component and
a weight, and a point counts if its weight is below w. A component's value is its earliest counted point, so two
multisets agree on a component with probability equal to their weighted Jaccard similarity. Points are drawn in
order of time and a process stops at the largest value of its document's components.

BANDS bands of ROWS components make candidates: at similarity 0.8 a pair misses every band with probability
(1 - 0.8^5)^24 = 7e-5. Texts with equal multisets are one node. Each member of a bucket is first verified with the
bucket's leader (smallest node), then, in buckets where several components remain, with two more members. Buckets
that still hold several components are compared in blocks: members outside the leader's component with all members.
Verification is exact multiset overlap in both steps. Members are dealt to salted groups and blocks of bounded size,
and only links that join something are returned, so no group meets in one task and none is expanded into all its
pairs as rows.

Words are runs of letters and digits, lower-cased. Defined cases: texts of fewer than five words have one shingle
of all their words; texts without words have one made of the text itself, so only equal ones match (null counts
as empty); rows of equal doc_id are one document: `classify` links all their texts, so they share a class; a row without
doc_id is known by its text; an empty table gives an empty result; further columns are ignored. `keep_first` goes by
texts alone: of the texts of a component one stays, that of the smallest doc_id (and least hash of the text), so a doc_id
with several different texts keeps each that no other row covers; of rows equal in doc_id and text, the least stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from keepsake.llm.batches import map_batches
from keepsake.llm.components import components
from keepsake.llm.numerics import code_points, mix64, polynomial_sums, text_slices, word_signs
from keepsake.runtime import table, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
GROUP_TEXTS, GROUP_CHARS = 512, 1_000_000  # of one side of a verification
PIVOTS = (1, 2)
BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), sorted by text and hash."""
    with np.errstate(over="ignore"):
        codes = code_points("\n".join(t.lower() for t in texts) + "\n")
        inside = word_signs()[codes]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums, down = polynomial_sums(codes)
        word = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        starts = np.cumsum([0, *[len(t.lower()) + 1 for t in texts]])
        owner = np.searchsorted(starts, begin, side="right") - 1
        count = np.bincount(owner, minlength=len(texts))
        n = max(0, len(word) - words + 1)
        hashed = np.zeros(n, np.uint64)
        for k in range(words):
            hashed = mix64(hashed * np.uint64(3) + word[k : k + n])
        whole = owner[:n] == owner[words - 1 : words - 1 + n]
        doc, hashed = owner[:n][whole], hashed[whole]
        extra_doc, extra = [], []
        at = np.concatenate(([0], np.cumsum(count)))
        for i in np.flatnonzero(count < words):
            own = np.uint64(count[i])
            if count[i]:
                for w in word[at[i] : at[i + 1]]:
                    own = mix64(np.array([own * np.uint64(3) + w]))[0]
            else:
                bare = code_points(texts[i].strip())
                own = mix64(np.array([polynomial_sums(bare)[0][-1] + np.uint64(len(bare)) * BASE]))[0]
            extra_doc.append(i)
            extra.append(own)
        doc = np.concatenate((doc, np.array(extra_doc, np.int64)))
        hashed = np.concatenate((hashed, np.array(extra, np.uint64)))
        order = np.lexsort((hashed, doc))
        doc, hashed = doc[order], hashed[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
        first = np.flatnonzero(new)
        return doc[first], hashed[first], np.diff(np.append(first, len(doc)))


def _draw(n_texts: int, doc: np.ndarray, seed: np.ndarray, low: np.ndarray, width: np.ndarray, weight: np.ndarray, m: int, burst: int) -> np.ndarray:
    values = np.full((n_texts, m), np.inf)
    time = np.zeros(len(doc))
    step = 0
    with np.errstate(over="ignore"):
        while len(doc):
            tick = seed[:, None] + (np.arange(burst, dtype=np.uint64) + np.uint64(step))[None, :] * np.uint64(0xD1342543DE82EF95)
            bits = mix64(tick)
            more = mix64(bits ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) / 2.0**53) / (m * width)[:, None]
            times = time[:, None] + np.cumsum(gap, axis=1)
            part = (more % np.uint64(m)).astype(np.int64)
            at = low[:, None] + (more >> np.uint64(32)).astype(np.float64) / 2.0**32 * width[:, None]
            ok = at < weight[:, None]
            flat = (doc[:, None] * m + part)[ok]
            np.minimum.at(values.ravel(), flat, times[ok])
            time, step = times[:, -1], step + burst
            live = time < values.max(1)[doc]
            doc, seed, low, width, weight, time = doc[live], seed[live], low[live], width[live], weight[live], time[live]
    return values


def bag_minhash(n_texts: int, doc: np.ndarray, hashed: np.ndarray, count: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """m component values a text, as float32: the earliest counted points of its shingles' processes."""
    parts, level, low = [], 0, 0.0
    offset = [np.uint64((k + 1) * int(BASE) % 2**64) for k in range(64)]
    while (mine := count > low).any():
        width = 1.0 if level == 0 else low
        ones = np.ones(int(mine.sum()))
        seed = mix64(hashed[mine] + offset[level])
        parts.append((doc[mine], seed, low * ones, width * ones, count[mine].astype(float)))
        level, low = level + 1, low + width
    if not parts:
        return np.full((n_texts, m), np.inf, np.float32)
    every = [np.concatenate(p) for p in zip(*parts, strict=True)]
    few = np.bincount(every[0], minlength=n_texts)[every[0]] < 64
    values = _draw(n_texts, *[x[~few] for x in every], m, 1)
    return np.minimum(values, _draw(n_texts, *[x[few] for x in every], m, 32)).astype(np.float32)


def band_hashes(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        bits = values.view(np.uint32).astype(np.uint64).reshape(len(values), bands, rows)
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * BASE, bits.shape[:2]).copy()
        for r in range(rows):
            out = mix64(out * np.uint64(5) + bits[:, :, r])
        return out.view(np.int64)


def _key() -> Column:
    known = F.col("doc_id").cast("long")
    return F.coalesce(known, -1 - F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1))


def _text_hash() -> Column:
    """Tells texts of one key apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """key, th (hash of the text), chars, d1, d2 (digest of the shingle multiset) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_slices(batch):
                doc, hashed, count = shingles(texts)
                n = end - start
                with np.errstate(over="ignore"):
                    digest = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                    for d, salt in zip(digest, (0x1234567890ABCDEF, 0xFEDCBA0987654321), strict=True):
                        np.add.at(d, doc, mix64(hashed ^ np.uint64(salt)) * count.astype(np.uint64))
                bands = band_hashes(bag_minhash(n, doc, hashed, count))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                known = [batch.column(c).slice(start, n) for c in ("key", "th", "chars")]
                yield pa.RecordBatch.from_arrays([*known, *[pa.array(d.view(np.int64)) for d in digest], lists], ["key", "th", "chars", "d1", "d2", "bands"])

    rows = docs.select(_key().alias("key"), _text_hash().alias("th"), F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), "text")
    return map_batches(rows, run, "key long, th long, chars int, d1 long, d2 long, bands array<long>")


def overlaps(left: tuple, right: tuple, n_left: int, n_right: int) -> np.ndarray:
    """Weighted Jaccard similarity of each left text with each right one, from (text, hash, count) arrays."""
    names = np.unique(np.concatenate((left[1], right[1])))
    at_left, at_right = np.searchsorted(names, left[1]), np.searchsorted(names, right[1])
    size_left = np.bincount(left[0], left[2], n_left)
    size_right = np.bincount(right[0], right[2], n_right)
    out, have = np.zeros((n_left, n_right)), np.zeros(len(names))
    cuts = np.searchsorted(left[0], np.arange(n_left + 1))
    for i in range(n_left):
        mine = slice(cuts[i], cuts[i + 1])
        have[at_left[mine]] = left[2][mine]
        shared = np.bincount(right[0], np.minimum(have[at_right], right[2]), n_right)
        out[i] = shared / np.maximum(size_left[i] + size_right - shared, 1)
        have[at_left[mine]] = 0
    return out


def _verify(rows: pd.DataFrame, similarity: float = SIMILARITY) -> pd.DataFrame:
    """Links (a, b) between rows with role 0 and rows with role 1; inside one call each link joins two parts."""
    left, right = rows[rows["role"] == 0], rows[rows["role"] == 1]
    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        sides = [shingles(x["text"].tolist()) for x in (left, right)]
        alike = overlaps(*sides, len(left), len(right))
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        root = dict(zip([*a, *b], [*left["label"], *right["label"]], strict=True))
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        for i, j in zip(*np.nonzero(alike >= similarity - 1e-12), strict=True):
            p, q = top(root[a[i]]), top(root[b[j]])
            if p != q:
                up[max(p, q)] = min(p, q)
                found.append((int(a[i]), int(b[j])))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _links(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).applyInPandas(lambda pdf: _verify(pdf), "a long, b long")


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, th, node) of every row, verified links (a, b) between nodes).

    A node stands for all rows of equal shingle multisets; its number is that of one of them, and no two nodes share one.
    """
    # numbers are kept with the rows in the files, so every later step reads the same ones
    signed = written(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    node_of = written(signed.groupBy("d1", "d2").agg(F.min("row").alias("node")), "digests")
    keys = written(signed.select("row", "key", "th", "d1", "d2").join(node_of, ["d1", "d2"]).select("row", "key", "th", "node"), "nodes")
    heads = keys.where("row = node").select("node", "key", "th")
    first = signed.join(heads.select(F.col("node").alias("row")), "row", "left_semi")
    bands = written(first.select(F.col("row").alias("node"), "chars", F.explode(F.array_distinct("bands")).alias("band")), "bands")
    buckets = bands.groupBy("band").agg(
        F.count("*").alias("n"), F.min("node").alias("leader"),
        *[F.expr(f"bit_xor(xxhash64({lane}, node))").alias(f"who{lane}") for lane in (1, 2)],
    )
    held = written(bands.join(written(buckets.where("n > 1"), "shared-bands"), "band"), "buckets")
    pairs = held.where("node <> leader").select("node", "chars", F.col("leader").alias("with")).distinct()
    # the texts of all candidates, once
    wanted = heads.join(held.select("node").distinct(), "node", "left_semi")
    texts = docs.select(_key().alias("key"), _text_hash().alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    texts = written(texts.join(wanted, ["key", "th"]).select("node", "text").dropDuplicates(["node"]), "candidate-texts")
    links = written(_pair_links(pairs, texts), "leader-links")
    for seed in PIVOTS:
        links = written(links.unionByName(_pair_links(_pivot_pairs(held, components(links), seed), texts)), "pivot-links")
    return keys.drop("row"), written(links.unionByName(_rest_links(held, texts, components(links))), "near-links")


def _labelled(keys: DataFrame, links: DataFrame) -> DataFrame:
    """`keys` with the label of each node's component."""
    return keys.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _groups(texts: str, chars: str) -> Column:
    """Into how many groups so many texts of so many characters are dealt."""
    return F.greatest(F.ceil(F.col(texts) / GROUP_TEXTS), F.ceil(F.col(chars) / GROUP_CHARS), F.lit(1)).cast("int")


def _pair_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links of pairs (node, chars, with): all nodes of one `with` are compared with it, in salted groups."""
    sized = pairs.groupBy("with").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    sized = sized.select("with", _groups("n", "chars").alias("parts"))
    members = pairs.join(sized, "with").select("node", "with", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"))
    heads = sized.select(F.col("with").alias("node"), "with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"))
    placed = members.unionByName(heads).withColumn("label", F.col("node"))
    return _links(placed.join(texts, "node"), ["with", "part"])


def _open_members(held: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets of three or more with their labels and that of the leader, `led`."""
    known = held.where("n > 2").join(labels, "node", "left").select("band", "node", "chars", "leader", "n", "who1", "who2", F.coalesce("label", "node").alias("label"))
    known = known.join(labels.select(F.col("node").alias("leader"), F.col("label").alias("led")), "leader", "left")
    return known.withColumn("led", F.coalesce("led", "leader"))


def _pivot_pairs(held: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """(node, chars, with): in buckets of several components, all members outside the component of the bucket's pivot.

    The pivot is the member of least seeded hash, so buckets with about the same members have the same one.
    """
    known = written(_open_members(held, labels), "open-members")
    pivots = known.groupBy("band").agg(
        F.min(F.struct(F.xxhash64(F.lit(seed), "node"), F.col("node").alias("with"), F.col("label").alias("with_label"))).alias("x"),
        F.sum((F.col("label") != F.col("led")).cast("int")).alias("out"),
    )
    found = known.join(pivots.where("out > 0").select("band", "x.with", "x.with_label"), "band")
    return found.where(F.col("label") != F.col("with_label")).select("node", "chars", "with").distinct()


def _rest_links(held: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Links in buckets that still hold several components, between members outside the leader's and all members."""
    known = written(_open_members(held, labels), "rest-members")
    away = F.col("label") != F.col("led")
    sizes = known.groupBy("band").agg(
        *[F.max(c).alias(c) for c in ("n", "who1", "who2")], F.sum("chars").alias("chars"),
        F.sum(away.cast("int")).alias("out"), F.sum(F.when(away, F.col("chars")).otherwise(0)).alias("out_chars"),
    )
    # buckets of different bands with the same members are compared once
    sizes = sizes.where("out > 0").groupBy("n", "who1", "who2", "chars", "out", "out_chars").agg(F.min("band").alias("band"))
    rows = known.select("band", "node", "label", "led").join(sizes.select("band", _groups("out", "out_chars").alias("ni"), _groups("n", "chars").alias("nj")), "band")
    mine = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = rows.where("label <> led").select("band", "node", "label", mine("ni").alias("i"), every("nj").alias("j"), F.lit(0).alias("role"))
    right = rows.select("band", "node", "label", mine("nj").alias("j"), every("ni").alias("i"), F.lit(1).alias("role"))
    return _links(left.unionByName(right).join(texts, "node"), ["band", "i", "j"])


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size and kept (whether it is that document)."""
    keys, links = near_links(docs)
    # texts of one key are linked with the first of them
    several = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    same = keys.join(several.select("key", "a"), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    found = _labelled(keys, written(links.unionByName(same), "all-links"))
    classes = written(found.select("key", "label").distinct(), "classes")
    sizes = written(classes.groupBy("label").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size")), "class-sizes")
    return classes.join(sizes, "label").select("key", "class_id", "class_size", (F.col("key") == F.col("class_id")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` without all but one row of each component of texts."""
    first = _labelled(*near_links(docs)).groupBy("label").agg(F.min(F.struct("key", "th")).alias("x"))
    kept = written(first.select(F.col("x.key").alias("__key"), F.col("x.th").alias("__th")), "kept")
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and isinstance(f.dataType, AtomicType)]
    # rows equal in doc_id and text are cut to one before texts are shuffled
    once = Window.partitionBy("__key", "__th").orderBy(*others)
    rows = docs.withColumns({"__key": _key(), "__th": _text_hash()}).withColumn("__n", F.row_number().over(once)).where("__n = 1")
    return rows.join(kept, ["__key", "__th"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classify(docs)
    ids = docs.select("doc_id", _key().alias("key"))
    return ids.join(found, "key").select("doc_id", "class_id", "class_size", "kept")
