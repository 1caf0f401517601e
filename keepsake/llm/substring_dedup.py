"""Substring dedup: repeated word windows are removed from all but the first document that has them.

Every window of `size` consecutive words of a document has a Rabin-Karp hash. Texts are dealt to groups; a group sends
each of its distinct windows once, with the number of its documents that hold it and their smallest doc_id, to the
shard of the hash. The shard counts documents over all groups and answers whether a window is repeated and whether
another group has it in an earlier document. Back in its group, every repeated window that also starts in a document
with a smaller doc_id is lost; lost windows that touch or overlap make maximal intervals of words, which are removed.

A window is told from others by 64 bits of one hash and CHECK bits of another. A window that very many documents share
is sent once a group, so no task holds all its places.

Defined cases: a null text has no words; a null doc_id sorts below all others; documents of one doc_id are not before
each other; repeated rows count as documents each, are in one group and keep the same words; texts of fewer than `size`
words lose none; texts are read whole; an empty table gives an empty result; further columns pass through, those
named as the result's new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keepsake.llm.batches import release
from keepsake.llm.words import BASE, BASE_2, GROUP_BYTES, NO_ID, Words, group_of, groups_and_bits, pack, rolling, run_numbers, runs, shard_slices, table_of, unpack
from keepsake.runtime import table

SIZE, MIN_DOCS, CHECK = 13, 2, 16
BREAKS = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SENT = "shard long, part long, windows binary"
ANSWERS = "part long, shard long, codes binary"
ADDED = "text string, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string"
NEW = ("n_words", "n_removed", "removed", "kept_text")


class Windows:
    """The windows of a group's texts, in runs of equal ones."""

    def __init__(self, rows: pa.Table, size: int):
        self.words = Words(rows.column("text"), BREAKS)
        first, second = self.words.hashes()[:, self.words.ids] if len(self.words) else np.zeros((2, 0), np.uint64)
        inside = self.words.doc[: max(0, len(self.words) - size + 1)] == self.words.doc[size - 1 :]
        self.at = np.flatnonzero(inside)
        h, c = rolling(first, size, BASE)[inside], rolling(second, size, BASE_2)[inside] >> np.uint64(64 - CHECK)
        self.order, self.starts = runs(h, c)
        self.h, self.c = h[self.order[self.starts]], c[self.order[self.starts]].astype("u2")
        self.doc = self.words.doc[self.at]
        self.key = rows.column("key").to_numpy()[self.doc] if len(self.at) else np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(self.key[self.order], self.starts) if len(self.starts) else self.key
        self.run = run_numbers(len(h), self.starts)

    def documents(self) -> np.ndarray:
        """How many documents each run is in: the order is stable, so a run's places are by document."""
        if not len(self.starts):
            return np.zeros(0, "u4")
        other = np.diff(self.doc[self.order], prepend=-1) != 0
        other[self.starts] = True
        return np.add.reduceat(other.astype("u4"), self.starts).astype("u4")


def repeated_in_shard(blobs: list[bytes], min_docs: int) -> list[np.ndarray]:
    """For each window of each blob 0 (not repeated), 1 (repeated) or 2 (repeated, and before this group's first document)."""
    parts = [unpack(b, "u2", "i8", "u4") for b in blobs]
    h, c, key, n = (np.concatenate(p) for p in zip(*parts, strict=True))
    order, starts = runs(h, c)
    run = run_numbers(len(h), starts)
    total, least = np.add.reduceat(n[order].astype(np.int64), starts), np.minimum.reduceat(key[order], starts)
    codes = np.empty(len(h), np.uint8)
    codes[order] = np.where(total[run] >= min_docs, 1 + (least[run] < key[order]), 0)
    return np.split(codes, np.cumsum([len(p[0]) for p in parts])[:-1])


def intervals(removed: np.ndarray, doc: np.ndarray, texts: int) -> list[list[dict]]:
    """Each text's maximal runs of removed words, from `start` up to `end` (not included), counted in its words."""
    held = np.concatenate(([False], removed, [False]))
    edge = np.concatenate(([-1], doc, [-1]))
    turn = edge[1:] != edge[:-1]
    begins = np.flatnonzero(held[1:-1] & (~held[:-2] | turn[:-1]))
    ends = np.flatnonzero(held[1:-1] & (~held[2:] | turn[1:])) + 1
    first = np.searchsorted(doc, np.arange(texts))
    out: list[list[dict]] = [[] for _ in range(texts)]
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        out[doc[a]].append({"start": a - int(first[doc[a]]), "end": b - int(first[doc[a]])})
    return out


def join_kept(words: Words, kept: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    starts, ends, doc = words.starts[kept], words.ends[kept], words.doc[kept]
    last = np.flatnonzero(np.diff(doc, append=-1))
    edges = np.zeros(len(words.data) + 1, np.int8)
    edges[starts] += 1
    edges[ends + 1] -= 1
    edges[ends[last]] -= 1  # no space after the last word
    edges[ends[last] + 1] += 1
    data = words.data.copy()
    data[ends] = 0x20
    sizes = np.bincount(doc, ends - starts + 1, words.texts).astype(np.int64)
    sizes[doc[last]] -= 1
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    values = data[np.cumsum(edges[:-1], dtype=np.int8) > 0]
    return pa.LargeStringArray.from_buffers(words.texts, pa.py_buffer(offsets), pa.py_buffer(values)).cast(pa.string())


def drop_repeats(docs: DataFrame, size: int = SIZE, min_docs: int = MIN_DOCS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """`docs` with n_words, n_removed, removed (intervals of words) and kept_text.

    A word is removed if a window over it is in at least `min_docs` documents, one of them with a smaller doc_id.
    """
    docs = docs.drop(*NEW)
    groups, bits = groups_and_bits(docs, group_bytes)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    dealt = docs.select(
        group_of(groups).alias("part"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), "text",
        F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("further"),
    )

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        w = Windows(rows, size)
        n = w.documents()
        cuts = shard_slices(w.h, bits)
        blobs = [pack(w.h[a:b], w.c[a:b], w.least[a:b], n[a:b]) for _, a, b in cuts]
        release()
        return table_of(SENT, shard=[s for s, _, _ in cuts], part=[key[0].as_py()] * len(cuts), windows=blobs)

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        codes = repeated_in_shard(rows.column("windows").to_pylist(), min_docs)
        found = [(p, zstandard.ZstdCompressor(level=1).compress(c.tobytes())) for p, c in zip(rows.column("part").to_pylist(), codes, strict=True) if c.any()]
        release()
        return table_of(ANSWERS, part=[p for p, _ in found], shard=[key[0].as_py()] * len(found), codes=[c for _, c in found])

    def remove(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        w = Windows(rows, size)
        codes = np.zeros(len(w.h), np.uint8)
        places = {s: a for s, a, _ in shard_slices(w.h, bits)}
        for shard, blob in zip(answers.column("shard").to_pylist(), answers.column("codes").to_pylist(), strict=True):
            found = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
            codes[places[shard] : places[shard] + len(found)] = found
        code, at = codes[w.run], w.at[w.order]
        lost = at[(code == 2) | ((code == 1) & (w.key[w.order] > w.least[w.run]))]
        cover = np.zeros(len(w.words) + 1, np.int32)
        cover[lost] += 1  # windows begin at different words
        cover[lost + size] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        out = {
            "further": rows.column("further"), "text": rows.column("text"), "n_words": pa.array(np.bincount(w.words.doc, minlength=w.words.texts)),
            "n_removed": pa.array(np.bincount(w.words.doc[gone], minlength=w.words.texts)),
            "removed": pa.array(intervals(gone, w.words.doc, w.words.texts), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_text": join_kept(w.words, ~gone),
        }
        release()
        return pa.table(out)

    by_group = dealt.groupBy("part")
    sent = by_group.applyInArrow(count, SENT)
    answers = sent.groupBy("shard").applyInArrow(answer, ANSWERS)
    schema = StructType([dealt.schema["further"], *StructType.fromDDL(ADDED).fields])
    found = by_group.cogroup(answers.groupBy("part")).applyInArrow(remove, schema)
    return found.select(*[F.col("text") if c == "text" else F.col(f"further.{names[c]}").alias(c) for c in docs.columns], *NEW)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM docs),
starts AS (SELECT doc_id, rid, ws, unnest(range(len(ws) - 12)) AS i FROM docs WHERE len(ws) >= 13),
windows AS (SELECT doc_id, rid, i, array_to_string(ws[i + 1 : i + 13], ' ') AS w FROM starts),
earliest AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
lost AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS pos FROM windows JOIN earliest USING (w) WHERE first < doc_id),
marked AS (SELECT words.*, lost.pos IS NOT NULL AS gone FROM words LEFT JOIN lost ON words.rid = lost.rid AND words.pos = lost.pos),
kept AS (SELECT rid, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS t FROM marked GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""
