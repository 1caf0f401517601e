"""Token ids in binary files coded by a static range asymmetric numeral system (rANS).

Texts are encoded, an end id is added to each, and documents are dealt to ascending ranges of doc_id. A file row
(segment) holds consecutive documents of one range: their ids and lengths, and the stream of their token ids cut
into blocks. Every block is coded on its own with the shared frequency table: LANES interleaved states, whose
32-bit words are kept a lane after another; its checkpoint (final states, word counts, token count) and a crc32 let
any block be decoded and checked alone, in parallel with all others. The frequency table is counted over all
documents and scaled to 2^SCALE, at least 1 for every id that occurs.

Coding works on all blocks of a batch at once: a numpy step codes one token of every lane of every block.

A document's start is its place in these files: the ids of the segments in front, from the lengths kept with them, and
those in front of it in its own. Texts that hold an added token's string get that token's id, as the library gives it.

Defined cases: a null text counts as empty (only the end id); rows of equal doc_id stay separate documents, in the
files ordered by a checksum; a null doc_id sorts below all others and counts first; an empty table gives an empty result;
very long texts span blocks; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.llm.batches import map_batches
from keepsake.llm.chunks import SLICE_CHARS, ChunkCache
from keepsake.llm.numerics import ragged, text_slices
from keepsake.runtime import shared_folder, table, written

LANES, BLOCK_TOKENS, SCALE = 32, 32_768, 20
LOW = np.uint64(2**31)  # states stay in [2^31, 2^63) between tokens, with 32-bit words moved in and out
NO_ID = -(2**63)


class Packer:
    """A document's ids on their way to its range: little-endian integers of `kind`, compressed."""

    def __init__(self, kind: str):
        self.kind = kind
        self.compress = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False).compress
        self.decompress = zstandard.ZstdDecompressor().decompress

    def pack(self, ids: np.ndarray) -> bytes:
        return self.compress(ids.astype(self.kind).tobytes())

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(self.decompress(data), self.kind).astype(np.int64)


class Encoder:
    """The library's tokenizer behind a cache of chunks; texts that hold an added token are given to it whole."""

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a byte-level token has a sign for each of its bytes
        self.chunks = ChunkCache(self._encode)

    def _encode(self, chunks: list[bytes], follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that may follow each other are encoded in runs and told apart by their numbers of bytes."""
        order = np.argsort(~follows, kind="stable")
        n = int(follows.sum())
        came = [chunks[i] for i in order]
        sizes = np.fromiter(map(len, came[:n]), np.int64, n)
        run = np.cumsum(sizes) // 20_000
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), n] if n else [0]
        runs = [b"".join(came[a:b]).decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        found = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(runs + [c.decode() for c in came[n:]], add_special_tokens=False)]
        flat = np.concatenate([*found, np.zeros(0, np.int64)])
        upto = np.searchsorted(np.cumsum(self.bytes_of[np.concatenate([*found[: len(runs)], np.zeros(0, np.int64)])]), np.cumsum(sizes), side="right")
        lengths = np.concatenate((np.diff(upto, prepend=0), np.array([len(f) for f in found[len(runs) :]], np.int64)))
        back = np.empty(len(came), np.int64)
        back[order] = np.arange(len(came))
        return flat[ragged((np.cumsum(lengths) - lengths)[back], lengths[back])], lengths[back]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.chunks.ids(texts, np.array([any(a in t for a in self.added) for t in texts], bool))


@lru_cache(maxsize=1)
def _encoder(model: str) -> Encoder:
    return Encoder(model)


def encode_ids(docs: DataFrame, model: str, end_id: int, kind: str) -> DataFrame:
    """(key, ids): packed ids, the end id last."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(shared.value), Packer(kind)
        for batch in batches:
            for start, end, texts in text_slices(batch, SLICE_CHARS):
                ids, lengths = encoder.ids(texts)
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, end_id)
                cuts = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
                rows = [packer.pack(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, end - start), pa.array(rows, pa.binary())], ["key", "ids"])
        encoder.chunks.clear()  # the worker may serve other tasks for long

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), "text")
    return map_batches(keyed, run, "key long, ids binary")


def frequencies(ids: DataFrame, vocabulary: int, kind: str) -> np.ndarray:
    """Counts of all ids over all documents, scaled to sum to 2^SCALE; the table has one entry an id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        packer = Packer(kind)
        for batch in batches:
            held: list[np.ndarray] = []
            for value in batch.column("ids").to_pylist():
                held.append(packer.unpack(value))
                if len(held) >= 200:
                    total += np.bincount(np.concatenate(held), minlength=vocabulary)
                    held = []
            if held:
                total += np.bincount(np.concatenate(held), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = map_batches(ids.select("ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return scale(counts)


def scale(counts: np.ndarray) -> np.ndarray:
    """Integer frequencies that sum to 2^SCALE and are at least 1 where a count is."""
    whole = 2**SCALE
    if not counts.sum():
        return counts
    out = np.where(counts > 0, np.maximum(1, (counts.astype(float) * (whole / counts.sum())).astype(np.int64)), 0)
    spare = whole - int(out.sum())
    if spare >= 0:
        out[counts.argmax()] += spare
        return out
    for i in np.argsort(-out, kind="stable"):  # too many were lifted to 1: the largest give
        give = min(-spare, int(out[i]) // 2)
        out[i] -= give
        spare += give
        if not spare:
            break
    return out


@lru_cache(maxsize=2)
def _tables(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequency, cumulative frequency, id of each slot) of a frequency table."""
    freq = np.frombuffer(raw, "<i8")
    return freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_blocks(blocks: list[np.ndarray], raw: bytes) -> list[bytes]:
    """Each block's bytes: token count, crc32 of its ids, states, words a lane, words."""
    freq, cum, _ = _tables(raw)
    sizes = np.array([len(b) for b in blocks], np.int64)
    steps = int(-(-sizes.max() // LANES))
    grid = np.full((len(blocks), steps * LANES), -1, np.int64)
    for i, b in enumerate(blocks):
        grid[i, : len(b)] = b
    grid = grid.reshape(len(blocks), steps, LANES).transpose(1, 0, 2).reshape(steps, -1)
    state = np.full(grid.shape[1], LOW, np.uint64)
    words = np.zeros((steps, grid.shape[1]), np.uint32)
    wrote = np.zeros((steps, grid.shape[1]), bool)
    shift = np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):  # backwards, so that decoding runs forwards
        token = grid[t]
        live = token >= 0
        token = np.where(live, token, 0)
        f = np.where(live, freq[token], np.uint64(1))
        out = live & (state >= (f << shift))
        words[t], wrote[t] = state & np.uint64(0xFFFFFFFF), out
        state = np.where(out, state >> np.uint64(32), state)
        state = np.where(live, ((state // f) << np.uint64(SCALE)) + cum[token] + state % f, state)
    wrote, words = wrote.T.reshape(len(blocks), LANES, steps), words.T.reshape(len(blocks), LANES, steps)
    state = state.reshape(len(blocks), LANES)
    return [
        np.array([sizes[i], zlib.crc32(b.astype("<u4").tobytes())], "<u4").tobytes() + state[i].astype("<u8").tobytes()
        + wrote[i].sum(1).astype("<u4").tobytes() + words[i][wrote[i]].astype("<u4").tobytes()
        for i, b in enumerate(blocks)
    ]


def decode_blocks(coded: list[bytes], raw: bytes) -> list[np.ndarray]:
    """The ids of each block; raises where a checksum doesn't match."""
    freq, cum, slots = _tables(raw)
    head = [np.frombuffer(c, "<u4", 2) for c in coded]
    sizes = np.array([h[0] for h in head], np.int64)
    state = np.concatenate([np.frombuffer(c, "<u8", LANES, 8) for c in coded]).astype(np.uint64)
    counts = np.concatenate([np.frombuffer(c, "<u4", LANES, 8 + 8 * LANES) for c in coded]).astype(np.int64)
    words = np.concatenate([*[np.frombuffer(c, "<u4", -1, 8 + 12 * LANES) for c in coded], np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.cumsum(counts) - counts
    steps = int(-(-sizes.max() // LANES))
    lane = np.tile(np.arange(LANES), len(coded))
    per_lane = (np.repeat(sizes, LANES) - lane + LANES - 1) // LANES
    out = np.zeros((steps, len(state)), np.uint32)
    mask = np.uint64(2**SCALE - 1)
    for t in range(steps):
        live = per_lane > t
        low = state & mask
        token = slots[low.astype(np.int64)]
        out[t] = token
        moved = freq[token] * (state >> np.uint64(SCALE)) + low - cum[token]
        refill = live & (moved < LOW)
        moved = np.where(refill, (moved << np.uint64(32)) | words[np.minimum(at, len(words) - 1)], moved)
        at = at + refill
        state = np.where(live, moved, state)
    grid = out.reshape(steps, len(coded), LANES).transpose(1, 0, 2).reshape(len(coded), -1)
    found = [grid[i, : sizes[i]] for i in range(len(coded))]
    for h, ids in zip(head, found, strict=True):
        if zlib.crc32(ids.astype("<u4").tobytes()) != int(h[1]):
            raise ValueError("a block's ids don't match its checksum")
    return found


def write_files(ids: DataFrame, freq: np.ndarray, path: str, parts: int, kind: str) -> None:
    """Segments of consecutive documents, in files of ascending doc_id ranges: range, number in it, keys, lengths, coded blocks."""
    raw = freq.astype("<i8").tobytes()
    shared = ids.sparkSession.sparkContext.broadcast(raw)
    columns = {"part": pa.int32(), "segment": pa.int32(), "keys": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "blocks": pa.list_(pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part = Packer(kind), TaskContext.get().partitionId()
        keys, held, size, number = [], [], 0, 0

        def segment() -> pa.RecordBatch:
            stream = np.concatenate(held)
            coded = encode_blocks([stream[i : i + BLOCK_TOKENS] for i in range(0, len(stream), BLOCK_TOKENS)], shared.value)
            values = [[part], [number], [keys], [[len(h) for h in held]], [coded]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, columns.values(), strict=True)], list(columns))

        for batch in batches:
            for key, value in zip(batch.column("key").to_pylist(), batch.column("ids"), strict=True):
                keys.append(key)
                held.append(packer.unpack(value.as_py()))
                size += len(held[-1])
                if size >= 64 * BLOCK_TOKENS:
                    yield segment()
                    keys, held, size, number = [], [], 0, number + 1
        if held:
            yield segment()

    ranged = ids.withColumn("tie", F.crc32("ids")).repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie").drop("tie")
    coded = map_batches(ranged, run, "part int, segment int, keys array<long>, lengths array<long>, blocks array<binary>")
    coded.write.option("compression", "uncompressed").parquet(path)


def read_files(spark: SparkSession, path: str, freq: np.ndarray) -> DataFrame:
    """(part, segment, before, key, ids) of every document in the files; `before` counts ids in front of it in its segment."""
    shared = spark.sparkContext.broadcast(freq.astype("<i8").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, lengths = batch.column("keys")[row].as_py(), np.array(batch.column("lengths")[row].as_py())
                stream = np.concatenate(decode_blocks(batch.column("blocks")[row].as_py(), shared.value))
                cuts = np.concatenate(([0], np.cumsum(lengths)))
                ids = [stream[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                place = [pa.array(np.full(len(keys), batch.column(c)[row].as_py(), np.int32)) for c in ("part", "segment")]
                yield pa.RecordBatch.from_arrays([*place, pa.array(cuts[:-1]), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["part", "segment", "before", "key", "ids"])

    return map_batches(spark.read.parquet(path), run, "part int, segment int, before long, key long, ids binary")


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, segment, base): the number of ids in all segments in front, from the lengths in the files."""
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = spark.read.parquet(path).select("part", "segment", length.alias("n"))
    totals = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a number a file
    ahead = spark.createDataFrame([(p, sum_) for (p, _), sum_ in zip(totals, accumulate((n for _, n in totals), initial=0), strict=False)], "part int, ahead long")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("inside", inside).join(ahead, "part").select("part", "segment", (F.col("ahead") + F.col("inside")).alias("base"))


def digests(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents read back from the files at `path`."""
    rows = documents.select("part", "segment", "before", "key", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    doc_id = F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id")
    return rows.join(segment_starts(spark, path), ["part", "segment"]).select(doc_id, (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, model: str, vocabulary: int, end_id: int, path: str) -> tuple[DataFrame, np.ndarray]:
    """Writes the files at `path`; returns the documents read back from them, and the frequency table."""
    spark = docs.sparkSession
    kind = "<u2" if vocabulary <= 2**16 else "<u4"
    ids = written(encode_ids(docs, model, end_id, kind), "token-ids")
    freq = frequencies(ids, vocabulary, kind)
    write_files(ids, freq, path, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), kind)
    return read_files(spark, path, freq), freq


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json
    import uuid

    import public_tokenizers

    model = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()  # noqa: SIM115
    vocabulary = max(json.loads(model)["model"]["vocab"].values()) + 2
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    documents, _ = token_files(table(spark, sf_dir, "documents"), model, vocabulary, 2, path)
    return digests(spark, path, documents)
