"""Byte-level BPE encoding and decoding with numpy matrices.

Pieces (matches of the split pattern) are bucketed by length and laid out as padded matrices of token ids, one
piece a row. In each round every row merges its leftmost pair of minimum rank: the rank matrix is looked up by
hashed pairs, rows are compacted by one column, and only the two ranks beside the merge are looked up again. Rows
without a mergeable pair leave the matrix. A row over LONG bytes is a matrix of its own in which a round merges all
places of its least pair from the left; where a merge makes a pair of lower rank, that round merges the leftmost alone.

Decoding gathers the bytes of the ids from one flat table.

Defined cases: a null text counts as empty and has no ids; an empty table gives an empty result; rows may repeat;
very long texts are encoded whole; further columns pass through, and columns named as the results are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.batches import map_batches
from keepsake.llm.chunks import SLICE_CHARS, ChunkCache
from keepsake.llm.numerics import mix64, ragged, text_slices
from keepsake.runtime import table

NONE = np.int32(2**31 - 1)
LONG = 512


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Decoder:
    """The bytes of all tokens in one flat table."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()


class Vocabulary:
    """Ranks of a rank file, with a hash table from pairs of ids to the id of their join."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = [
            (self.ranks[t[:i]], self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        keys = np.array([(a << 32) | b for a, b, _ in pairs], np.uint64)
        values = np.array([r for _, _, r in pairs], np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 2.5))))
        self.keys, self.values = np.full(2**self.bits, 2**64 - 1, np.uint64), np.full(2**self.bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # linear probing, all keys a step at a time
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            first = np.unique(slot[todo[free]], return_index=True)[1]
            put = todo[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (2**self.bits - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge or an id is padding (negative)."""
        shape = left.shape
        real = ((left >= 0) & (right >= 0)).ravel()
        keys = (left.ravel()[real].astype(np.uint64) << np.uint64(32)) | right.ravel()[real].astype(np.uint64)
        slot, found, todo = self._slot(keys), np.full(len(keys), NONE), np.arange(len(keys))
        while len(todo):
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            found[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (at != np.uint64(2**64 - 1))]
            slot[todo] = (slot[todo] + 1) & (2**self.bits - 1)
        out = np.full(len(real), NONE)
        out[real] = found
        return out.reshape(shape)

    def merge_matrix(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merges rows of ids padded by -1; yields (row numbers, ids left in each, those ids in turn) as rows end."""
        rows = np.arange(len(ids))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            every = np.arange(len(rows))
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[every, at] if ranks.shape[1] else np.full(len(rows), NONE)
            over = least == NONE
            if over.any():
                done = ids[over]
                real = done >= 0
                yield rows[over], real.sum(1), done[real]
                go = ~over
                rows, ids, ranks, at, least = rows[go], ids[go], ranks[go], at[go], least[go]
                every = np.arange(len(rows))
            if not len(rows):
                return
            ids[every, at] = least
            shift = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, shift + (shift > at[:, None]), 1)
            shift = np.arange(ranks.shape[1] - 1)[None, :]
            ranks = np.take_along_axis(ranks, shift + (shift >= at[:, None]), 1)
            for beside in (at - 1, at):
                ok = (beside >= 0) & (beside < ranks.shape[1])
                r, c = every[ok], beside[ok]
                ranks[r, c] = self.pair_ranks(ids[r, c], ids[r, c + 1])

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same merges for one long row: a round merges all places of the least pair that the leftmost leaves open."""
        ids = ids.astype(np.int32)
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            # in a run of overlapping places every second one is taken, from the left
            run = np.cumsum(np.diff(at, prepend=-2) != 1)
            first = np.flatnonzero(np.diff(run, prepend=0))
            at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]
            new, beside = self._merge_all(ids, at, least)
            between = self.pair_ranks(np.array([least, least]), np.array([ids[at[0]], least]))
            if len(at) > 1 and min(beside.min(initial=NONE), between.min()) < least:
                at = at[:1]
                new, beside = self._merge_all(ids, at, least)
            # every place taken shifts what follows by one; only the pairs beside a merge are looked up again
            keep = np.ones(len(ranks), bool)
            keep[at] = False
            ranks = ranks[keep]
            place = at - np.arange(len(at))
            for side, values in ((place - 1, beside[: len(at)]), (place, beside[len(at) :])):
                ok = (side >= 0) & (side < len(ranks))
                ranks[side[ok]] = values[ok]
            ids = new
        return ids

    def _merge_all(self, ids: np.ndarray, at: np.ndarray, joined: np.int32) -> tuple[np.ndarray, np.ndarray]:
        """(ids after the merges at `at`, ranks of the pairs left of each merge and then right of each)."""
        new = ids.copy()
        new[at] = joined
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        new = new[keep]
        place = at - np.arange(len(at))
        padded = np.concatenate(([-1], new, [-1]))
        return new, self.pair_ranks(np.concatenate((padded[place], padded[place + 1])), np.concatenate((padded[place + 1], padded[place + 2])))

    def encode_pieces(self, raw: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in turn, number of ids of each)."""
        flat = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        whole = np.array([self.ranks.get(p, -1) for p in raw], np.int64)
        known = np.flatnonzero(whole >= 0)
        parts = [(known, np.ones(len(known), np.int64), whole[known])]
        for i in np.flatnonzero((whole < 0) & (sizes > LONG)):
            ids = self.merge_long(flat[starts[i] : starts[i] + sizes[i]])
            parts.append((np.array([i]), np.array([len(ids)]), ids))
        short = np.flatnonzero((whole < 0) & (sizes <= LONG))
        widths = 2 ** np.ceil(np.log2(np.maximum(sizes[short], 1))).astype(np.int64)
        for width in np.unique(widths):
            mine = short[widths == width]
            for part in np.array_split(mine, -(-len(mine) * int(width) // 1_000_000)):
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width)[None, :] < sizes[part][:, None]] = flat[ragged(starts[part], sizes[part])]
                parts += [(part[rows], n, left) for rows, n, left in self.merge_matrix(ids)]
        lengths = np.zeros(len(raw), np.int64)
        for at, n, _ in parts:
            lengths[at] = n
        begins = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.int64)
        for at, n, ids in parts:
            out[ragged(begins[at], n)] = ids
        return out, lengths

    def encode_chunks(self, chunks: list[bytes], follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in turn, number of ids of each): chunks that may follow each other are split in one go."""
        order = np.argsort(follows, kind="stable")
        apart = len(chunks) - int(follows.sum())
        came = [chunks[i] for i in order]
        found = [self.pattern.findall(c.decode()) for c in came[:apart]]
        run = self.pattern.findall(b"".join(came[apart:]).decode())
        raw = [p.encode() for p in [*(p for f in found for p in f), *run]]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, lengths = self.encode_pieces(raw, sizes)
        # pieces never reach across chunks, so the chunks' sizes tell where each one's pieces end
        cuts = np.cumsum(np.fromiter(map(len, came), np.int64, len(came)))
        upto = np.searchsorted(np.cumsum(sizes), cuts, side="right")
        tokens = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], upto))]
        n_ids = np.diff(tokens)
        back = np.empty(len(came), np.int64)
        back[order] = np.arange(len(came))
        return ids[ragged(tokens[:-1][back], n_ids[back])], n_ids[back]


@lru_cache(maxsize=1)
def _encoder(data: bytes, pattern: str) -> ChunkCache:
    return ChunkCache(Vocabulary(data, pattern).encode_chunks)


@lru_cache(maxsize=1)
def _decoder(data: bytes) -> Decoder:
    return Decoder(read_ranks(data))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`docs` with `ids`: its text's ids as little-endian 32-bit integers, one binary a row."""
    docs = docs.drop("ids")
    data = open(ranks_path, "rb").read()  # noqa: SIM115  the file's size is fixed
    shared = docs.sparkSession.sparkContext.broadcast((data, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _encoder(*shared.value)
        for batch in batches:
            for start, end, texts in text_slices(batch, SLICE_CHARS):
                ids, lengths = chunks.ids(texts)
                cuts = np.concatenate(([0], np.cumsum(lengths))) * 4
                raw = ids.astype("<u4").tobytes()
                rows = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, pa.array(rows, pa.binary())], [*batch.schema.names, "ids"])
        chunks.clear()  # the worker may serve other tasks for long

    return map_batches(docs, run, f"{_schema(docs)}, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """`encoded` with `decoded`: the bytes of its ids."""
    encoded = encoded.drop("decoded")
    data = open(ranks_path, "rb").read()  # noqa: SIM115
    shared = encoded.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for batch in batches:
            rows = [decoder.decode(np.frombuffer(i.as_buffer(), "<u4").astype(np.int64)) if i.is_valid else b"" for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], [*batch.schema.names, "decoded"])

    return map_batches(encoded, run, f"{_schema(encoded)}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to."""
    both = decode(encode(docs.select("doc_id", "text"), ranks_path, pattern).select("doc_id", "ids"), ranks_path)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
