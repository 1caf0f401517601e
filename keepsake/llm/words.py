"""Words of many texts at once, as numpy arrays over their bytes, and the traffic between groups of texts and shards of hashes.

Texts are dealt to groups of bounded size. A group sends what it has counted to shards (ranges of a 64-bit hash) in sorted,
packed arrays, one for a group and shard, and gets answers the same way: what is frequent in a group is sent once,
however often it occurs. A group may be read again for its answers, as it comes from the same shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_BYTES, MIN_GROUPS = 8_000_000, 64
NO_ID = -(2**63)
BASE, BASE_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


class Words:
    """The words of a column of texts (null: none): runs of bytes that `breaks` does not mark, in the order of the texts.

    `starts` and `ends` are places in `data`, `doc` the row of each word, `ids` numbers of equal words in `distinct`.
    """

    def __init__(self, texts: pa.ChunkedArray, breaks: np.ndarray, fold: np.ndarray | None = None):
        column = pc.fill_null(texts.combine_chunks().cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        data = np.insert(whole, offsets[1:], 10)  # a line feed ends each text, so no word runs into the next text
        self.data = data if fold is None else fold[data]
        self.texts = len(offsets) - 1
        inside = ~breaks[self.data]
        edges = np.diff(inside.astype(np.int8), prepend=0)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.doc = np.searchsorted(offsets[1:] + np.arange(1, len(offsets)), self.starts, side="right")
        cuts = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(cuts), pa.py_buffer(self.data[inside])])
        coded = packed.dictionary_encode()
        self.ids, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """Two independent 64-bit hashes of each distinct word, in two rows."""
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.distinct)), ">u8").astype(np.uint64).reshape(-1, 2).T


def rolling(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2^64, of every `size` consecutive word hashes."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= base
        out += hashes[k : k + n]
    return out


def runs(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): a stable order by (h, c), and where runs of equal pairs start in it."""
    order = np.argsort(h, kind="stable")
    equal = np.diff(h[order]) == 0
    differ = np.diff(c[order]) != 0
    if np.any(equal & differ):
        order = np.lexsort((c, h))
        equal, differ = np.diff(h[order]) == 0, np.diff(c[order]) != 0
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), ~equal | differ)))


def run_numbers(n: int, starts: np.ndarray) -> np.ndarray:
    """The number of its run for each of n sorted places."""
    out = np.zeros(n, np.int64)
    out[starts[1:]] = 1
    return np.cumsum(out)


def pack(h: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending hashes as differences, and further columns, all by planes of equal bytes, compressed."""
    planes = [np.diff(h, prepend=np.uint64(0)), *columns]
    raw = b"".join(np.ascontiguousarray(p).view(np.uint8).reshape(len(h), -1).T.tobytes() for p in planes)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    types = [np.dtype(k) for k in ("u8", *kinds)]
    n, at, out = len(raw) // sum(t.itemsize for t in types), 0, []
    for t in types:
        planes = raw[at : at + n * t.itemsize].reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += n * t.itemsize
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def shard_slices(h: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of ascending hashes: the shard is the leading `bits` bits."""
    if not len(h):
        return []
    shard = h >> np.uint64(64 - bits)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(h)]))
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def groups_and_bits(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[int, int]:
    """How many groups of about `group_bytes` the texts make, and the bits of as many shards."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    groups = max(MIN_GROUPS, -(-total // group_bytes))
    return groups, (groups - 1).bit_length()


def group_of(groups: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("long")


def table_of(schema: str, **columns: object) -> pa.Table:
    """A table of the columns named in `schema` (name and Arrow type, by commas)."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array(columns[n], kinds[k]) for n, k in fields})
