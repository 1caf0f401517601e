"""Splitting texts where byte-level tokenizers always split, and a cache of what each chunk encodes to.

With the usual pattern (an optional blank before letters, digits or other signs; white space otherwise) a piece never
reaches across a blank that a non-space character follows, nor from a letter into a mark or a line's end. Texts are
cut there, as bytes and a whole slice of texts at a time; a tokenizer then sees each distinct chunk of a slice once,
and not again while the chunk is in the cache. A document's ids are its chunks' ids in turn.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from keepsake.llm.numerics import ragged

SLICE_CHARS = 2_000_000
CACHE_BYTES, LONG_CHUNK, CHUNK_OVERHEAD = 40_000_000, 256, 160

MARKS = np.array([33 <= b < 127 and not chr(b).isalnum() or b == 10 for b in range(256)])
LETTERS = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def _visible(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at each place is surely not white space; `data` ends in two spare bytes."""
    a, b, c = data[at], data[at + 1], data[at + 2]
    ok = (a > 32) & (a != 127)
    ok &= ~((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
    ok &= ~((a == 0xE1) & ((b == 0x9A) | (b == 0xA0)))
    ok &= ~((a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81)))
    return ok & ~((a == 0xE3) & (b == 0x80) & (c == 0x80))


def cut(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(chunk starts, whether each chunk may follow any other in one text) of the texts data[offsets[i]:offsets[i + 1]].

    `data` ends in two spare bytes; texts marked in `whole` stay one chunk.
    """
    size = int(offsets[-1])
    starts = np.zeros(size + 1, bool)
    starts[offsets] = True
    blank = np.flatnonzero(data[:size] == 32)
    blank = blank[~starts[blank + 1]]
    blank = blank[_visible(data, blank + 1)]
    mark = np.flatnonzero(MARKS[data[:size]])
    mark = mark[~starts[mark] & (mark > 0)]
    before, lead = data[mark - 1], data[np.maximum(mark - 2, 0)]
    mark = mark[LETTERS[before] | (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)]
    follows = np.zeros(size + 1, bool)
    follows[blank] = True
    begin = follows.copy()
    begin[mark] = True
    if whole is not None and whole.any():
        inside = np.repeat(whole, np.diff(offsets))
        begin[:size] &= ~inside
        follows[:size] &= ~inside
    begin |= starts
    at = np.flatnonzero(begin[:size])
    return at, follows[at]


class ChunkCache:
    """Ids of chunks, by `encode` (chunks as bytes, and whether each may follow any other, to ids and their numbers).

    What is kept over is bounded in bytes: over `limit` the most used half stays, and long chunks never do.
    """

    def __init__(self, encode: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_BYTES):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.uses, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        names = list(self.slots)
        keep = np.flatnonzero((self.uses > 1) & (self.sizes <= LONG_CHUNK))
        keep = keep[np.argsort(-self.uses[keep], kind="stable")]
        cost = np.cumsum(self.sizes[keep] + 4 * self.lengths[keep] + CHUNK_OVERHEAD)
        keep = keep[cost <= self.limit // 2]
        lengths = self.lengths[keep]
        self.flat = self.flat[ragged(self.starts[keep], lengths)]
        self.starts, self.lengths, self.uses, self.sizes = np.cumsum(lengths) - lengths, lengths, self.uses[keep] // 2, self.sizes[keep]
        self.slots = {names[k]: i for i, k in enumerate(keep.tolist())}

    def _learn(self, fresh: list[bytes], follows: np.ndarray) -> None:
        ids, lengths = self.encode(fresh, follows)
        ends = np.cumsum(lengths) + len(self.flat)
        self.slots.update(zip(fresh, range(len(self.slots), len(self.slots) + len(fresh)), strict=True))
        self.starts = np.concatenate((self.starts, ends - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, ids.astype(np.uint32)))
        self.uses = np.concatenate((self.uses, np.zeros(len(fresh), np.int32)))
        self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, fresh), np.int64, len(fresh))))

    def ids(self, texts: list[str], whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each text)."""
        held = len(self.flat) * 4 + int(self.sizes.sum()) + CHUNK_OVERHEAD * len(self.slots)
        if held > self.limit or (self.sizes > LONG_CHUNK).any():
            self._shrink()
        raw = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
        joined = b"".join(raw) + b"\0\0"
        at, follows = cut(np.frombuffer(joined, np.uint8), offsets, whole)
        edges = np.append(at, offsets[-1])
        buffers = [None, pa.py_buffer(edges), pa.py_buffer(joined)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), buffers).dictionary_encode()
        number = coded.indices.to_numpy()
        names = coded.dictionary.to_pylist()
        slots = np.fromiter((self.slots.get(c, -1) for c in names), np.int64, len(names))
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            mayfollow = np.zeros(len(names), bool)
            mayfollow[number] = follows
            slots[fresh] = np.arange(len(self.slots), len(self.slots) + len(fresh))
            self._learn([names[i] for i in fresh], mayfollow[fresh])
        self.uses[slots] += np.bincount(number, minlength=len(names)).astype(np.int32)
        place = slots[number]
        lengths = self.lengths[place]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return self.flat[ragged(self.starts[place], lengths)], np.diff(ends[np.searchsorted(at, offsets)])
