"""Small numpy helpers that several operators use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_slices(batch: pa.RecordBatch, chars: int = 1_000_000) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, texts with null as empty) of runs of a batch's rows of at most `chars` bytes of text, or of one longer text."""
    column = batch.column("text")
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > chars:
            yield start, i, [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes), [t or "" for t in column.slice(start).to_pylist()]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@cache
def spaces() -> np.ndarray:
    """Whether each code point is white space to str.split()."""
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), dtype=bool, count=0x110000)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... (lengths[i] of them), for all i in turn."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


@cache
def word_signs() -> np.ndarray:
    """Whether each code point is a letter or digit to str.isalnum()."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


def polynomial_sums(codes: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of codes times powers of an odd base, and the inverse powers, modulo 2^64.

    (sums[e] - sums[s]) * inverse[s] is then a hash of codes[s:e] that does not depend on the place.
    """
    with np.errstate(over="ignore"):
        up, down = np.full(len(codes) + 1, base, np.uint64), np.full(len(codes) + 1, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=sums[1:])
    return sums, down
