"""Words in columns of UTF-8 text, found by numpy over the concatenated bytes of a whole Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Whether a byte belongs to a word: ASCII letters and all bytes of other characters.
INSIDE = np.zeros(256, bool)
INSIDE[0x41:0x5B] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
#: A-Z to a-z; all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; text i is bytes[offsets[i]:offsets[i + 1]]."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def text_shares(b: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Shares of a batch with about `most` bytes of text, or one longer text: a word's numbers take some hundred bytes while it is counted."""
    _, offsets = text_bytes(b[column])
    i = 0
    while i < len(b):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield b.slice(i, j - i)
        i = j


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all words; none crosses from one text to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = INSIDE[data]
    apart = np.zeros(len(data) + 1, bool)
    apart[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | apart[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | apart[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def pieces(ends: np.ndarray, starts: np.ndarray, most: int = 1 << 22) -> Iterator[slice]:
    """Ranges of words that span about `most` bytes, so that working memory is bounded for any batch and text."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        yield slice(i, j)
        i = j


def equal_to(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether the `lengths` bytes at each start are those at the other start."""
    at = np.repeat(np.cumsum(lengths) - lengths, lengths)
    step = np.arange(lengths.sum()) - at
    unlike = data[np.repeat(starts, lengths) + step] != data[np.repeat(others, lengths) + step]
    return ~np.logical_or.reduceat(unlike, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0, bool)


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(first, code): slices of equal bytes have one code, and first[code] is the number of one of them.

    Hashes group the slices; then every slice is compared byte by byte with the first of its group. Those that
    differ, whose hashes collide, are grouped by their bytes.
    """
    raw, n = data.tobytes(), len(starts)
    hashes = np.fromiter((digest(raw[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, n)
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends - starts
    same = lengths == lengths[first[code]]
    for part in pieces(ends, starts, 1 << 19):  # some 40 bytes for each one compared
        k = np.flatnonzero(same[part]) + part.start
        same[k] = equal_to(data, starts[k], lengths[k], starts[first[code[k]]])
    if not same.all():
        more: dict[bytes, int] = {}
        extra = list(first)
        for k in np.flatnonzero(~same):
            word = raw[starts[k] : ends[k]]
            if word not in more:
                more[word] = len(extra)
                extra.append(k)
            code[k] = more[word]
        first = np.array(extra)
    return first, code


#: Odd, so that it has an inverse among the 64-bit numbers.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For whole words, then for each length below a word's own: (numbers of words, hashes of their first bytes).

    A polynomial hash: sums of byte x base^place, read off one running sum, so no slice is touched one by one.
    """
    lo, hi = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
    run = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * powers(BASE, hi - lo), out=run[1:])
    a, z, back = starts - lo, ends - lo, powers(INVERSE, hi - lo + 1)
    for salt, k in enumerate((None, *lengths)):
        which = np.arange(len(starts)) if k is None else np.flatnonzero(ends - starts > k)
        s = a[which]
        e = z[which] if k is None else s + k
        h = (run[e] - run[s]) * back[s] + np.uint64(salt)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        yield which, h ^ (h >> np.uint64(32))
