"""Whole numbers of 128 bits as pairs of arrays (low, high), two's complement: sums of products of long times, without loss."""

from __future__ import annotations

import numpy as np

Wide = tuple[np.ndarray, np.ndarray]
HALF, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def wide(a: np.ndarray) -> Wide:
    a = a.astype(np.int64)
    return a.view(np.uint64), (a >> 63).view(np.uint64)


def of_ints(values: list[int]) -> Wide:
    return np.array([v % 2**64 for v in values], np.uint64), np.array([(v >> 64) % 2**64 for v in values], np.uint64)


def to_int(p: Wide, at: int) -> int:
    v = int(p[1][at]) << 64 | int(p[0][at])
    return v - 2**128 if v >> 127 else v


def take(p: Wide, at: np.ndarray) -> Wide:
    return p[0][at], p[1][at]


def plus(p: Wide, q: Wide) -> Wide:
    low = p[0] + q[0]
    return low, p[1] + q[1] + (low < q[0])


def minus(p: Wide, q: Wide) -> Wide:
    return p[0] - q[0], p[1] - q[1] - (p[0] < q[0])


def times(p: Wide, b: np.ndarray) -> Wide:
    """p times 64-bit numbers, by halves."""
    (a, high), (u, sign) = p, wide(b)
    a0, a1, u0, u1 = a & LOW, a >> HALF, u & LOW, u >> HALF
    x, y = a0 * u1, a1 * u0
    middle = (a0 * u0 >> HALF) + (x & LOW) + (y & LOW)
    return a * u, a1 * u1 + (x >> HALF) + (y >> HALF) + (middle >> HALF) + high * u + a * sign


def sums(p: Wide) -> Wide:
    """The sum of what is before each place, and of all."""
    total = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    low, middle, high = total(p[0] & LOW), total(p[0] >> HALF), total(p[1])
    middle += low >> HALF
    return middle << HALF | low & LOW, high + (middle >> HALF)


def doubles(p: Wide) -> np.ndarray:
    negative = p[1] >> np.uint64(63) == 1
    m = minus((np.zeros_like(p[0]), np.zeros_like(p[1])), p)
    low, high = np.where(negative, m[0], p[0]), np.where(negative, m[1], p[1])
    return np.where(negative, -1.0, 1.0) * (high.astype(float) * 2.0**64 + low.astype(float))
