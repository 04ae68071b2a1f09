"""Number-theoretic transforms over the rows of matrices, and exact squared differences.

All arithmetic is on integers below primes of at most 31 bits, so products fit 64 bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Primes c * 2^k + 1 with a primitive root; transforms of up to 2^26 terms.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
MAX_TERMS = 1 << 26


class Transform:
    """Transforms of ``size`` terms (a power of two) modulo ``prime``, along the last axis."""

    def __init__(self, size: int, prime: int, root: int):
        if size > MAX_TERMS or size & (size - 1):
            raise ValueError(f"{size} terms: a power of two up to {MAX_TERMS} is needed")
        self.size, self.prime, self.p = size, prime, U(prime)
        self.inverse_size = U(pow(size, -1, prime))
        unit = pow(root, (prime - 1) // size, prime)
        self.down = self._stages(unit)
        self.up = self._stages(pow(unit, -1, prime))

    def _stages(self, unit: int) -> list[np.ndarray]:
        """For each stage, halves of ``size / 2``, ``size / 4``, ... : the powers of its unit."""
        out, half = [], self.size // 2
        while half:
            powers = np.ones(half, U)
            have, step = 1, unit
            while have < half:
                more = min(have, half - have)
                powers[have:have + more] = powers[:more] * U(step) % self.p
                step, have = step * step % self.prime, have * 2
            out.append(powers)
            unit, half = unit * unit % self.prime, half // 2
        return out

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """Values in bit-reversed order; ``rows`` holds numbers below the prime."""
        p = self.p
        for powers in self.down:
            pairs = rows.reshape(len(rows), -1, 2, len(powers))
            a, b = pairs[:, :, 0], pairs[:, :, 1]
            total = a + b
            made = np.empty_like(pairs)
            made[:, :, 0] = np.minimum(total, total - p)  # below zero wraps to a high number
            made[:, :, 1] = (a + (p - b)) * powers % p
            rows = made.reshape(len(rows), -1)
        return rows

    def backward(self, rows: np.ndarray) -> np.ndarray:
        """The inverse of ``forward``."""
        p = self.p
        for powers in reversed(self.up):
            pairs = rows.reshape(len(rows), -1, 2, len(powers))
            a, b = pairs[:, :, 0], pairs[:, :, 1] * powers % p
            total, gap = a + b, a + (p - b)
            made = np.empty_like(pairs)
            made[:, :, 0] = np.minimum(total, total - p)
            made[:, :, 1] = np.minimum(gap, gap - p)
            rows = made.reshape(len(rows), -1)
        return rows * self.inverse_size % p


_transforms: dict[tuple[int, int], Transform] = {}


def _transform(size: int, prime: int, root: int) -> Transform:
    if (size, prime) not in _transforms:
        if sum(t.size for t in _transforms.values()) > 1 << 22:
            _transforms.clear()
        _transforms[size, prime] = Transform(size, prime, root)
    return _transforms[size, prime]


def zero_differences(blocks: np.ndarray, windows: np.ndarray, top: int) -> np.ndarray:
    """Where each block occurs in its own window: true at (row, lag) for equal numbers.

    ``blocks`` (rows x b) and ``windows`` (rows x w) hold numbers 0 .. ``top``. The sum of
    squared differences of block and window at a lag, b * top^2 at most, is computed modulo
    as many primes as their product needs to exceed it: it's zero only where all of them are.
    """
    rows, b = blocks.shape
    w = windows.shape[1]
    size = 1 << (w - 1).bit_length()
    equal = np.ones((rows, w - b + 1), bool)
    bound, covered = b * top * top, 1
    for prime, root in PRIMES:
        p = U(prime)
        plan = _transform(size, prime, root)
        x, y = np.zeros((rows, size), U), np.zeros((rows, size), U)
        x[:, 0] = blocks[:, 0] % prime
        x[:, size - b + 1:] = blocks[:, :0:-1] % prime  # reversed in a circle
        y[:, :w] = windows % prime
        both = plan.backward(plan.forward(x) * plan.forward(y) % p)[:, :w - b + 1]
        own = (x * x % p).sum(1) % p
        squares = np.zeros((rows, w + 1), U)
        np.cumsum(y[:, :w] * y[:, :w] % p, axis=1, out=squares[:, 1:])
        there = (squares[:, b:] - squares[:, :-b]) % p
        equal &= (own[:, None] + there) % p == both * U(2) % p
        covered *= prime
        if covered > bound:
            return equal
    raise ValueError(f"blocks of {b} numbers up to {top} are beyond the primes")
