"""Binary Golay code (23, 12, 7): nearest codewords of 23-bit vectors, in numpy.

The code is perfect: each vector lies within distance 3 of exactly one codeword.  The codewords
reached from the vector itself and from its 23 one-bit changes are one or six; two vectors that
differ in one bit therefore share the index of each other's own codeword.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS, CHECKS, GENERATOR = 23, 11, 0xC75


@lru_cache(maxsize=1)
def decode_table() -> np.ndarray:
    """uint16[2^23]: the 12 information bits of the nearest codeword (16 MB, built once a process)."""
    residue = np.zeros(BITS, dtype=np.int64)
    for bit in range(BITS):
        value = 1 << bit
        for high in range(bit, CHECKS - 1, -1):
            if value >> high & 1:
                value ^= GENERATOR << (high - CHECKS)
        residue[bit] = value
    error = np.zeros(1 << CHECKS, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(BITS), weight):
            error[np.bitwise_xor.reduce(residue[list(bits)])] = sum(1 << b for b in bits)
    low, high = np.arange(1 << 12), np.arange(1 << 11)
    syndrome_low = np.zeros(len(low), dtype=np.int64)
    syndrome_high = np.zeros(len(high), dtype=np.int64)
    for bit in range(12):
        syndrome_low ^= np.where(low >> bit & 1, residue[bit], 0)
    for bit in range(11):
        syndrome_high ^= np.where(high >> bit & 1, residue[bit + 12], 0)
    table = np.empty((len(high), len(low)), dtype=np.uint16)
    for h in high:  # row by row, so that nothing but the table takes much memory
        table[h] = (h << 12 | low) >> CHECKS ^ error[syndrome_high[h] ^ syndrome_low] >> CHECKS
    return table.ravel()


def nearby(vectors: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each vector and its changes in one of the first ``bits`` bits: values (n, bits + 1) in
    ascending order, and a mask of first occurrences."""
    table = decode_table()
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    keys = table[vectors[:, None] ^ flips[None, :]]
    order = np.argsort(keys, axis=1, kind="stable")
    ranked = np.take_along_axis(keys, order, axis=1)
    fresh = np.ones(keys.shape, dtype=bool)
    fresh[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    return ranked, fresh
