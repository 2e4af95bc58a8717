"""Exact integer matrix products through float64 BLAS, by splitting integers into limbs."""

from __future__ import annotations

import numpy as np

#: Integers up to here are exact in a float64.
EXACT_BITS = 53


def limb_bits(inner: int) -> int:
    """Bits a limb may have so that ``inner`` products of two limbs add up to 2^53 at most."""
    return (EXACT_BITS - max(inner - 1, 0).bit_length()) // 2


def split_limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` (int64) as float64 limbs of ``bits`` bits, lowest first; the last one is signed."""
    limbs, rest, size = [], values, 1 << bits
    while rest.size and (rest.max() > size or rest.min() < -size):
        limbs.append((rest & (size - 1)).astype(np.float64))
        rest = rest >> bits
    return [*limbs, rest.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices, exact where the result fits an int64.

    Each pair of limbs is one float64 product whose entries stay below 2^53; the
    products are shifted to their places and added in int64.
    """
    bits = limb_bits(a.shape[1])
    total = np.zeros((a.shape[0], b.shape[1]), np.int64)
    right = split_limbs(b, bits)
    for i, x in enumerate(split_limbs(a, bits)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:  # what is shifted farther is a multiple of 2^64
                total += (x @ y).astype(np.int64) << np.int64(bits * (i + j))
    return total
