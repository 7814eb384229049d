"""Hashed character n-grams of whole texts, as arrays."""

from __future__ import annotations

import numpy as np

#: Characters that are hashed at once; longer texts are taken in pieces that overlap by an n-gram.
PIECE = 1 << 20
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def rolled(codes: np.ndarray, least: int, most: int, bits: int):
    """Arrays of numbers below 2**bits, one for each n-gram of `least` to `most` codes, a length at a time."""
    shift = np.uint64(64 - bits)
    codes = codes.astype(np.uint64) + np.uint64(1)
    sums = codes
    for n in range(1, most + 1):
        if n > 1:
            if len(sums) < 2:
                break
            sums = sums[:-1] * _STEP + codes[n - 1 :]
        if n >= least:
            mixed = (sums ^ (sums >> np.uint64(29))) * _SPREAD
            yield (mixed >> shift).astype(np.int64)


def hashed(text: str, least: int, most: int, bits: int):
    """Arrays of numbers below 2**bits, one for each n-gram of `least` to `most` characters, in pieces."""
    for start in range(0, max(1, len(text)), PIECE):
        piece = text[start : start + PIECE + most - 1].encode("utf-32-le", "surrogatepass")
        yield from rolled(np.frombuffer(piece, np.uint32), least, most, bits)


def present(text: str, least: int, most: int, bits: int) -> np.ndarray:
    """Which of the 2**bits numbers the n-grams of a text have."""
    flags = np.zeros(1 << bits, bool)
    for codes in hashed(text, least, most, bits):
        flags[codes] = True
    return flags
