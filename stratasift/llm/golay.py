"""The binary Golay code of 23 bits: nearest codewords and list decoding, for numpy arrays.

The code is perfect: every 23-bit word has exactly one codeword within three
bits.  If two words differ in one bit, the codeword nearest to one is within
four bits of the other, so lists of radius four always share a key.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

# Length, dimension and generator polynomial of the code.
LENGTH, DIMENSION, GENERATOR = 23, 12, 0b110001110101

_CHECK = LENGTH - DIMENSION


@lru_cache(maxsize=1)
def _remainders() -> np.ndarray:
    """What dividing each power of x by the generator leaves."""
    out, r = [], 1
    for _ in range(LENGTH):
        out.append(r)
        r <<= 1
        if r >> _CHECK & 1:
            r ^= GENERATOR
    return np.array(out, dtype=np.int64)


def syndrome(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for i, r in enumerate(_remainders()):
        out ^= np.where((words >> i) & 1, r, 0)
    return out


@lru_cache(maxsize=4)
def error_table(radius: int) -> np.ndarray:
    """Row s: all error patterns of at most ``radius`` bits with syndrome s, lightest first; -1 fills up."""
    lists: list[list[int]] = [[] for _ in range(1 << _CHECK)]
    rem = _remainders().tolist()
    for weight in range(radius + 1):
        for bits in combinations(range(LENGTH), weight):
            s = e = 0
            for b in bits:
                s ^= rem[b]
                e |= 1 << b
            lists[s].append(e)
    table = np.full((len(lists), max(map(len, lists))), -1, np.int64)
    for s, errors in enumerate(lists):
        table[s, : len(errors)] = errors
    return table


def codeword_indices(words: np.ndarray, radius: int = 4) -> np.ndarray:
    """12-bit indices of the codewords within ``radius`` of each 23-bit word, nearest first; -1 fills up."""
    errors = error_table(radius)[syndrome(words)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> _CHECK, -1)
