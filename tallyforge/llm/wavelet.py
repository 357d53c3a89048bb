"""A wavelet matrix over a short alphabet: rank of any symbol before any place, without the sequence itself."""

from __future__ import annotations

import numpy as np

#: Bits that one entry of the directory counts.
_BLOCK = 512


class _Bits:
    """A bit vector that tells how many ones come before a place."""

    def __init__(self, bits: np.ndarray):
        size = (len(bits) // _BLOCK + 1) * _BLOCK
        padded = np.zeros(size, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        per_word = np.bitwise_count(self.words).astype(np.int64)
        self.directory = np.concatenate([[0], np.cumsum(per_word.reshape(-1, _BLOCK // 64).sum(axis=1))])
        inside = np.cumsum(per_word.reshape(-1, _BLOCK // 64), axis=1) - per_word.reshape(-1, _BLOCK // 64)
        self.inside = inside.reshape(-1).astype(np.int16)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in [0, at), for all places asked."""
        word = np.minimum(at >> 6, len(self.words) - 1)
        left = (at - (word << 6)).astype(np.uint64)
        # a shift by 64 is not defined, and no place asked is beyond the padding
        mask = (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1)
        mask = np.where(left >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), mask)
        return self.directory[word // (_BLOCK // 64)] + self.inside[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Levels of bits from the highest down; at each one, symbols with a zero go before those with a one."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.length, self.levels = len(symbols), levels
        self.bits: list[_Bits] = []
        self.zeros: list[int] = []
        held = symbols.astype(np.uint8)
        for level in range(levels - 1, -1, -1):
            ones = (held >> level) & 1
            self.bits.append(_Bits(ones))
            self.zeros.append(int(len(held) - np.count_nonzero(ones)))
            held = np.concatenate([held[ones == 0], held[ones == 1]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often symbol stands in [0, at), for all places asked."""
        first, last = np.zeros_like(at), at
        for depth, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            if (symbol >> (self.levels - 1 - depth)) & 1:
                first, last = zeros + bits.rank(first), zeros + bits.rank(last)
            else:
                first, last = first - bits.rank(first), last - bits.rank(last)
        return last - first

    def rank_below(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many symbols smaller than this one stand in [0, at), for all places asked."""
        first, last, found = np.zeros_like(at), at, np.zeros_like(at)
        for depth, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones_first, ones_last = bits.rank(first), bits.rank(last)
            if (symbol >> (self.levels - 1 - depth)) & 1:
                found = found + (last - ones_last) - (first - ones_first)
                first, last = zeros + ones_first, zeros + ones_last
            else:
                first, last = first - ones_first, last - ones_last
        return found
