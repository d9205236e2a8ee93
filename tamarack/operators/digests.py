"""Seeded orders of many pairs: the first four bytes of the MD5 digests of texts that share a beginning, for many texts at once.

They only sort out which pairs can come first; who needs the order itself takes the whole digests of these."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Fixed values of the algorithm: additive constants, rotations, the word that each step takes, and the start.
ADDED = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in 4 * row]
WORD = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of the longest text that one block of the algorithm holds; texts at once, whose arrays stay in a processor's cache; fewer than this are hashed one by one.
ONE_BLOCK, AT_ONCE, FEW = 55, 32768, 256


def _first_words(fixed: list[int], arrays: dict[int, np.ndarray], work: list[np.ndarray]) -> np.ndarray:
    """The digests' first words, of blocks whose 16 words are fixed plus, where there are some, those of arrays. Of the 64 steps, the 61st settles it."""
    a, b, c, d, x, y = work
    for v, start in zip((a, b, c, d), START, strict=True):
        v.fill(start)
    for k in range(61):
        if k < 16:
            np.bitwise_xor(c, d, out=x)
            np.bitwise_and(x, b, out=x)
            np.bitwise_xor(x, d, out=x)
        elif k < 32:
            np.bitwise_xor(b, c, out=x)
            np.bitwise_and(x, d, out=x)
            np.bitwise_xor(x, c, out=x)
        elif k < 48:
            np.bitwise_xor(b, c, out=x)
            np.bitwise_xor(x, d, out=x)
        else:
            np.invert(d, out=x)
            np.bitwise_or(x, b, out=x)
            np.bitwise_xor(x, c, out=x)
        np.add(x, a, out=x)
        if (own := arrays.get(WORD[k])) is not None:
            np.add(x, own, out=x)
        np.add(x, np.uint32((fixed[WORD[k]] + ADDED[k]) % 2**32), out=x)
        np.left_shift(x, np.uint32(TURNS[k]), out=y)
        np.right_shift(x, np.uint32(32 - TURNS[k]), out=x)
        np.bitwise_or(x, y, out=x)
        np.add(x, b, out=a)
        a, b, c, d = d, a, b, c
    return np.add(b, np.uint32(START[0]), out=y)


class Endings:
    """Texts to be hashed behind many beginnings."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts, self.sizes = texts, np.array([len(t) for t in texts], np.int64)
        self._words: dict[tuple[int, int], tuple] = {}

    def _shifted(self, shift: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the endings of `most` bytes at most: which, their sizes, and their words, each ending closed by 0x80, if they start `shift` bytes into a word."""
        if (shift, most) not in self._words:
            at = np.flatnonzero(self.sizes <= most)
            width = -(-(shift + int(self.sizes[at].max(initial=0)) + 1) // 4) * 4
            rows = np.frombuffer(b"".join((bytes(shift) + self.texts[k] + b"\x80").ljust(width, b"\0") for k in at), "<u4").reshape(len(at), width // 4)
            self._words[shift, most] = at, self.sizes[at].astype(np.uint32), np.ascontiguousarray(rows.T.astype(np.uint32))
        return self._words[shift, most]

    def heads(self, beginning: bytes) -> np.ndarray:
        """The first four bytes of the MD5 digest of beginning + text for each text, as numbers in the order of the digests."""
        out, n, most = np.empty(len(self.texts), np.uint32), len(beginning), max(-1, ONE_BLOCK - len(beginning))
        single = np.arange(len(self.texts)) if len(self.texts) < FEW else np.flatnonzero(self.sizes > most)
        for k in single:
            out[k] = int.from_bytes(hashlib.md5(beginning + self.texts[k]).digest()[:4], "big")
        if len(single) < len(self.texts):
            # the same arrays serve all beginnings that leave these endings in one block
            at, sizes, words = self._shifted(n % 4, min(most, max(int(self.sizes.max()), 0)))
            fixed = np.frombuffer(beginning.ljust(64, b"\0"), "<u4").tolist()
            fixed[14] = 8 * n
            for lo in range(0, len(at), AT_ONCE):
                part = slice(lo, lo + AT_ONCE)
                arrays = {n // 4 + k: w[part] for k, w in enumerate(words)} | {14: 8 * sizes[part]}
                out[at[part]] = _first_words(fixed, arrays, [np.empty(len(at[part]), np.uint32) for _ in range(6)]).byteswap()
        return out

    def first(self, beginning: bytes, most: int) -> np.ndarray:
        """Which texts can be among the `most` first by their digests behind beginning: these, and all that share the last one's four bytes."""
        heads = self.heads(beginning)
        return np.arange(len(heads)) if len(heads) <= most else np.flatnonzero(heads <= np.partition(heads, most - 1)[most - 1])
