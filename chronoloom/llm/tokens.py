"""Vectorised word finding and hashing over Arrow text buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Odd base of the polynomial hash, modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and every byte of a non-ASCII character.
_WORD = np.zeros(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _WORD[list(_r)] = True
#: Texts are worked on in runs of about so many bytes.
SLICE = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters lower-cased, byte for byte in place of the UTF-8 text."""
    low = _LOWER[data]
    if len(data) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][up] += 32
    return low


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a slice of texts: byte ranges, hash and text of each; ``first[i]`` is the first word of text i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray
    low: np.ndarray


def find_words(data: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray = _WORD, low: np.ndarray | None = None) -> Words:
    """Maximal runs of word bytes in texts ``data[offs[i]:offs[i+1]]``; a word never spans two texts."""
    low = lowered(data) if low is None else low
    n = len(data)
    inside = word_bytes[low]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    h = mixed((sums[end] - sums[start]) * powers(INVERSE, n + 1)[start])
    first = np.searchsorted(start, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    return Words(start, end, h, row, first, low)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of one text's words, equal to those of ``find_words``."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return find_words(data, np.array([0, len(data)])).hash


def cut_at_gaps(data: np.ndarray, inside: np.ndarray, size: int):
    """Ranges of about ``size`` bytes that together are ``data``; none ends within a run of ``inside`` bytes."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data):
            gaps = np.flatnonzero(~inside[data[end : end + size]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(data), end + size)
        yield at, end
        at = end
