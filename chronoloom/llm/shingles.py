"""Word shingles of whole texts as 64-bit hashes, worked out over Arrow buffers with whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import slices
from .tokens import cut_at_gaps, find_words, mixed

#: Lower-cases A-Z only.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are not ASCII white space.
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
#: Odd multipliers, one for each place of a word in its shingle.
_PLACES = [pow(0xA24BAED4963EE407, k + 1, 1 << 64) | 1 for k in range(64)]
#: Texts are worked on in runs of about so many bytes; a longer text is cut at white space.
SLICE = 1 << 20


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text with the end after the last); words are runs of non-white bytes, A-Z lowered."""
    if offs[-1] - offs[0] <= 2 * SLICE or len(offs) != 2:
        low = _LOWER[data]
        w = find_words(data, offs, _INK, low)
        return w.hash, w.first
    # One long text: pieces end at white space, so no word is cut and memory follows the piece.
    out = []
    for lo, hi in cut_at_gaps(data, _INK, SLICE):
        out.append(find_words(data[lo:hi], np.array([0, hi - lo]), _INK, _LOWER[data[lo:hi]]).hash)
    joined = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return joined, np.array([0, len(joined)])


def shingle_hashes(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes in text order, first shingle of every text, digest of every text's word sequence).

    A text of fewer than ``words`` words is one shingle, one without words has none. The digest
    sums all words with their places (64 bits), 0 for no word.
    """
    w, first = word_hashes(data, offs)
    count = np.diff(first)
    n = len(w)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    starts = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(len(count)), shingles)
    at = first[:-1][row] + (np.arange(starts[-1]) - starts[:-1][row])
    padded = np.concatenate([w, np.zeros(words, np.uint64)])
    short = np.minimum(count, words)[row]
    total = np.zeros(len(at), np.uint64)
    for k in range(words):
        total += np.where(k < short, padded[at + k] * np.uint64(_PLACES[k]), np.uint64(0))
    place = np.arange(n) - np.repeat(first[:-1], count)
    tagged = mixed(w + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_PLACES[7]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tagged, dtype=np.uint64)])
    digest = mixed(sums[first[1:]] - sums[first[:-1]] + count.astype(np.uint64) * np.uint64(_PLACES[9]))
    return mixed(total), starts, np.where(count > 0, digest, np.uint64(0))


def each_slice(data: np.ndarray, offs: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, shingles, starts, digests) for runs of texts of about SLICE bytes."""
    for i, j in slices(offs, SLICE):
        yield i, *shingle_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)


def distinct_in_rows(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(starts) - 1))])


def bit_sums(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of each row's values have each of the 64 bits set: (rows, 64), bit 0 first."""
    rows = len(starts) - 1
    out = np.zeros((rows, 64), np.int64)
    n = np.diff(starts)
    if not len(h):
        return out
    # Eight one-byte counters in each word: runs of at most 255 values cannot overflow.
    runs = -(-n // 255)
    owner = np.repeat(np.arange(rows), runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = starts[:-1][owner] + 255 * nth
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), begin)
        per = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        for lane in range(8):
            out[:, 8 * lane + k] = np.bincount(owner, per[:, lane], rows)
    return out


def simhashes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of each row's values: a bit is set if set in over half of them; 0 for an empty row."""
    ones = 2 * bit_sums(h, starts) > np.diff(starts)[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)
