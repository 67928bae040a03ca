"""Word spans and word hashes of Arrow string columns, vectorised over the raw UTF-8 bytes.

A worker never materialises a text as Python words: it looks at the byte buffer
of the Arrow column in segments of ``SEGMENT`` bytes (cut at separators), so the
temporary arrays stay small however long one text is.  What is kept per word is
a start, an end and a 64-bit hash.  Null texts count as empty.

Hashes are 64-bit (a keyed polynomial over the bytes, then a mixer).  Two
different words or word sequences get the same hash with odds of about 2**-64
per pair; operators that promise exact results state this.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
GROUP_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)
#: keys of the places in a word sequence
PLACE_KEY = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: True where a byte separates words
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: separators of words of digits, letters a-z and everything beyond ASCII
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: bytes that begin a code point
LEAD = (np.arange(256) & 0xC0) != 0x80


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S33)) * _MIX1
    h = (h ^ (h >> _S29)) * _MIX2
    return h ^ (h >> _S33)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is ``bytes[offsets[i]:offsets[i + 1]]``; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def doc_groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of ``GROUP_BYTES`` together (one text may be longer)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + GROUP_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of some neighbouring texts, in order."""

    hash: np.ndarray    #: uint64
    start: np.ndarray   #: byte places in the buffer
    end: np.ndarray
    first: np.ndarray   #: text i has words first[i]:first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _segments(data: np.ndarray, lo: int, hi: int, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    while lo < hi:
        end = min(lo + SEGMENT, hi)
        if end < hi:
            cuts = np.flatnonzero(sep[data[lo:end]])
            if len(cuts):
                end = lo + int(cuts[-1]) + 1
            while not len(cuts) and end < hi:   # one word longer than a segment
                more = min(end + SEGMENT, hi)
                cuts = np.flatnonzero(sep[data[end:more]])
                end = end + int(cuts[0]) + 1 if len(cuts) else more
        yield lo, end
        lo = end


def words_of(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lower: bool) -> Words:
    """Words (longest runs of bytes that are no separators) of the texts at ``offsets``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if lower:
        sep = sep[LOWER]    # as the bytes stand: a capital separates only if its small letter does
    hashes, starts, ends = [], [], []
    for a, b in _segments(data, lo, hi, sep):
        seg = data[a:b]
        inside = ~sep[seg]
        if lower:
            seg = LOWER[seg]
        edges = offsets[np.searchsorted(offsets, a, "right"):np.searchsorted(offsets, b, "left")] - a
        left = np.empty_like(inside)
        left[0], left[1:] = False, inside[:-1]
        left[edges] = False
        right = np.empty_like(inside)
        right[-1], right[:-1] = False, inside[1:]
        right[edges - 1] = False
        start = np.flatnonzero(inside & ~left)
        end = np.flatnonzero(inside & ~right) + 1
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_BYTE_KEY[seg] * _power(_BASE, len(seg))[:len(seg)], out=sums[1:])
        h = (sums[end] - sums[start]) * _power(_BASE_INV, len(seg) + 1)[start]
        hashes.append(mix(h + (end - start).astype(np.uint64) * _MIX2))
        starts.append(start + a)
        ends.append(end + a)
    if not hashes:
        hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends),
                 np.searchsorted(start, offsets, "left"))


def word_hash(word: str) -> np.uint64:
    """The hash that ``words_of`` gives this one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]), np.zeros(256, bool), False).hash[0]


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every k words in a row that stand in one text, by place of the first word."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words.hash[j:j + n] * PLACE_KEY[j]
    text = words.text_of()
    whole = text[:n] == text[k - 1:]
    return mix(h[whole]), text[:n][whole]


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Per text its distinct k-word shingles as sorted uint64; with 1 to k - 1 words, the
    whole sequence as one; without words, none."""
    h, text = windows(words, k)
    bounds = np.searchsorted(text, np.arange(len(words.first)))
    out = []
    for i, n in enumerate(words.counts):
        if n >= k:
            s = np.sort(h[bounds[i]:bounds[i + 1]])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            w = words.hash[words.first[i]:words.first[i + 1]]
            out.append(mix((w * PLACE_KEY[:n] + PLACE_KEY[62 - n]).sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def per_text_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]
