"""Word shingles of a text as sorted 64-bit hashes, the rare ones among them, and parity sketches of sets."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp

import numpy as np
import xxhash

_BLANK = re.compile(r"[ \t-\r]")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters whose words are split at a time.
SLICE = 1 << 18
#: Buckets in which shingles are counted, a power of two.
BUCKETS = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix generator: every bit of the input moves about half of the output."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _slices(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > SLICE and (found := _BLANK.search(text, start + SLICE)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; A-Z in lower case, words end at ASCII white space.

    Fewer words are one shingle, no words none.
    """
    hashed = []
    for part in _slices(text):
        words = part.encode().lower().split()
        hashed.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    words = np.concatenate(hashed)
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    found = np.full(count, width, np.uint64)
    for i in range(width):
        found = mixed((found + _STEP) ^ words[i : i + count])
    return np.unique(found)


def set_id(found: np.ndarray) -> int:
    """A 64-bit name of the set, as a signed number."""
    total = mixed(found + _STEP).sum(dtype=np.uint64)
    return int(mixed(np.array([total, len(found)], np.uint64)).sum(dtype=np.uint64).astype(np.int64))


class Bands:
    """Sizes of the smaller set of a pair, cut into bands; per band the segments that a sketch is split into.

    Sets of a and b elements whose intersection is at least `percent` of their union differ in at most
    (a + b) * (100 - percent) / (100 + percent) elements, each of which flips bits of one segment. With more segments
    than that, one segment at least is the same in both sketches. A set may leave out a few empty segments, which say
    nothing; there are twice as many spare segments, so a common one always remains.
    """

    def __init__(self, percent: int) -> None:
        self.percent, self.low = percent, [1]

    def largest_difference(self, a: int, b: int) -> int:
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def band(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 3 // 2))
        return bisect_right(self.low, size) - 1

    def of(self, size: int) -> range:
        """The bands in which a set of this size may meet a partner."""
        return range(self.band(-(-size * self.percent // 100)), self.band(size) + 1)

    @lru_cache(maxsize=None)
    def segments(self, band: int) -> tuple[int, int]:
        """Number of segments, and of empty ones that a set may leave out; (0, 0) where only equal sets qualify."""
        top = self.low[band + 1] - 1
        differ = self.largest_difference(top, top * 100 // self.percent)
        if not differ:
            return 0, 0
        spare = 0 if differ < 3 else ceil((differ + 1) * exp(-self.low[band] / (differ + 1)))
        return differ + 1 + 2 * spare, spare


def segment_keys(found: np.ndarray, bands: Bands) -> np.ndarray:
    """One number per band and segment: the XOR of the codes of the shingles that fall into it.

    It is the hash of the segment's parity bits: a shingle in both sets cancels in the comparison, and segments that no
    differing shingle falls into are equal.
    """
    keys, codes = [], mixed(found ^ _STEP)
    for band in bands.of(len(found)):
        count, spare = bands.segments(band)
        if not count:
            continue
        # `found` is sorted, so each segment is a slice of it.
        place = ((found >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        starts = np.searchsorted(place, np.arange(count, dtype=np.uint64))
        ends = np.append(starts[1:], len(found))
        filled = ends > starts
        value = np.zeros(count, np.uint64)
        value[filled] = np.bitwise_xor.reduceat(codes, starts[filled])
        use = np.ones(count, bool)
        use[np.flatnonzero(~filled)[:spare]] = False
        name = mixed(np.arange(count, dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(32)))
        keys.append(mixed(value ^ name)[use])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def buckets(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(BUCKETS - 1)).astype(np.int64)


def rare_marks(found: np.ndarray, percent: int, often: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, by `often`, the counts of the buckets: similar sets have one of them in common.

    Of a set of n shingles a partner has at least n * percent / 100, rounded up. All sets order their shingles alike, by
    count and hash. In both sets at least that number less one of the common shingles follow the first common one, so it
    is among the others plus one that come first, whatever the counts are. None are needed where only equal sets qualify.
    """
    size = len(found)
    if 100 * size < percent * (size + 1):
        return found[:0]
    count = size + size * -percent // 100 + 1
    return found[np.lexsort((found, often[buckets(found)]))[:count]]


def sketch(found: np.ndarray, bands: Bands) -> np.ndarray:
    """Parity sketch: each shingle flips one of 2^k bits; about 16 bits per element that a partner may differ in."""
    bits = max(256, 1 << (16 * bands.largest_difference(len(found), len(found))).bit_length())
    words = np.zeros(bits // 64, np.uint64)
    at = found & np.uint64(bits - 1)
    np.bitwise_xor.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bits, for rows of sketches: halves are XORed."""
    while words.shape[-1] > size:
        words = words[..., : words.shape[-1] // 2] ^ words[..., words.shape[-1] // 2 :]
    return words


def brief(words: np.ndarray) -> np.ndarray:
    """The sketch folded to a quarter of its bits, or to 256: about 4 bits per element that a partner may differ in. That
    still tells unlike sets apart, and its distance never exceeds that of the whole sketch."""
    return fold(words, max(4, words.shape[-1] // 4))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; never more than the elements that differ between the sets."""
    size = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(fold(a, size) ^ fold(b, size)).sum(axis=-1, dtype=np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)
