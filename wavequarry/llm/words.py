"""Words, word windows and their names, of many texts at once, in numpy.

A word is a run of bytes other than ASCII white space.  Within a block of
texts Arrow numbers the distinct words by comparing them, so equal numbers
are equal words.  Between blocks a word stands by a 64-bit hash, which only
ever proposes; whoever decides compares numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_SLICE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, offsets, data): the words one after another in ``data``, each with a space behind it."""
    starts, sizes, kept = [], [], []
    begin, n = 0, len(raw)
    while begin < n:
        end = min(n, begin + _SLICE)
        while end < n and not SPACE[raw[end]]:
            tail = np.flatnonzero(SPACE[raw[end : end + 4096]])
            end = end + int(tail[0]) if len(tail) else min(n, end + 4096)
        part = raw[begin:end]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~SPACE[part]
        step = np.diff(inside)
        first, past = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(first):
            starts.append(first + begin)
            sizes.append(past - first + 1)
            keep = inside[1:-1].astype(bool)
            keep[past[past < len(part)]] = True
            kept.append(part[keep])
            if past[-1] == len(part):
                kept.append(np.full(1, 32, np.uint8))
        begin = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    data = np.concatenate(kept)
    data[offsets[1:] - 1] = 32
    return np.concatenate(starts), offsets, data


def number_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, the distinct words by number), compared byte by byte."""
    array = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of a binary array: of up to 16 bytes by two loads, of longer ones by xxh3."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.zeros(16, np.uint8)])
    at, size = offsets[:-1] - offsets[0], np.diff(offsets)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    kept = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = eight[at] & kept[np.minimum(size, 8)]
    high = eight[np.minimum(at + 8, len(eight) - 1)] & kept[np.clip(size - 8, 0, 8)]
    out = mix64(mix64(low ^ np.uint64(0x2545F4914F6CDD1D)) + mix64(high + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + size.astype(np.uint64))
    for k in np.flatnonzero(size > 16).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[at[k] : at[k] + size[k]].tobytes())
    return out


def window_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hashes of all windows of ``size`` words by the words' hashes; fewer words give none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = mix64(np.array([seed], np.uint64))[0] | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= factor
        out += words[j : j + n]
    return mix64(out)


def rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b) of non-negative numbers, in their order; equal ranks are equal pairs."""
    if not len(a):
        return np.zeros(0, np.int64)
    low, place = int(b.max()).bit_length(), int(len(a) - 1).bit_length()
    high = int(a.max()).bit_length()
    if low + high > 64:
        raise ValueError("ranks of over 32 bits")
    key = a.astype(np.uint64) << np.uint64(low) | b.astype(np.uint64)
    if low + high + place <= 64:  # the place rides along, as a plain sort is many times faster
        key = np.sort(key << np.uint64(place) | np.arange(len(a), dtype=np.uint64))
        at, key = (key & np.uint64((1 << place) - 1)).astype(np.int64), key >> np.uint64(place)
    else:
        at = np.argsort(key, kind="stable")
        key = key[at]
    rank = np.empty(len(a), np.int64)
    rank[at] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    return rank


def window_ranks(numbers: np.ndarray, size: int) -> np.ndarray:
    """The rank of each window of ``size`` words among all, by prefix doubling; equal ranks are equal words."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    rank, reach = numbers.astype(np.int64), 1
    while reach < size:
        step = min(reach, size - reach)
        rank = rank_pairs(rank[: len(rank) - step], rank[step:])
        reach += step
    return rank


class TextBlock:
    """The words of several texts: numbers, hashes, and the text of each."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        starts, self.offsets, self.data = split_words(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
        self.numbers, distinct = number_words(self.offsets, self.data)
        self.distinct = hash_words(distinct)
        self.text_of = np.searchsorted(np.cumsum(lengths), starts, side="right")
        self.first = np.searchsorted(self.text_of, np.arange(len(texts)))
        self.n_words = np.bincount(self.text_of, minlength=len(texts))

    @property
    def words(self) -> np.ndarray:
        """The hash of each word."""
        return self.distinct[self.numbers]

    def _whole(self, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(values):
            return np.zeros(0, np.int64), values
        ok = np.flatnonzero(self.text_of[: len(values)] == self.text_of[size - 1 :])
        return ok, values[ok]

    def windows(self, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of windows within one text."""
        return self._whole(window_hashes(self.words, size, seed), size)

    def _sets(self, size: int, values: tuple[np.ndarray, np.ndarray], short) -> list[np.ndarray]:
        at, values = values
        cut = np.searchsorted(self.text_of[at], np.arange(len(self.n_words) + 1))
        out = []
        for k, n in enumerate(self.n_words):
            if n >= size:
                out.append(np.unique(values[cut[k] : cut[k + 1]]))
            else:
                out.append(short(slice(self.first[k], self.first[k] + n)) if n else values[:0])
        return out

    def shingles(self, size: int) -> list[np.ndarray]:
        """Sorted distinct window hashes of each text.

        A text of fewer words than ``size`` has one of all its words, and one
        without words none.
        """
        words = self.words
        return self._sets(size, self._whole(window_hashes(words, size), size), lambda s: window_hashes(words[s], s.stop - s.start, seed=1000 + int(s.stop - s.start)))

    def exact_shingles(self, size: int) -> list[np.ndarray]:
        """As ``shingles``, but equal values are equal words, not equal hashes; values hold within this block."""
        ranks = window_ranks(self.numbers, size)
        after = int(ranks.max(initial=-1)) + 1
        seen: dict[bytes, int] = {}
        return self._sets(size, self._whole(ranks, size), lambda s: np.array([after + seen.setdefault(self.numbers[s].tobytes(), len(seen))]))
