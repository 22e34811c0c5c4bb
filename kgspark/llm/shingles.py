"""Word shingles as sorted 64-bit hashes, for many texts at once, and exactly for the pairs to verify."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes are hashed one by one.
LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words (A-Z lower-cased): hash, text, place in the text.

    A word's hash starts from its length and is mixed anew with each of its eight bytes, so it is no polynomial of them.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    n = end - begin
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    h = mixed(n.astype(np.uint64) * _GOLD)
    at = np.flatnonzero(n <= LONG)
    done = 0
    while len(at):
        left = n[at] - done
        part = eight[begin[at] + done]
        last = left < 8
        part[last] &= (_U(1) << (left[last].astype(np.uint64) * _U(8))) - _U(1)
        h[at] = mixed((h[at] ^ part) + _GOLD)
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes())
    doc = np.searchsorted(ends, begin, "right")
    many = np.bincount(doc, minlength=len(texts))
    return h, doc, np.arange(len(h)) - (np.cumsum(many) - many)[doc]


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: their hashes and texts, in the order of (text, hash).

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    w, doc, place = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    s = w.copy()
    for i in range(1, words):
        go = place + i < n[doc]
        s[go] = mixed(s[go] * _U(3) + w[np.flatnonzero(go) + i])
    ok = (place <= n[doc] - words) | (place == 0)
    s, doc = s[ok], doc[ok]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    fresh = np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])] if len(s) else np.zeros(0, bool)
    return s[fresh], doc[fresh]


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def shared(left: list[bytes], right: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes of the left and right texts and of their intersections, by the shingles themselves, without hashes."""
    rows = len(left)
    parts = [t.lower().split() for t in left + right]
    n = np.array([len(p) for p in parts], np.int64)
    w = np.fromiter(map(_Numbered().__getitem__, chain.from_iterable(parts)), np.uint64, int(n.sum()))
    doc, place = np.repeat(np.arange(2 * rows), n), np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    s = w.copy()
    base = w.max(initial=_U(0)) + _U(2)
    for i in range(1, words):  # number the sequences of i + 1 words; 0 stands for no word
        go = place + i < n[doc]
        follow = np.zeros(len(w), np.uint64)
        follow[go] = w[np.flatnonzero(go) + i] + _U(1)
        s = np.unique(s * base + follow, return_inverse=True)[1].astype(np.uint64)
    ok = (place <= n[doc] - words) | (place == 0)
    s, doc = s[ok], doc[ok]
    order = np.lexsort((doc, s, doc % max(rows, 1)))
    s, doc = s[order], doc[order]
    fresh = np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])] if len(s) else np.zeros(0, bool)
    s, doc = s[fresh], doc[fresh]
    size = np.bincount(doc, minlength=2 * rows)
    both = (s[1:] == s[:-1]) & (doc[1:] == doc[:-1] + rows)
    return size[:rows], size[rows:], np.bincount(doc[:-1][both], minlength=rows)
