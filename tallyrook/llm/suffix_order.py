"""Suffix order of a collection of byte strings by prefix-free parsing.

Rolling-hash triggers cut strings into phrases. A phrase begins with the WIDTH bytes of the trigger before it, so no phrase's
suffix longer than that is a proper prefix of another's. The suffix array of the dictionary, which holds each phrase once, and
that of the parse, a string of phrase ranks, give the order of all suffixes: first by the rest of their phrase, then
by the rank of the parse's suffix that follows. Work grows with dictionary and parse, not with the text.
"""

from __future__ import annotations

import numpy as np

from .words import U, _power, mix

WIDTH = 12
#: One position in MODULUS is a trigger.
MODULUS = 24
#: Two families of hashes: bases, and drawn values of the bytes.
_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_BYTES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1) for seed in (20240531, 20240601)]


class Hashes:
    """Polynomial hashes of any range of a byte array in constant time, of either family."""

    def __init__(self, data: np.ndarray, family: int = 0):
        n, base = len(data), _BASES[family]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[family][data] * _power(f"phrase up {family}", U(base), n)[:n], out=self.sums[1:])
        self.down = _power(f"phrase down {family}", U(pow(base, -1, 1 << 64)), n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs in order, and each one's place among them."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # a clash
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return a[fresh], b[fresh], which


def cuts(hashes: Hashes, offsets: np.ndarray) -> np.ndarray:
    """Positions behind a trigger; a trigger lies in one string. offsets: where strings begin, and the end."""
    n = int(offsets[-1])
    if n < WIDTH:
        return np.empty(0, np.int64)
    # hashes(starts, starts + WIDTH) of all positions, by slices
    every = mix((hashes.sums[WIDTH : n + 1] - hashes.sums[: n - WIDTH + 1]) * hashes.down[: n - WIDTH + 1] + U(WIDTH))
    at = np.flatnonzero(every < U((1 << 64) // MODULUS)) + WIDTH
    string = np.searchsorted(offsets, at - WIDTH, "right") - 1
    return at[at <= offsets[string + 1]]


def _doubled(ranks: np.ndarray, left: np.ndarray, depth: int, limit: int) -> np.ndarray:
    """Prefix doubling: ranks of the first `depth` symbols become ranks of `limit` or more; left[i] symbols follow i in its
    string, itself included, and the end of a string comes before all symbols."""
    n = len(ranks)
    while depth < limit:
        if not (left > depth).any():
            break
        following = np.zeros(n, np.int64)
        more = np.flatnonzero(left > depth)
        following[more] = ranks[more + depth] + 1
        distinct, ranks_new = np.unique(ranks * (n + 2) + following, return_inverse=True)
        done = len(distinct) == int(ranks.max()) + 1
        ranks = ranks_new
        depth *= 2
        if len(distinct) == n or (done and depth >= limit):
            break
    return ranks


def dictionary_ranks(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rank of every suffix of every dictionary phrase; equal suffixes have equal ranks."""
    n = len(text)
    lengths = np.diff(offsets)
    left = np.repeat(offsets[1:], lengths) - np.arange(n)
    padded = np.concatenate([text.astype(np.uint64) + U(1), np.zeros(8, np.uint64)])
    # seven symbols of nine bits
    first = np.zeros(n, np.uint64)
    for i in range(7):
        first = first * U(512) + np.where(left > i, padded[i : n + i], U(0))
    ranks = np.unique(first, return_inverse=True)[1]
    return _doubled(ranks, left, 7, int(lengths.max(initial=0)))


def repeated(text: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Of each position of each string, whether the `length` bytes from there also begin at another position of any string.

    Positions less than `length` before their string's end are false. Windows must hold a cut more than WIDTH behind their
    start; where that isn't so, as for long phrases, the window's own bytes decide, over the positions concerned.
    """
    n, out = len(text), np.zeros(len(text), bool)
    if not n:
        return out
    hashes = Hashes(text)
    at = cuts(hashes, offsets)
    bounds = np.unique(np.concatenate([at, offsets]))
    begin, end = bounds[:-1], bounds[1:]
    string = np.searchsorted(offsets, begin, "right") - 1
    # phrases reach back over the trigger before them
    begin = np.maximum(begin - WIDTH, offsets[string])
    distinct, sample, phrase = np.unique(hashes(begin, end), return_index=True, return_inverse=True)
    lengths = (end - begin)[sample]
    places = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.arange(places[-1]) - np.repeat(places[:-1], lengths)
    ranks = dictionary_ranks(text[np.repeat(begin[sample], lengths) + inside], places)
    # the parse: ranks of whole phrases
    symbols = np.unique(ranks[places[:-1]], return_inverse=True)[1][phrase]
    follows = np.searchsorted(string, string, "right") - np.arange(len(string))
    parse = _doubled(symbols, follows, 1, length)
    # each position's phrase: the one that it is in by more than WIDTH bytes before the end; the last of a string has no such end
    last = np.append(string[1:] != string[:-1], True)
    until = np.where(last, end, end - WIDTH)
    position = np.flatnonzero(np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n) >= length)
    own = np.searchsorted(until, position, "right")
    rest = ranks[places[phrase[own]] + position - begin[own]]
    after = np.where(last[own], 0, parse[np.minimum(own + 1, len(parse) - 1)] + 1)
    order = np.lexsort((after, rest))
    position, cut = position[order], (end[own] - 1 >= position + WIDTH)[order] & ~last[own][order] & (end[own] <= position + length)[order]
    same = np.concatenate([[False], _equal(text, position[1:], position[:-1], length)])
    out[position[same]] = True
    out[position[:-1][same[1:]]] = True
    rare = position[~cut]
    if len(rare):  # no cut inside: neighbours in the order may part equal windows
        odd = np.sort(rare)
        _, which, count = np.unique(hashes(odd, odd + length), return_inverse=True, return_counts=True)
        odd, which = odd[count[which] > 1], which[count[which] > 1]
        if len(odd):
            which = pairs(which, Hashes(text, 1)(odd, odd + length))[2]
            out[odd[np.bincount(which)[which] > 1]] = True
    return out


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(a), bool)
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    for at in range(0, len(a), 8192):
        out[at : at + 8192] = (windows[a[at : at + 8192]] == windows[b[at : at + 8192]]).all(axis=1)
    return out
