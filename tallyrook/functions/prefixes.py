"""Where in texts terms of a large table may stand: a filter of bounded size, asked at all places of a text at once.

A term of n bytes is entered by prefixes: its first bytes, as many as the largest power of two up to n, and then what each smaller power,
taken or left out, makes of them, down to the whole term. A place is followed as long as the filter knows its prefixes. So no term is
missed, and what is found is nearly always one; whoever asks compares the bytes, as prefixes are told apart by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U, ONE, LOW = np.uint64, np.uint64(1), np.uint64(63)
#: Words of 64 bits that are packed together, as a power of two.
BLOCK = 13
#: Of bytes and their places: hashes of equal bytes are equal wherever they stand, as the place is divided out.
LETTERS, STEP = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=U), 6364136223846793005
BACK = pow(STEP, -1, 1 << 64)
SALTS, SPREAD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)), U(0xD6E8FEB86659FD93)
#: Where in a hash the places of a word's three bits lie; the word's number lies above them.
BITS = (U(36), U(30), U(24))

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The powers of base below n."""
    if len(_powers.get(base, ())) < n:
        made = np.full(n, base, U)
        made[:1] = 1
        _powers[base] = np.multiply.accumulate(made)
    return _powers[base][:n]


def _sums(data: np.ndarray) -> np.ndarray:
    """One more than there are bytes: the hash of bytes is the difference of two of them, by the place."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(LETTERS[data] * _power(STEP, len(data)), out=out[1:])
    return out


def _mixed(hashes: np.ndarray, n, rest) -> np.ndarray:
    """Of prefixes of n bytes, with the powers from rest on decided."""
    with np.errstate(over="ignore"):
        return (hashes ^ (U(n) * SALTS[0] + U(rest) * SALTS[1])) * SPREAD


def _prefixes(sums: np.ndarray, at: np.ndarray, n, rest) -> np.ndarray:
    back = _power(BACK, len(sums))
    return _mixed((sums[at + n] - sums[at]) * back[at], n, rest)


def _mask(hashes: np.ndarray) -> np.ndarray:
    out = ONE << ((hashes >> BITS[0]) & LOW)
    for b in BITS[1:]:
        out |= ONE << ((hashes >> b) & LOW)
    return out


def size(entries: int) -> int:
    """Words, as a power of two, so that an entry has sixteen bits at least."""
    return max(BLOCK, (entries // 4).bit_length())


def entries(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of terms, none of them empty, one behind the other: the number of a word and its bits for each prefix."""
    sums, starts, lengths = _sums(data), offsets[:-1], np.diff(offsets)
    top = np.left_shift(1, np.frexp(lengths.astype(float))[1].astype(np.int64) - 1)
    n, made = top.copy(), [_mixed((sums[starts + top] - sums[starts]) * _power(BACK, len(sums))[starts], top.astype(U), top.astype(U))]
    rest = int(top.max(initial=1)) // 2
    while rest:
        own = top > rest
        n[own] += lengths[own] & rest
        made.append(_mixed((sums[(starts + n)[own]] - sums[starts[own]]) * _power(BACK, len(sums))[starts[own]], n[own].astype(U), rest))
        rest //= 2
    hashes = np.concatenate(made)
    return (hashes >> U(64 - words)).astype(np.int64), _mask(hashes)


def _known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = _mask(hashes)
    return (table.take((hashes >> U(65 - len(table).bit_length())).view(np.int64)) & mask) == mask


def places(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, tops: list[int], longest: int, window: int) -> Iterator[tuple[int, list]]:
    """Of texts one behind the other, window after window: up to which text all is found, and what was found since the window before, as
    arrays of the text, the place in data and the bytes. tops: the powers of two that terms begin with; longest: bytes of the longest."""
    longest = min(longest, int(np.diff(offsets).max(initial=0)))
    window, shift = max(window, longest), U(65 - len(table).bit_length())
    for start in range(0, len(data), window):
        sums = _sums(data[start : start + window + longest])
        back, found = _power(BACK, len(sums)), []
        for top in tops:
            n = min(window, len(sums) - top)
            if n <= 0:
                continue
            hashes = _mixed((sums[top : top + n] - sums[:n]) * back[:n], top, top)
            # by one bit first: few places are left to ask for all
            at = np.flatnonzero((table.take((hashes >> shift).view(np.int64)) >> ((hashes >> BITS[0]) & LOW)) & ONE)
            at = at[_known(table, hashes[at])]
            text = np.searchsorted(offsets, at + start, side="right") - 1
            end = np.minimum(offsets[text + 1] - start, len(sums) - 1)
            here = at + top <= end
            todo = [(at[here], text[here], end[here], top, top)]
            while todo:
                at, text, end, n, rest = todo.pop()
                if rest == 1:
                    found.append((text, at + start, n))
                    continue
                rest //= 2
                for longer in (n, n + rest):
                    here = np.flatnonzero(at + longer <= end)
                    here = here[_known(table, _prefixes(sums, at[here], longer, rest))]
                    if len(here):
                        todo.append((at[here], text[here], end[here], longer, rest))
        yield int(np.searchsorted(offsets[1:], start + window, side="right")), found
