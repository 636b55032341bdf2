"""Words of texts as 64-bit hashes, vectorised over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import BLANKS

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed together.
SLICE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        with np.errstate(over="ignore"):
            ones = np.full(max(n, SLICE + SLICE // 4), base, np.uint64)
            ones[0] = 1
            got = np.multiply.accumulate(ones)
        if len(got) <= 2 * SLICE:
            _powers[name] = got
    return got


def hashed(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words and, for each text, where its words begin in them; data[offsets[i]:offsets[i + 1]] is a text."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = _BLANK[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    inside = ~blank
    starts = inside & np.concatenate([[True], blank[:-1] | cut[1:n]])
    ends = inside & np.concatenate([blank[1:] | cut[1:n], [True]])
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    values = _BYTE[_LOWER[data] if lower else data] * _power("up", _BASE, n)[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    words = (sums[last] - sums[first]) * _power("down", _BASE_INVERSE, n)[first]
    return mix(words + (last - first).astype(np.uint64)), np.searchsorted(first, offsets)


def texts_hashed(texts: pa.Array, lower: bool = False) -> Iterator[np.ndarray]:
    """The word hashes of each text; null is empty. Works through about SLICE bytes at a time."""
    _, places, content = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1))
        words, starts = hashed(data, offsets[at : to + 1], lower)
        for i in range(to - at):
            yield words[starts[i] : starts[i + 1]]
        at = to
