"""Edit distance of long texts: Myers' bit vectors, 64 places of a text at once, for many pairs of texts together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

U, ONE, TOP = np.uint64, np.uint64(1), np.uint64(63)
#: Bytes of one set of pairs' tables of characters. Pairs whose shorter text has more blocks, and few pairs, are compared each by itself.
TABLE_BYTES, MOST_BLOCKS, FEW = 8 << 20, 16, 32


def _spread(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: the text, the place in it and the code of every character."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return text, place, codes[np.repeat(starts, lengths) + place]


def _block(codes: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], blocks: int, letters: int) -> np.ndarray:
    """Distances of pairs (starts and lengths of texts) whose shorter text, b, isn't empty and has so many blocks of 64 places; a is in
    order of length, longest first."""
    n, lengths, m = len(a[0]), a[1], b[1]
    text, place, code = _spread(codes, *b)
    # every place is a bit of its own, so that sums are unions
    equal = np.zeros(blocks * n * letters, U)
    np.add.at(equal, (place // 64 * n + text) * letters + code, ONE << (place % 64).astype(U))
    equal = equal.reshape(blocks, n * letters)
    text, place, code = _spread(codes, *a)
    columns = np.zeros((lengths[0], n), np.int64)
    columns[place, text] = text * letters + code
    plus, minus = np.full((blocks, n), ~U(0), U), np.zeros((blocks, n), U)
    last, far = ((m - 1) % 64).astype(U), m.astype(np.int64)
    alive = n - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    for column, k in zip(columns, alive.tolist(), strict=True):
        # what comes into a block from above: along the first row distances rise by one
        up, down = np.full(k, ONE), np.zeros(k, U)
        for block in range(blocks):
            p, q, eq = plus[block, :k], minus[block, :k], equal[block].take(column[:k])
            vertical = eq | q
            eq |= down
            across = (((eq & p) + p) ^ p) | eq
            rise, fall = q | ~(across | p), p & across
            if block == blocks - 1:
                far[:k] += ((rise >> last[:k]) & ONE).astype(np.int64) - ((fall >> last[:k]) & ONE).astype(np.int64)
            above, below = rise >> TOP, fall >> TOP
            rise, fall = (rise << ONE) | up, (fall << ONE) | down
            plus[block, :k], minus[block, :k] = fall | ~(vertical | rise), rise & vertical
            up, down = above, below
    return far


def _one(a: list[int], b: list[int]) -> int:
    """The same for one pair, with a whole text as one number."""
    whole, top, equal = (1 << len(b)) - 1, len(b) - 1, {}
    for place, code in enumerate(b):
        equal[code] = equal.get(code, 0) | 1 << place
    plus, minus, far = whole, 0, len(b)
    for code in a:
        eq = equal.get(code, 0)
        vertical, across = eq | minus, (((eq & plus) + plus) ^ plus) | eq
        rise, fall = (minus | ~(across | plus)) & whole, plus & across
        far += (rise >> top & 1) - (fall >> top & 1)
        rise, fall = (rise << 1 | 1) & whole, fall << 1 & whole
        plus, minus = (fall | ~(vertical | rise)) & whole, rise & vertical
    return far


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edits in code points between each two texts."""
    n = len(left)
    out = np.zeros(n, np.int64)
    points = np.frombuffer("".join((*left, *right)).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return out
    seen = np.zeros(int(points.max()) + 1, np.int64)
    seen[points] = 1
    letters = int(seen.sum())
    codes = (np.cumsum(seen) - 1)[points]
    lengths = np.fromiter(map(len, (*left, *right)), np.int64, 2 * n)
    starts = np.cumsum(lengths) - lengths
    swap = lengths[:n] < lengths[n:]
    a, b = np.where(swap, np.arange(n, 2 * n), np.arange(n)), np.where(swap, np.arange(n), np.arange(n, 2 * n))
    out[:] = lengths[a]  # against an empty text
    blocks = -(-lengths[b] // 64)
    for wide in np.unique(blocks[blocks > 0]).tolist():
        rows = np.flatnonzero(blocks == wide)
        if wide > MOST_BLOCKS or len(rows) < FEW:
            for i in rows.tolist():
                out[i] = _one(*(codes[starts[x[i]] : starts[x[i]] + lengths[x[i]]].tolist() for x in (a, b)))
            continue
        rows = rows[np.argsort(-lengths[a[rows]], kind="stable")]
        while len(rows):
            step = max(1, TABLE_BYTES // (8 * max(wide * letters, int(lengths[a[rows[0]]]) // 4)))
            some, rows = rows[:step], rows[step:]
            out[some] = _block(codes, *((starts[x[some]], lengths[x[some]]) for x in (a, b)), wide, letters)
    return out


@F.pandas_udf(LongType())
def _far(left: pd.Series, right: pd.Series) -> pd.Series:
    there = (left.notna() & right.notna()).to_numpy()
    out = pd.Series(pd.NA, index=left.index, dtype="Int64")
    out[there] = distances(left[there].tolist(), right[there].tolist())
    return out


def distance(left: Column, right: Column) -> Column:
    """As levenshtein(left, right), for texts of some hundred characters and more: the built-in one takes a step for each two characters."""
    return _far(left, right)
