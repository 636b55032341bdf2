"""Byte-level BPE encoding and decoding (operator 6) with a hierarchical-bitmap rank queue.

The pairs of a pre-token wait in buckets, one a merge rank, as positions of a linked list. A three-level bitmap says which
buckets hold something; find-first-set on three words gives the lowest rank, so the next merge costs the same however
long the pre-token is. Entries whose pair has changed meanwhile are skipped when they come up.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pre-tokens whose ids a worker keeps in each of two generations, and the longest such, in characters.
KEPT, KEPT_CHARS = 500_000, 64
#: White space as Unicode has it; without the separators 1C to 1F, which Python's \s includes.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def spelled(pattern: str, letters: str, digits: str) -> str:
    r"""The pattern with \s, \p{L} and \p{N} spelled out, inside classes and outside; \S only outside."""
    classes = {r"\s": SPACE, r"\p{L}": letters, r"\p{N}": digits}
    out, inside, i = [], False, 0
    while i < len(pattern):
        found = next((x for x in classes if pattern.startswith(x, i)), None)
        if found:
            out.append(classes[found] if inside else f"[{classes[found]}]")
            i += len(found)
        elif pattern.startswith(r"\S", i):
            if inside:
                raise ValueError(r"\S inside a class")
            out.append(f"[^{SPACE}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(spelled(pattern, r"\p{L}", r"\p{N}"))


#: The characters of plain text: ASCII, Latin, and the dashes and quotes of general punctuation.
PLAIN = r"\x00-\u024f\u2010-\u2027"


def plain_pattern(pattern: str) -> re.Pattern:
    """The same for plain text, for the faster standard library: its letters and digits one by one."""
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    of = lambda kind: "".join(regex.escape(c) for c in chars if regex.match(kind, c))
    return re.compile(spelled(pattern, of(r"\p{L}"), of(r"\p{N}")))


class RankQueue:
    """Buckets of positions by rank, and which hold some: low has a bit a rank, mid a bit a word of low, top a bit a word of
    mid. A queue is empty between pre-tokens."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}


class ByteBPE:
    """Ranks of byte strings, and what encodes with them. The rank is the id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, kept: int = KEPT):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no id for single bytes {missing[:5]}")
        self.ranks = ranks
        self.find = compiled(pattern).findall
        self.find_plain = plain_pattern(pattern).findall
        self.other = re.compile(f"[^{PLAIN}]").search
        self.queue = RankQueue(max(ranks.values()))
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.byte_pairs = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.most = kept
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str = public_tokenizers.PATTERN, kept: int = KEPT) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}, pattern, kept)

    def merged(self, token: bytes) -> list[int]:
        """The ids of one pre-token. put() and take() of the queue are written out here; this is the hot path."""
        ranks, byte_pairs, queue = self.ranks, self.byte_pairs, self.queue
        if (whole := ranks.get(token)) is not None:
            return [whole]
        n, low, mid, top, buckets = len(token), queue.low, queue.mid, queue.top, queue.buckets
        pieces: list[bytes | None] = [token[i : i + 1] for i in range(n)]
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [byte_pairs[a << 8 | b] for a, b in zip(token, token[1:])]  # the rank of the pair that begins here, -1: none
        now.append(-1)
        fresh = [i for i in range(n) if now[i] >= 0]
        while True:
            for i in fresh:
                rank = now[i]
                if bucket := buckets.get(rank):
                    heappush(bucket, i)
                    continue
                buckets[rank] = [i]
                word = rank >> 6
                if not low[word]:
                    group = rank >> 12
                    mid[group] |= 1 << (word & 63)
                    top |= 1 << group
                low[word] |= 1 << (rank & 63)
            # the lowest rank with an entry that still holds
            i = -1
            while top and i < 0:
                group = (top & -top).bit_length() - 1
                bits = mid[group]
                word = group << 6 | (bits & -bits).bit_length() - 1
                bits = low[word]
                rank = word << 6 | (bits & -bits).bit_length() - 1
                bucket = buckets[rank]
                while bucket and i < 0:
                    if now[i := heappop(bucket)] != rank:
                        i = -1  # stale
                if not bucket:
                    low[word] = bits & (bits - 1)
                    if not low[word]:
                        mid[group] &= mid[group] - 1
                        if not mid[group]:
                            top &= top - 1
            if i < 0:
                break
            j = following[i]
            k = following[i] = following[j]
            piece = pieces[i] = pieces[i] + pieces[j]
            pieces[j] = None
            now[j] = now[i] = -1
            fresh = []
            h = before[i]
            if h >= 0:
                now[h] = rank = ranks.get(pieces[h] + piece, -1)
                if rank >= 0:
                    fresh.append(h)
            if k < n:
                before[k] = i
                now[i] = rank = ranks.get(piece + pieces[k], -1)
                if rank >= 0:
                    fresh.append(i)
        queue.top = top
        return [ranks[piece] for piece in pieces if piece is not None]

    def packed(self, token: str) -> bytes:
        """For a pre-token that isn't kept; after `most` new ones the older generation goes."""
        if (out := self.older.get(token)) is None:
            ids = self.merged(token.encode())
            out = pack(f"<{len(ids)}I", *ids)
        if len(token) <= KEPT_CHARS:
            if len(self.kept) >= self.most:
                self.kept, self.older = {}, self.kept
            self.kept[token] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        packed, find = self.packed, self.find if self.other(text) else self.find_plain
        return b"".join([self.kept.get(token) or packed(token) for token in find(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str, kept: int) -> ByteBPE:
    return ByteBPE.load(path, pattern, kept)


def _mapped(rows: DataFrame, source: str, targets: list[str], steps: Callable[[ByteBPE, str | bytes | None], tuple[bytes, ...]], vocabulary: str, pattern: str, kept: int = KEPT) -> DataFrame:
    """The rows with the source column replaced by binary columns made from it."""
    rest = [c for c in rows.columns if c != source]
    clash = set(rest) & set(targets)
    if clash:
        raise ValueError(f"there is a column {', '.join(clash)} already")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary, pattern, kept)
        for batch in batches:
            made = [steps(bpe, x.as_py()) for x in batch.column(source)]
            columns = [pa.array([x[i] for x in made], pa.binary()) for i in range(len(targets))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], names=[*rest, *targets])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *(f"`{c}` binary" for c in targets)])
    small_batches(rows.sparkSession)
    return rows.mapInArrow(work, schema)


def encode(rows: DataFrame, text_col: str = "text", ids_col: str = "ids", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The rows with the text column replaced by its ids, a binary of little-endian unsigned 32-bit integers.

    Null and empty texts have no ids (an empty binary, not null). Special tokens' strings are ordinary text. Each row is
    encoded for itself, so ties, repeated rows and skew need no care; an empty table gives an empty one. Memory: one
    Arrow batch, one text's linked list, and KEPT short pre-tokens a worker in each generation. A column that already has
    the name of ids_col is an error.
    """
    return _mapped(rows, text_col, [ids_col], lambda bpe, text: (bpe.encode(text or ""),), vocabulary, pattern)


def decode(rows: DataFrame, ids_col: str = "ids", bytes_col: str = "bytes", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The rows with the ids replaced by the bytes that they stand for; null ids give none. An unknown id is an error."""
    return _mapped(rows, ids_col, [bytes_col], lambda bpe, ids: (bpe.decode(ids or b""),), vocabulary, pattern)


def round_trip(rows: DataFrame, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "bytes", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, kept: int = KEPT) -> DataFrame:
    """encode() and decode() of its ids by the same worker: the text replaced by both columns. kept: pre-tokens that a worker keeps in each of
    two generations, about 200 bytes each."""

    def both(bpe: ByteBPE, text: str | None) -> tuple[bytes, bytes]:
        ids = bpe.encode(text or "")
        return ids, bpe.decode(ids)

    return _mapped(rows, text_col, [ids_col, bytes_col], both, vocabulary, pattern, kept)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def digests(rows: DataFrame, text_col: str = "text", **where) -> DataFrame:
    """The rows, text replaced by n_tokens, ids_sha256 and decoded_sha256 of a round trip."""
    made = round_trip(rows, text_col, "_ids", "_bytes", **where)
    made = made.withColumn("n_tokens", n_tokens(F.col("_ids"))).withColumn("ids_sha256", F.sha2("_ids", 256)).withColumn("decoded_sha256", F.sha2("_bytes", 256))
    return made.drop("_ids", "_bytes")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLES: dict[str, str] = {}
