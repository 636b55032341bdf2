"""Alignment of two tokenizers over the same texts (operator 13).

Both token sequences of a text cover the same bytes, so the cumulative ends of their tokens are two sorted runs of byte offsets.
A two-pointer merge of the runs finds the offsets where both end: these cut the tokens into groups, and the two tokens that end there
are a link. The merge runs inside mapInPandas; where both tokenizers part a text before white space, it runs once for each different
word that a worker meets. Spark counts the id pairs of all links, takes the maximum of each id on either side, and joins both
back to the documents' pairs.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import Encoder
from .common import small_batches, stash, table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Words whose alignment a worker keeps, in each of two generations, and the longest such, in characters.
KEPT, KEPT_CHARS = 200_000, 48
#: Latin letters, and the signs that a word often ends with: the first tokenizer always parts a text between them.
LETTERS, ENDS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,;:!?"
#: Pairs up to which their counts, some 60 bytes each, are sent to all tasks; beyond, documents' pairs are shuffled to them.
SENT_PAIRS = 2_000_000
#: The library's sign for a space.
SPACE = "▁"


class ByteSide(Encoder):
    """Byte-level BPE without special tokens: their strings in a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.added = []
        back = {chr(shown): byte for byte, shown in self.letters.items()}
        names = {i: name for name, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.entries = [bytes(back[c] for c in names[i]) if all(c in back for c in names[i]) else names[i].encode() for i in range(max(names) + 1)]

    def ids(self, text: str) -> list[int]:
        """Of a text, or of a part that pre-tokens don't reach out of."""
        if not text.isascii() and self.special(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return [x.id for t in self.find(text) for x in self.model(t.encode().decode("latin-1").translate(self.letters))]


class PieceSide:
    """The sentencepiece library. It writes a space as SPACE, puts one before the text, and merges neighbours that spell an entry of
    its vocabulary. apart: no entry has SPACE behind another character, a line break beside one, or one of ENDS behind a Latin
    letter, so that no token reaches over these places."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.entries = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        joined = re.compile(rf"[^{SPACE}]{SPACE}|.\n|\n.|[{LETTERS}][{ENDS}]", re.DOTALL)
        self.apart = not any(joined.search(p) for p in pieces if not byte.fullmatch(p)) and self.library.encode("a  b") == self.library.encode("a") + self.library.encode(" b")
        self.alone = self.library.piece_to_id(SPACE)

    def ids(self, parts: list[str]) -> list[list[int]]:
        """The library's own space is the first of a part, or comes before a line break and is taken off with it."""
        found = self.library.encode([t[1:] if t[0] == " " else "\n" + t for t in parts], num_threads=1)
        return [[self.alone] if t == " " else i if t[0] == " " else i[2:] for t, i in zip(parts, found, strict=True)]


class Merged(NamedTuple):
    """The groups as text (ids of a side with commas, a bar between sides, a semicolon behind each group), the links as 64-bit numbers
    (the A id in the upper half), and the tokens of both sides as two 32-bit numbers, all in bytes."""

    groups: bytes
    links: bytes
    tokens: bytes


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in two rising sequences of what both hold. numpy's stable sort of two sorted runs, one after the other, is their
    merge with a pointer in each; what is in both comes twice in a row."""
    both = np.concatenate([ends_a, ends_b])
    both.sort(kind="stable")
    shared = both[1:][both[1:] == both[:-1]]
    return np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.length_a, self.length_b = (np.array([len(x) for x in side.entries], np.int64) for side in (self.a, self.b))
        # every id in decimal, followed by what comes after it: a further id of its side, or the end of its side of the group
        self.written = [f"{i}{sign}".encode() for side, signs in ((self.a, ",|"), (self.b, ",;")) for sign in signs for i in range(len(side.entries))]
        self.width = np.array([len(x) for x in self.written], np.int64)
        # a word: up to the next space or line break that stands behind something else than white space, or to a sign that ends it
        rest = r"[^\S \n]\s*\S*"
        self.words = re.compile(rf" ?[{LETTERS}]+(?=[{ENDS}])|[ \n]\s*\S*(?:{rest})*|\S+(?:{rest})*").findall
        self.new: dict[str, Merged | None] = {}
        self.old: dict[str, Merged | None] = {}

    def merged(self, a: list[list[int]], b: list[list[int]]) -> list[Merged]:
        """Of parts with the ids of both sides, which spell the same bytes: one merge for all parts, as one ends on both sides alike."""
        n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (a, b))
        last_a, last_b = merge(np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b]))
        links = (flat_a[last_a] << 32 | flat_b[last_b]).tobytes()
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        flat_b = flat_b + 2 * len(self.length_a)
        flat_a[last_a] += len(self.length_a)
        flat_b[last_b] += len(self.length_b)
        codes = np.empty(len(flat_a) + len(flat_b), np.int64)
        codes[np.arange(len(flat_a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)] = flat_a
        codes[np.arange(len(flat_b)) + np.repeat(np.cumsum(in_a), in_b)] = flat_b
        groups = b"".join(map(self.written.__getitem__, codes.tolist()))
        tokens = np.stack([n_a, n_b], axis=1).astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(self.width[codes])[np.cumsum(n_a + n_b) - 1]]).tolist()
        closed = np.concatenate([[0], 8 * np.searchsorted(last_a, np.cumsum(n_a))]).tolist()
        return [Merged(groups[ends[i] : ends[i + 1]], links[closed[i] : closed[i + 1]], tokens[8 * i : 8 * i + 8]) for i in range(len(a))]

    def made(self, parts: list[str]) -> list[Merged | None]:
        """None for a part that the tokens of a side don't spell."""
        a, b = [self.a.ids(t) for t in parts], self.b.ids(parts)
        spell = lambda side, ids: b"".join([side.entries[i] for i in ids])
        spelt = [i for i, t in enumerate(parts) if spell(self.a, a[i]) == t.encode() == spell(self.b, b[i])]
        out: list[Merged | None] = [None] * len(parts)
        if spelt:
            for i, m in zip(spelt, self.merged([a[i] for i in spelt], [b[i] for i in spelt]), strict=True):
                out[i] = m
        return out

    def __call__(self, texts: Iterable[str | None]) -> list[list[Merged] | None]:
        """Of each text its words in a row; None for texts that are null or empty, or that the tokens of a side don't spell."""
        parts: list[list[str]] = []
        for text in texts:
            spaced = " " + (text or "")
            whole = not self.b.apart or SPACE in spaced or (not spaced.isascii() and self.a.special(spaced))
            parts.append([] if not text else [spaced] if whole else self.words(spaced))
        missing = set().union(*parts).difference(self.new)
        if len(self.new) + len(missing) > KEPT:
            self.new, self.old = {}, self.new
            missing = set().union(*parts)
        new = [t for t in missing if t not in self.old]
        self.new.update((t, self.old[t]) for t in missing if t in self.old)
        self.new.update(zip(new, self.made(new), strict=True))
        get = self.new.__getitem__
        out = [None if not p or None in (found := list(map(get, p))) else found for p in parts]
        for t in new:
            if len(t) > KEPT_CHARS:
                del self.new[t]
        return out


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    small_batches(docs.sparkSession, rows=500, size=4 << 20)
    # pandas would make floating numbers of whole ones beside a null
    plain = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain, docs.select(id_col).schema[0].dataType.simpleString()


def groups(docs: DataFrame, path_a: str = BYTE_VOCABULARY, path_b: str = PIECE_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place, start, end, a_ids, b_ids: the groups of each text in order, with the bytes of space and text they cover. Texts
    without tokens, as in align(), have no rows."""
    plain, kind = _plain(docs, id_col, text_col)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(path_a, path_b)
        for frame in frames:
            for doc_id, got in zip(frame["doc_id"], aligner(frame["text"]), strict=True):
                if got is not None:
                    sides = [group.split("|") for group in b"".join([m.groups for m in got]).decode()[:-1].split(";")]
                    a, b = ([np.array(side.split(","), np.int32) for side in both] for both in zip(*sides, strict=True))
                    ends = np.cumsum([sum(aligner.length_a[i] for i in ids) for ids in a])
                    yield pd.DataFrame({"doc_id": doc_id, "place": np.arange(len(ends)), "start": np.concatenate([[0], ends[:-1]]), "end": ends, "a_ids": a, "b_ids": b})

    out = plain.mapInPandas(work, "doc_id string, place long, start long, end long, a_ids array<int>, b_ids array<int>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def _merged(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Each row with the counts and the digest of its groups, and its linked id pairs, each with how often it holds it."""
    plain, kind = _plain(docs, id_col, text_col)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(path_a, path_b)
        nothing = (0, 0, 0, 0, "", np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32))
        for frame in frames:
            rows = []
            for got in aligner(frame["text"]):
                if got is None:
                    rows.append(nothing)
                    continue
                groups, links, tokens = (b"".join(part) for part in zip(*got, strict=True))
                n_a, n_b = np.frombuffer(tokens, "<u4").reshape(-1, 2).sum(axis=0, dtype=np.int64).tolist()
                keys, times = np.unique(np.frombuffer(links, "<i8"), return_counts=True)
                pair = ((keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32))
                rows.append((n_a, n_b, len(links) // 8, len(links) // 8, hashlib.sha256(memoryview(groups)[:-1]).hexdigest(), *pair))
            out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a_id", "b_id", "times"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    counts = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    out = plain.mapInPandas(work, f"doc_id string, {counts}, a_id array<int>, b_id array<int>, times array<int>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def pair_counts(merged: DataFrame) -> DataFrame:
    """a_id, b_id, links, best_a, best_b: how many links hold each id pair, and the highest such number of its id on either side."""
    each = merged.select(F.inline(F.arrays_zip("a_id", "b_id", "times")))
    pairs = stash(each.groupBy("a_id", "b_id").agg(F.sum("times").alias("links")), "token-pairs")
    for side in ("a", "b"):
        # an id has at most as many pairs as the other vocabulary has entries
        pairs = pairs.join(pairs.groupBy(f"{side}_id").agg(F.max("links").alias(f"best_{side}")), f"{side}_id")
    return pairs.select("a_id", "b_id", "links", "best_a", "best_b")


def align(docs: DataFrame, path_a: str = BYTE_VOCABULARY, path_b: str = PIECE_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a: one row for each row of docs.

    Side a encodes a space and the text, side b the text, before which it puts the space itself. Texts that are null or empty, or
    whose tokens on a side don't spell the space and the text, have no tokens: zeros and an empty string. Each row of a repeated
    id or text counts and is returned. Ties among pair counts are all best. n_best_a counts like n_best, on the side of the A ids.
    An empty table gives no rows; other columns are ignored. A worker holds one batch of texts and one text's tokens.
    """
    merged = stash(_merged(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "token-links")
    pairs = stash(pair_counts(merged), "token-pair-counts")
    key = F.col("a_id").cast("long") * F.lit(1 << 32) + F.col("b_id")
    known = pairs.select(key.alias("key"), "links", (F.col("links") == F.col("best_b")).alias("top_b"), (F.col("links") == F.col("best_a")).alias("top_a"))
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    each = merged.select(*own, F.inline_outer(F.arrays_zip("a_id", "b_id", "times"))).select(*own, key.alias("key"), "times")
    joined = each.join(F.broadcast(known) if known.count() <= SENT_PAIRS else known, "key", "left")
    number = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return (
        joined.groupBy(*own)
        .agg(
            number(F.when(F.col("top_b"), F.col("times"))).alias("n_best"), number(F.col("links") * F.col("times")).alias("count_sum"),
            number(F.when(F.col("top_a"), F.col("times"))).alias("n_best_a"),
        )
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a")
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {}
