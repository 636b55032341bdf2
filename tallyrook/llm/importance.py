"""Resampling towards a target distribution (operator 12): importance weights from hashed word features, in two Arrow passes.

Features are the runs of one and two consecutive words; a feature's bucket is the CRC-32 of its bytes modulo BUCKETS. The first pass
counts the buckets of a partition with np.bincount, a vector of BUCKETS whole numbers however much the partition holds, and treeReduce
merges the vectors. The gains of all buckets, 80 kB, are broadcast; the second pass gathers each feature's gain and sums a
document's with np.bincount's weights. Gumbel noise drawn from the document's id turns the highest scores into a sample.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stash, table

BUCKETS = 10_000
SEED, SHARE, LEAST_WORDS = 7, 25, 20
#: Bytes worked on together; a longer text is cut between words.
SLICE = 1 << 20
#: Bytes of a word that are hashed for all words together; what a word has beyond goes to zlib.
WIDE = 24
#: Vectors that one task of the tree adds up, and rows of a task that numbers the ranks.
FAN_IN, RANKS_A_TASK = 64, 50_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ALL = np.uint32(0xFFFFFFFF)
#: The register after one byte, for each value of its low eight bits; zlib.crc32 starts and ends with all bits turned.
_STEP = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)


def _feed(registers: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers after data[start:start + length] of each; lengths have to fall from one to the next."""
    out = registers.copy()
    reach = len(lengths) - np.cumsum(np.bincount(np.minimum(lengths, WIDE), minlength=WIDE + 1))
    for k in range(min(WIDE, int(lengths[0]) if len(lengths) else 0)):
        n = int(reach[k])  # so many are longer than k
        now = out[:n]
        out[:n] = _STEP[(now ^ data[starts[:n] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    for i in range(int(np.searchsorted(-lengths, -WIDE, "left"))):
        rest = data[starts[i] + WIDE : starts[i] + lengths[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i] ^ _ALL)) ^ 0xFFFFFFFF
    return out


def features(data: np.ndarray, offsets: np.ndarray, known: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts data[offsets[i]:offsets[i + 1]], lower-cased: all features' checksums, the text of each, and the words of
    each text. known: the first word of the first text was counted before, and only what follows it is new."""
    inside = _INSIDE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | cut[1 : len(data)]])) if len(data) else np.empty(0, np.int64)
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | cut[1 : len(data)], [True]])) + 1 if len(data) else starts
    text = np.searchsorted(offsets, starts, "right") - 1
    lengths = ends - starts
    # numpy's stable sort of small integers is a radix sort
    order = np.argsort(-np.minimum(lengths, WIDE + 1).astype(np.int16), kind="stable")
    long = int(np.count_nonzero(lengths > WIDE))
    order[:long] = order[:long][np.argsort(-lengths[order[:long]], kind="stable")]
    words = np.empty(len(starts), np.uint32)
    words[order] = _feed(np.full(len(starts), _ALL), data, starts[order], lengths[order])
    second = order[(order > 0) & (text[order] == text[order - 1])]
    before = words[second - 1]
    spaced = _STEP[(before ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (before >> np.uint32(8))
    pairs = _feed(spaced, data, starts[second], lengths[second])
    skip = int(known and len(starts) > 0)
    counts = np.bincount(text[skip:], minlength=len(offsets) - 1)
    return np.concatenate([words[skip:], pairs]) ^ _ALL, np.concatenate([text[skip:], text[second]]), counts


def _after_word(data: np.ndarray, at: int) -> int:
    """The next place from at on that is not inside a word."""
    while at < len(data):
        found = np.flatnonzero(~_INSIDE[data[at : at + SLICE]])
        if len(found):
            return at + int(found[0])
        at += SLICE
    return len(data)


def _last_word(data: np.ndarray) -> np.ndarray:
    inside = np.flatnonzero(_INSIDE[data])
    if not len(inside):
        return data[:0]
    outside = np.flatnonzero(~_INSIDE[data[: inside[-1]]])
    return data[int(outside[-1]) + 1 if len(outside) else 0 : inside[-1] + 1]


def sliced(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, features' buckets, the text of each counted from it, words of each text) of about SLICE bytes
    at a time. Null is empty. A longer text comes in parts, each of which begins with the last word of the one before."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, places, content = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1))
        own = _LOWER[data[offsets[at] : offsets[to]]]
        if len(own) <= SLICE or to > at + 1:
            sums, text, words = features(own, offsets[at : to + 1] - offsets[at])
            yield at, sums % BUCKETS, text, words
        else:
            here, carried = 0, own[:0]
            while here < len(own):
                end = _after_word(own, min(len(own), here + SLICE))
                part = np.concatenate([carried, [np.uint8(0x20)], own[here:end]]) if len(carried) else own[here:end]
                sums, text, words = features(part, np.array([0, len(part)]), known=len(carried) > 0)
                yield at, sums % BUCKETS, text, words
                here, carried = end, _last_word(part)
        at = to


def counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket. Every partition gives one vector of BUCKETS; a tree of tasks adds them, FAN_IN at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, bucket, _, _ in sliced(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "counts binary").rdd
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(BUCKETS, np.int64)
    depth = max(2, math.ceil(math.log(parts, FAN_IN)))
    return vectors.map(lambda row: np.frombuffer(row[0], np.int64)).treeReduce(np.add, depth)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, with one added to every count, rounded down."""
    more_s, more_t = float(int(source.sum()) + BUCKETS), float(int(target.sum()) + BUCKETS)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * more_s / ((s + 1.0) * more_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64
    )


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight: the mean gain of a document's features, rounded down; 0 without features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.astype(np.float64)
        for batch in batches:
            n = batch.num_rows
            sums, found, words = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for at, bucket, text, lengths in sliced(batch.column(1)):
                k = len(lengths)
                # whole numbers below 2^53: the sums are exact
                sums[at : at + k] += np.bincount(text, weights=own[bucket], minlength=k)
                found[at : at + k] += np.bincount(text, minlength=k)
                words[at : at + k] += lengths
            mean = sums.astype(np.int64) // np.maximum(found, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(found), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def draw(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: of the N rows of at least least_words words, the floor(share * N / 100) highest scores
    are numbered from 1, ties by doc_id; others have no rank.

    Rows are sorted by ranges and numbered from the counts of the ranges before, so no task holds more than a range. Rows of the
    same id and score are told apart by where they lie, so one id with very many rows is spread over ranges too.
    """
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((drawn + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = rows.withColumn("score", F.col("weight") + noise).withColumn("late", F.col("n_words") < least_words).withColumn("row", F.monotonically_increasing_id())
    scored = stash(scored, "importance-scores")
    total, early = scored.agg(F.count("*"), F.count_if(~F.col("late"))).first()
    keys = [F.col("late"), F.col("score").desc(), F.col("doc_id"), F.col("row")]
    ranged = scored.repartitionByRange(1 + total // RANKS_A_TASK, *keys).sortWithinPartitions(*keys)
    placed = stash(ranged.withColumn("place", F.monotonically_increasing_id()).drop("row"), "importance-ranks")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("part", part).withColumn("inside", inside)
    # one row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("inside") + 1
    return placed.join(starts, "part").select(
        "doc_id", "n_features", "weight", "score", F.when(~F.col("late") & (rank <= share * early // 100), rank).cast("long").alias("rank")
    )


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row for each row of docs, drawn towards the texts of target.

    Words are runs of letters, digits and characters beyond ASCII, A to Z lower-cased. Null and empty texts, and those
    without words, have no features and weight 0; they are never drawn. An empty target leaves only the smoothing. A null id
    draws its noise from an empty string and comes first among ties. Repeated rows count, and are drawn, each by itself; rows
    of one id share their noise. An empty table gives no rows; other columns are ignored. Texts of any length are read whole.
    """
    small_batches(docs.sparkSession)
    gain = gains(counts(docs, text_col), counts(target, target_col))
    return draw(weighted(docs, gain, id_col, text_col))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_importance_resampling": op12_importance_resampling}
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES = {
    "op12_importance_resampling": f"""WITH step AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
runs AS (SELECT r, doc_id, len(w) AS n, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
df AS (SELECT r, unnest(f) AS f FROM runs),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
kinds AS (SELECT f, sum(a) AS s, sum(z) AS t FROM (SELECT f, count(*) AS a, 0 AS z FROM df GROUP BY f UNION ALL SELECT f, 0, count(*) FROM bf GROUP BY f) GROUP BY f),
bytes AS (SELECT f, s, t, hex(encode(f)) AS h FROM kinds),
sums AS (SELECT f, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(steps[xor(c, x) % 256 + 1], c // 256)), 4294967295) % 10000 AS bucket FROM bytes, step),
counted AS (SELECT range AS bucket, coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM range(10000) LEFT JOIN sums ON bucket = range GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g FROM counted),
each AS (SELECT f, g FROM sums JOIN gain USING (bucket)),
added AS (SELECT r, floor(sum(g) / count(*))::BIGINT AS weight FROM df JOIN each USING (f) GROUP BY r),
scored AS (SELECT r, doc_id, n, len(f)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM runs LEFT JOIN added USING (r)),
told AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id, r) AS k, count(*) FILTER (n >= 20) OVER () AS eligible FROM told)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND k <= 25 * eligible // 100 THEN k END AS rank FROM ranked"""
}
