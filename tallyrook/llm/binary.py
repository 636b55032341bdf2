"""Token-ID output (operator 7): independent zstandard frames, a checksum in each, and a seek table at the end.

A file holds, in this order:
- data frames. A frame decompresses to: number of documents (uint32), their doc_id (int64 each), their number of ids
  (uint32 each), all ids (uint32), little-endian. Each has the content checksum of the zstandard format. A skippable frame of
  four bytes follows every data frame; it counts as part of it in the seek table.
- an index, in a skippable frame: for each data frame first and last doc_id (int64), documents and ids (uint32, uint64).
- the seek table of the zstandard seekable format: a skippable frame with compressed size, decompressed size and the low
  32 bits of the XXH64 of the content (uint32 each) for each data frame, then the number of frames, a descriptor byte and the
  format's magic number.

Any zstandard reader decompresses the whole file; open_file() reads the table and then only the frames that hold the
documents asked for. Files are written by Spark's own writer with its commit protocol, so lost or repeated tasks leave
no half files, and to any file system that Spark can write. That writer ends each record with a separator; it is set to
the four bytes of the seek table's magic number, which thus close the file and fill the small skippable frames before.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import plain_pattern
from .common import shared_path, small_batches, stash, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
FRAME_IDS = 64 << 10
#: Bytes of text for one file.
FILE_BYTES = 32 << 20
LEVEL = 3

# Fixed values of the zstandard seekable format.
SEEKABLE_MAGIC = 0x8F92EAB1
SKIPPABLE_MAGIC = 0x184D2A50
SEEK_TABLE_MAGIC = 0x184D2A5E
HAS_CHECKSUMS = 0x80

SEPARATOR = struct.pack("<I", SEEKABLE_MAGIC)
INDEX_ROW = struct.Struct("<qqIQ")
SEEK_ROW = struct.Struct("<III")
#: Strings whose ids a worker keeps in each of two generations, and the longest such, in characters.
KEPT, KEPT_CHARS = 450_000, 64


def pack_frame(ids: list[tuple[int, bytes]]) -> bytes:
    """Documents with their ids, little-endian unsigned 32-bit integers."""
    parts = [struct.pack("<I", len(ids)), np.array([i for i, _ in ids], "<i8").tobytes(), np.array([len(x) // 4 for _, x in ids], "<u4").tobytes()]
    return b"".join([*parts, *(x for _, x in ids)])


def unpack_frame(content: bytes) -> list[tuple[int, np.ndarray]]:
    n = struct.unpack_from("<I", content)[0]
    names = np.frombuffer(content, "<i8", n, 4).tolist()
    sizes = np.frombuffer(content, "<u4", n, 4 + 8 * n)
    ends = np.cumsum(sizes, dtype=np.int64)
    flat = np.frombuffer(content, "<u4", int(ends[-1]) if n else 0, 4 + 12 * n)
    return list(zip(names, np.split(flat, ends[:-1]) if n else [], strict=True))


def records(docs: Iterator[tuple[int, bytes]], frame_ids: int = FRAME_IDS, level: int = LEVEL) -> Iterator[bytes]:
    """The records of one file; the separator after each is the writer's. A document lies in one frame."""
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    index, seek, frame, held = [], [], [], 0

    def closed() -> bytes:
        content = pack_frame(frame)
        out = packer.compress(content) + struct.pack("<II", SKIPPABLE_MAGIC, len(SEPARATOR))
        seek.append(SEEK_ROW.pack(len(out) + len(SEPARATOR), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        index.append(INDEX_ROW.pack(frame[0][0], frame[-1][0], len(frame), held))
        return out

    for doc_id, ids in docs:
        n = len(ids) // 4
        if frame and held + n > frame_ids:
            yield closed()
            frame, held = [], 0
        frame.append((doc_id, ids))
        held += n
    if frame:
        yield closed()
    rows, body = b"".join(index), b"".join(seek)
    footer = struct.pack("<IB", len(seek), HAS_CHECKSUMS)
    yield (
        struct.pack("<II", SKIPPABLE_MAGIC, len(rows)) + rows
        + struct.pack("<II", SEEK_TABLE_MAGIC, len(body) + len(footer) + len(SEPARATOR)) + body + footer
    )


class TokenFile:
    """A file read through fetch(offset, length) -> bytes; it fetches the tables, then only the frames it needs."""

    def __init__(self, size: int, fetch: Callable[[int, int], bytes]):
        self.fetch = fetch
        n, descriptor, magic = struct.unpack("<IBI", fetch(size - 9, 9))
        if magic != SEEKABLE_MAGIC or descriptor != HAS_CHECKSUMS:
            raise ValueError("this is not a token file")
        table_at = size - 9 - n * SEEK_ROW.size
        self.frames = list(SEEK_ROW.iter_unpack(fetch(table_at, n * SEEK_ROW.size)))
        index_at = table_at - 8 - n * INDEX_ROW.size
        self.index = list(INDEX_ROW.iter_unpack(fetch(index_at, n * INDEX_ROW.size)))
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)]).tolist()
        self.unpacker = zstandard.ZstdDecompressor()
        self.decompressed = 0

    def frame(self, i: int) -> list[tuple[int, np.ndarray]]:
        packed, size, check = self.frames[i]
        content = self.unpacker.decompress(self.fetch(self.starts[i], packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        self.decompressed += 1
        return unpack_frame(content)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.frames)):
            yield from self.frame(i)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all documents of this name; only frames that may hold it are read."""
        found, i = [], bisect_left(self.index, doc_id, key=lambda row: row[1])
        while i < len(self.index) and self.index[i][0] <= doc_id:
            found += [ids for name, ids in self.frame(i) if name == doc_id]
            i += 1
        return found


def open_file(path: str) -> TokenFile:
    """A local file; files in other stores are read with StoreReader."""
    import os

    handle = open(path, "rb")  # noqa: SIM115

    def fetch(offset: int, length: int) -> bytes:
        handle.seek(offset)
        return handle.read(length)

    return TokenFile(os.path.getsize(path), fetch)


class Kept:
    """Ids of the strings met lately, in two generations; after KEPT new ones the older generation goes."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.new, self.old = make, {}, {}

    def __call__(self, key: str) -> bytes:
        """For a key that isn't in new."""
        if (out := self.old.get(key)) is None:
            out = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self.new) >= KEPT:
                self.new, self.old = {}, self.new
            self.new[key] = out
        return out


class Encoder:
    """The tokenizers library, its model asked once for each different pre-token of plain text.

    Byte-level BPE without a normaliser encodes pre-tokens independently, so a text's ids are those of its pre-tokens in a
    row. Texts with characters outside Latin and general punctuation, where two versions of Unicode's tables might part a
    text differently, and texts with an added token's string go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model.tokenize
        # the library's letters for bytes, in byte order: it shows printable bytes as themselves, the others from U+0100 on
        letters = sorted(map(ord, pre_tokenizers.ByteLevel.alphabet()))
        shown = [c for c in letters if c < 256]
        self.letters = {c: c for c in shown} | dict(zip((b for b in range(256) if b not in set(shown)), letters[len(shown) :], strict=True))
        self.find = plain_pattern(public_tokenizers.PATTERN).findall
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\u024f\u2010-\u2027]").search
        self.tokens = Kept(self.pre_token)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pre_token(self, token: str) -> bytes:
        ids = [x.id for x in self.model(token.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        make = self.tokens
        if (not text.isascii() and self.special(text)) or any(x in text for x in self.added):
            return self.whole(text)
        return b"".join([make.new.get(t) or make(t) for t in self.find(text)])


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Encode the texts, end_id after each, and write them in ascending doc_id order; returns the number of files.

    File part-00000 and so on follow each other in doc_id order. Null and empty texts are just end_id. Rows of one
    doc_id are ordered by a hash of the text; each keeps its place. A null doc_id is stored as the smallest int64. An empty
    table writes files without frames or none. Extra columns are ignored. Partitions are ranges of doc_id (and of text where
    one doc_id has very many rows), of about FILE_BYTES of text; a worker holds one frame.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    files = max(1, -(-total // FILE_BYTES), min(spark.sparkContext.defaultParallelism, total // (1 << 20)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        end = struct.pack("<I", end_id)

        def encoded() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    yield doc_id, encoder.encode(text or "") + end

        for record in records(encoded()):
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["value"])

    small_batches(spark)
    keys = ["doc_id", "part", "pid"]
    ranged = rows.withColumn("part", F.xxhash64("text")).withColumn("pid", F.spark_partition_id())
    ranged = ranged.repartitionByRange(int(files), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    lines = ranged.mapInArrow(work, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return int(files)


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_id, place (ids before it in its file), ids (binary of uint32): all documents of the files.

    file is the file's number, which gives the order of the files however many there are. A null doc_id reads as the smallest
    int64, as it is stored; several documents of one id come one after the other; files without frames give no rows. A
    worker holds one file, about FILE_BYTES of text, and one frame."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                whole = memoryview(content.as_buffer())
                source = TokenFile(len(whole), lambda at, n, whole=whole: bytes(whole[at : at + n]))
                place, file = 0, file_number(name)
                for i in range(len(source.frames)):
                    docs = source.frame(i)
                    places = place + np.concatenate([[0], np.cumsum([len(ids) for _, ids in docs], dtype=np.int64)])
                    place = int(places[-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file] * len(docs), pa.int64()), pa.array([d for d, _ in docs], pa.int64()),
                            pa.array(places[:-1], pa.int64()), pa.array([ids.tobytes() for _, ids in docs], pa.binary()),
                        ],
                        names=["file", "doc_id", "place", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(work, "file long, doc_id long, place long, ids binary")


def file_number(path: str) -> int:
    """Of part-00012-...: 12. Names aren't compared: part-100000 would come before part-99999."""
    return int(re.match(r"part-(\d+)", path.rpartition("/")[2])[1])


class StoreReader:
    """Ranged reads of one file in any store that Spark's file systems reach, through the driver."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.jvm, self.where = jvm, jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.size = self.system.getFileStatus(self.where).getLen()

    def __call__(self, offset: int, length: int) -> bytes:
        stream = self.system.open(self.where)
        try:
            stream.seek(offset)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of the documents asked for, in file order, from the files of a folder in any store; other frames aren't read.

    Each file's tables are read, then the frames that may hold an id: a look-up of a few ids. A null doc_id is asked for as
    the smallest int64; an id that several rows have gives several arrays, one that none has gives none; files without
    frames and empty folders hold nothing."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [str(x.getPath()) for x in listed if x.getPath().getName().startswith("part-") and x.getLen()]
    readers = [StoreReader(spark, name) for name in sorted(names, key=file_number)]
    files = [TokenFile(x.size, x) for x in readers]
    return {doc_id: [ids for f in files for ids in f.find(doc_id)] for doc_id in doc_ids}


def placed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files; start counts the ids of all documents before, in the
    order of the files' numbers and of places in a file. A null id is null again; folders without documents give no rows."""
    found = read(spark, path).select(
        "file", "doc_id", "place", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    docs = stash(found, "token-places")  # read once, used twice
    # one row a file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    null_id = F.when(F.col("doc_id") != -(2**63), F.col("doc_id"))
    return docs.join(starts, "file").select(null_id.alias("doc_id"), (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path)
    return placed(spark, path)


QUERIES = {"op7_token_files": op7_token_files}
ORACLES: dict[str, str] = {}
