"""Numbers in compressed binaries, and questions that chunks of documents ask of owners of hash ranges.

A chunk sends its sorted distinct hashes, with columns of its own, to the owner of each range; the owner answers with
columns in the order asked. So a hash crosses the network once for a chunk however often it occurs there, no hash is hot, and
tasks hold a chunk or a range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

BLOB = "chunk string, kind string, r int, data binary"
_KINDS = ["<u1", "<u4", "<u8", "<i8", "<f8"]


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays in one compressed binary; bytes of equal weight lie together. uint64 arrays, which are mostly sorted, go as differences."""
    head, body = [struct.pack("<B", len(arrays))], []
    for x in arrays:
        kind = _KINDS.index("<" + x.dtype.str[1:])
        rising = x.dtype == np.uint64
        if rising and len(x):
            x = np.concatenate([x[:1], np.diff(x)])
        head.append(struct.pack("<BI", kind, len(x)))
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")
    return zstandard.compress(b"".join(head + body), level)


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    n, at = data[0], 1 + 5 * data[0]
    out = []
    for i in range(n):
        kind, size = struct.unpack_from("<BI", data, 1 + 5 * i)
        width = int(_KINDS[kind][2])
        x = np.ascontiguousarray(np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T).reshape(-1).view(_KINDS[kind])
        out.append(np.cumsum(x, dtype=np.uint64) if kind == 2 else x)
        at += size * width
    return out


def pack_names(names: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Texts, nulls among them, as two arrays for pack()."""
    encoded = [b"" if x is None else x.encode() for x in names]
    sizes = np.array([-1 if x is None else len(e) for x, e in zip(names, encoded, strict=True)], np.int64)
    return sizes, np.frombuffer(b"".join(encoded), np.uint8)


def unpacked_names(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))]).astype(np.int32)
    plain = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.array(plain.to_pylist(), pa.string(), mask=sizes < 0) if (sizes < 0).any() else plain


def rows(chunks: list[str], kinds: list[str], ranges: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.string()), pa.array(kinds, pa.string()), pa.array(ranges, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "kind", "r", "data"])


def range_starts(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each range's hashes begin in the sorted array."""
    limits = np.array([(i << 64) // n for i in range(n)], np.uint64)
    return np.append(np.searchsorted(hashes, limits), len(hashes))


def requests(chunk: str, kind: str, hashes: np.ndarray, columns: list[np.ndarray], n: int) -> list[tuple[str, str, int, bytes]]:
    at = range_starts(hashes, n)
    return [
        (chunk, kind, r, pack(hashes[at[r] : at[r + 1]], *(x[at[r] : at[r + 1]] for x in columns))) for r in range(n) if at[r] < at[r + 1]
    ]


def batch(found: list[tuple[str, str, int, bytes]]) -> pa.RecordBatch:
    return rows(*map(list, zip(*found, strict=True))) if found else rows([], [], [], [])


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for one in batches:
        for name, data in zip(one.column("chunk").to_pylist(), one.column("data"), strict=True):
            yield name, data.as_py()


def parts(group: pa.Table) -> tuple[str, dict[str, bytes | list[np.ndarray]]]:
    """Of one chunk: its own blob under "chunk", and the answers of each kind, ranges put together in order."""
    found = sorted(zip(group.column("kind").to_pylist(), group.column("r").to_pylist(), range(group.num_rows), strict=True))
    data, out = group.column("data"), {}
    for kind in {k for k, _, _ in found}:
        blobs = [data[i].as_py() for k, _, i in found if k == kind]
        out[kind] = blobs[0] if kind == "chunk" else [np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True)]
    return group.column("chunk")[0].as_py(), out
