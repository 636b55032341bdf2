"""Evidence, files that are kept once and never change, as a data source: spark.read and df.write with format("evidence").

A version is a folder: parts, each with its files one after the other and a list of them, and a root that names the parts. Tasks write their
parts aside; the commit, which runs once on the driver, moves them in place and writes the root last.
Without a root nothing is there for a reader, so a killed task or a stopped job leaves nothing visible. A version that
is there is not written again: the same files, however they were dealt to tasks, are verified, others are an error.

The root holds one line a part, never one a file. What a version is, is the sum of its files' hashes, which doesn't depend on order. Paths
are those of pyarrow's file systems: folders that driver and workers share, and the object stores it knows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, content binary, sha256 string"
#: Files that one task reads, and the name of the root.
FILES_A_TASK, ROOT = 1_000, "EVIDENCE.json"
_MODULUS = 1 << 256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)


def identity(name: str, content: bytes) -> int:
    return int.from_bytes(hashlib.sha256(f"{name}\n{hashlib.sha256(content).hexdigest()}".encode()).digest(), "big")


def _text(system: fs.FileSystem, path: str) -> str:
    with system.open_input_stream(path) as f:
        return f.read().decode()


def _put(system: fs.FileSystem, path: str, text: str) -> None:
    with system.open_output_stream(path) as f:
        f.write(text.encode())


@dataclass
class Part(WriterCommitMessage):
    name: str
    files: int
    sum: int


@dataclass
class Range(InputPartition):
    part: str
    first: int
    last: int


class EvidenceWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.aside = path, f"_aside-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Part:
        """A task's part. It has a name of its own in every attempt; parts that no commit names are never read."""
        system, base = opened(self.path)
        part, total, listed, at = uuid.uuid4().hex, 0, [], 0
        system.create_dir(f"{base}/{self.aside}", recursive=True)
        with system.open_output_stream(f"{base}/{self.aside}/{part}.bytes") as out:
            for row in rows:
                name, content = row["name"], bytes(row["content"] or b"")
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError("names are relative paths without steps upward")
                out.write(content)
                listed.append({"name": name, "at": at, "size": len(content), "sha256": hashlib.sha256(content).hexdigest()})
                total, at = (total + identity(name, content)) % _MODULUS, at + len(content)
        _put(system, f"{base}/{self.aside}/{part}.list", "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in listed))
        return Part(part, len(listed), total)

    def commit(self, messages: list[Part | None]) -> None:
        system, base = opened(self.path)
        parts = sorted((m for m in messages if m is not None and m.files), key=lambda m: m.name)
        whole = {"files": sum(p.files for p in parts), "sum": f"{sum(p.sum for p in parts) % _MODULUS:064x}", "parts": [{"name": p.name, "files": p.files} for p in parts]}
        try:
            if (there := root(self.path)) is not None:
                if (there["files"], there["sum"]) != (whole["files"], whole["sum"]):
                    raise ValueError(f"{self.path} holds another version")
                return
            system.create_dir(f"{base}/parts", recursive=True)
            for p in parts:
                for kind in ("bytes", "list"):
                    system.move(f"{base}/{self.aside}/{p.name}.{kind}", f"{base}/parts/{p.name}.{kind}")
            mine = f"{base}/{self.aside}-root"
            _put(system, mine, json.dumps(whole))
            system.move(mine, f"{base}/{ROOT}")
        finally:
            self._clear(system, base)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        if system.get_file_info(f"{base}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.aside}")


class EvidenceReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.root = root(path)
        if self.root is None:
            raise FileNotFoundError(f"there is no evidence in {path}")

    def partitions(self) -> list[Range]:
        cuts = [Range(p["name"], at, min(p["files"], at + FILES_A_TASK)) for p in self.root["parts"] for at in range(0, p["files"], FILES_A_TASK)]
        return cuts or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.part:
            return
        system, base = opened(self.path)
        entries = _text(system, f"{base}/parts/{partition.part}.list").splitlines()[partition.first : partition.last]
        with system.open_input_file(f"{base}/parts/{partition.part}.bytes") as f:
            for entry in map(json.loads, entries):
                f.seek(entry["at"])
                content = f.read(entry["size"])
                if hashlib.sha256(content).hexdigest() != entry["sha256"]:
                    raise ValueError(f"{entry['name']} is damaged")
                yield entry["name"], content, entry["sha256"]


class Evidence(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return EvidenceReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("evidence is never overwritten")
        return EvidenceWriter(self.options["path"])


def root(path: str) -> dict | None:
    """Numbers and parts of the version in a folder; None if there is none."""
    system, base = opened(path)
    if system.get_file_info(f"{base}/{ROOT}").type != fs.FileType.File:
        return None
    return json.loads(_text(system, f"{base}/{ROOT}"))


def persist(files: DataFrame, path: str) -> str:
    """Write name and content as evidence: created, or verified where the same files are there. Other files there are an error. Null content
    is empty; of a name that several rows have, each is kept."""
    files.sparkSession.dataSource.register(Evidence)
    there = root(path) is not None
    files.select("name", "content").write.format("evidence").mode("append").save(path)
    return "verified" if there else "created"


def read(spark: SparkSession, path: str) -> DataFrame:
    """name, content, sha256: the files of a version, each checked against its hash."""
    spark.dataSource.register(Evidence)
    return spark.read.format("evidence").load(path)
