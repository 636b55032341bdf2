"""What the operators share: reading tables, the shared folder, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of other characters than space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"

_own_root: dict[str, str] = {}
_watched: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and everything
    runs in one process (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="tallyrook-")
    return _own_root[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _own_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what runs inside when it has ended; the session's setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stash(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors. by: folders for these columns."""
    path = shared_path(df.sparkSession, name)
    with _own_shuffles_removed(df.sparkSession):
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    if _watched:
        _watched[-1].append(path)
    return out


@contextmanager
def stashes() -> Iterator[list[str]]:
    """The paths of the tables that stash() writes inside, for who removes them once nothing reads them."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield made
    finally:
        _watched.remove(made)


def drop_stash(df: DataFrame) -> None:
    """Remove a table made by stash() that nothing will read again."""
    delete_path(df.sparkSession, df._stash_path)


class Scratch:
    """Tables written on the way to a result, removed together once nothing reads them."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(stash(df, name))
        return self.made[-1]

    def drop(self) -> None:
        while self.made:
            drop_stash(self.made.pop())


def drop_folders(df: DataFrame, folders: list[str]) -> None:
    """Of a table that stash() wrote by folders: remove some that nothing will read again."""
    for folder in folders:
        delete_path(df.sparkSession, f"{df._stash_path}/{folder}")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even when body uses it many times inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_hash(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone: the first 52 bits of the md5 of its text."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52 + 2))


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 8 << 20) -> None:
    """Bound what one Arrow batch holds, for tables with long texts. Results don't depend on it, but plans read it when they run, so it
    stays for the session; a limit is only ever lowered, and what is lower already stays."""
    for name, wanted in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.match(r"\d+", spark.conf.get(key))
        if now is None or not 0 < int(now[0]) <= wanted:
            spark.conf.set(key, wanted)
