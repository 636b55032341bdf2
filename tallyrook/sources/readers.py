"""Readers of pages: a registry of functions from pages to transcriptions.

A reader takes pages (doc_id, page, content) and returns doc_id, page, text, confidence, source, one row a page. External engines run in
the workers, a process a page, within the page's seconds; further ones register themselves.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import Deadline

Reader = Callable[..., DataFrame]
_READERS: dict[str, Reader] = {}
#: Readers that only evaluations may use.
_EVALUATED: dict[str, Reader] = {}
# The command of the external engine, its languages in order of preference ("": its own), and the columns of its table.
COMMAND, LANGUAGES = "tesseract", ("por", "eng", "")
COLUMNS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")
PAGE_SECONDS = 300.0


def register(name: str, evaluation_only: bool = False) -> Callable[[Reader], Reader]:
    def add(reader: Reader) -> Reader:
        (_EVALUATED if evaluation_only else _READERS)[name] = reader
        return reader

    return add


def _named(name: str, known: dict[str, Reader]) -> Reader:
    if name not in known:
        raise ValueError(f"unknown reader {name}; there are {', '.join(sorted(known))}")
    return known[name]


def reader(name: str) -> Reader:
    return _named(name, _READERS)


def evaluation_reader(name: str) -> Reader:
    """Also those that aren't for production."""
    return _named(name, _READERS | _EVALUATED)


@register("mock")
def mock(pages: DataFrame, text: str = "Controle de ocorrencias\nItem Hora Descricao Resolvido\nS/A\nRonda") -> DataFrame:
    """Returns one text for every page."""
    return pages.select("doc_id", "page", F.lit(text).alias("text"), F.lit(0.9).alias("confidence"), F.lit("mock").alias("source"))


@register("text", evaluation_only=True)
def plain(pages: DataFrame) -> DataFrame:
    """Pages that are text already: bytes that aren't UTF-8 come out as the replacement character."""
    return pages.select("doc_id", "page", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(1.0).alias("confidence"), F.lit("text").alias("source"))


def parsed(table: str) -> tuple[str, float]:
    """Text and confidence of the engine's table: words of a line joined by blanks, lines in the order first seen; the mean confidence of the
    words that have one."""
    lines: dict[tuple, list[str]] = {}
    good = []
    for row in table.splitlines()[1:]:
        cells = dict(zip(COLUMNS, row.split("\t"), strict=False))
        if cells.get("text", "").strip():
            lines.setdefault(tuple(cells[c] for c in ("block_num", "par_num", "line_num")), []).append(cells["text"])
            if float(cells["conf"]) >= 0:
                good.append(float(cells["conf"]))
    return "\n".join(" ".join(words) for words in lines.values()), sum(good) / len(good) / 100 if good else 0.0


def read_page(content: bytes, deadline: Deadline, command: str = COMMAND) -> tuple[str, float, str, str | None]:
    """Text, confidence, source, error of one page: the first language that the engine has; a page that takes too long is an error."""
    if shutil.which(command) is None:
        return "", 0.0, command, "reader_unavailable"
    for language in LANGUAGES:
        call = [command, "stdin", "stdout", *(["-l", language] if language else []), "tsv"]
        try:
            done = subprocess.run(call, input=content, capture_output=True, timeout=deadline.bounded(PAGE_SECONDS), check=False)
        except (subprocess.TimeoutExpired, TimeoutError):
            return "", 0.0, command, "processing deadline exceeded"
        if done.returncode == 0:
            return (*parsed(done.stdout.decode("utf-8", "replace")), f"{command}:{language or 'default'}", None)
    return "", 0.0, command, "reader_error"


@register("tesseract")
def tesseract(pages: DataFrame, seconds: float = PAGE_SECONDS, command: str = COMMAND) -> DataFrame:
    """The external engine; needs its program on the workers. error says why a page has no text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_page(c.as_py() or b"", Deadline(seconds), command) for c in batch.column("content")]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), *columns], names=["doc_id", "page", "text", "confidence", "source", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("doc_id", "page", "content").mapInArrow(work, f"doc_id {kinds['doc_id']}, page {kinds['page']}, text string, confidence double, source string, error string")
