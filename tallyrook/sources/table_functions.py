"""Readers as SQL table functions: SELECT * FROM read_pages(TABLE(pages) PARTITION BY (doc_id) ORDER BY (page), 'text').

Each document is a partition of the table argument: its pages are read in order, within one deadline; those that the deadline leaves out
come back marked, so every page has its row. The columns follow from the argument when the query is analysed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .images import Deadline
from .readers import PAGE_SECONDS, read_page

DEADLINE = "processing deadline exceeded"

#: text, confidence, source, error of a page's bytes, within a deadline.
Page = Callable[[bytes, Deadline], tuple[str, float, str, "str | None"]]
_PAGES: dict[str, Page] = {
    "text": lambda content, _: (content.decode("utf-8", "replace"), 1.0, "text", None),
    "mock": lambda content, _: ("Controle de ocorrencias\nItem Hora Descricao Resolvido\nS/A\nRonda", 0.9, "mock", None),
    "tesseract": read_page,
}


def register(name: str, read: Page) -> None:
    """A further reader, for sessions that install() is called for afterwards."""
    _PAGES[name] = read


def made(known: dict[str, Page]) -> type:
    """The function's class, with the readers it knows: workers analyse and run what the session's driver registered."""

    class ReadPages:
        """One document's pages."""

        @staticmethod
        def analyze(pages: AnalyzeArgument, reader: AnalyzeArgument, seconds: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not pages.isTable:
                raise ValueError("the first argument has to be TABLE(...) of pages")
            kinds = {f.name: f.dataType for f in pages.dataType.fields}
            missing = [c for c in ("doc_id", "page", "content") if c not in kinds]
            if missing:
                raise ValueError(f"pages lack {', '.join(missing)}")
            if reader.value not in known:
                raise ValueError(f"unknown reader {reader.value}; there are {', '.join(sorted(known))}")
            own = [StructField(c, kinds[c]) for c in ("doc_id", "page")]
            return AnalyzeResult(StructType([*own, StructField("text", StringType()), StructField("confidence", DoubleType()), StructField("source", StringType()), StructField("error", StringType())]))

        def __init__(self) -> None:
            self.deadline: Deadline | None = None

        def eval(self, pages: Row, reader: str, seconds: float = PAGE_SECONDS) -> Iterator[tuple]:
            self.deadline = self.deadline or Deadline(float(seconds))
            try:
                self.deadline.remaining()
                text, confidence, source, error = known[reader](bytes(pages["content"] or b""), self.deadline)
            except TimeoutError:
                text, confidence, source, error = "", 0.0, reader, DEADLINE
            yield pages["doc_id"], pages["page"], text, confidence, source, error

    return ReadPages


def install(spark: SparkSession) -> None:
    """Make read_pages known to the session's SQL."""
    spark.udtf.register("read_pages", udtf(made(dict(_PAGES))))
