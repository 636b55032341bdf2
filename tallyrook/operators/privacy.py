"""Scan of texts for what must not be published: category and line of each finding, never the match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as term_table

# Categories and patterns, in the order of the report. The clock pattern leaves out parts of longer stamps without look-around.
CLOCK = ("clock-time", r"(^|[^0-9:+-])[0-9]{1,2}:[0-9]{2}($|[^0-9:]|:($|[^0-9]))")
HOMES = (
    ("local-home-path", r"(?i)(^|[^A-Za-z0-9])[A-Z]:[\\/]+Users[\\/]+[^\\/\r\n]+"),
    ("local-home-path", r"/(home|Users)/[^/\r\n]+"),
)
#: Additions of this engine.
CONTACT = (
    ("e-mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("ip-address", r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}($|[^0-9.])"),
)


def patterns(organizations: tuple[str, ...] = (), times: bool = True, contact: bool = True) -> list[tuple[str, str]]:
    """Categories and patterns of a scan: names of organizations (patterns, in any case, as whole words), clock times, home folders, and
    e-mail and IP addresses."""
    out = [("organization-sentinel", rf"(?i)(^|[^A-Za-z0-9_]){name}($|[^A-Za-z0-9_])") for name in organizations]
    return [*out, *([CLOCK] if times else []), *HOMES, *(CONTACT if contact else ())]


def findings(docs: DataFrame, terms: tuple[str, ...] | DataFrame = (), organizations: tuple[str, ...] = (), times: bool = True, contact: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line (from 1), category: patterns are compiled into one pass over the lines, so lines are not joined with patterns.
    Private terms match anywhere, in any case, and are reported as private-term only, once a line for each; a few may be given as
    they are, a list of any length as a table with the column term, such as operators.terms.load() gives."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\R", -1)).alias("n", "t"))
    tests = [F.when(F.col("t").rlike(p), F.lit(c)) for c, p in patterns(organizations, times, contact)]
    own = () if isinstance(terms, DataFrame) else terms
    tests += [F.when(F.contains(F.lower("t"), F.lit(x.lower())), F.lit("private-term")) for x in own]
    lines = lines.select("id", (F.col("n") + 1).cast("long").alias("line"), "t")
    out = lines.select("id", "line", F.explode(F.array_compact(F.array(*tests))).alias("category"))
    if not isinstance(terms, DataFrame):
        return out
    return out.unionByName(term_table.found(lines, terms, columns=("id", "line")).select("id", "line", F.lit("private-term").alias("category")))


# Files of prose, scanned for clock times too, and files of code and data, where times are no secret.
PROSE, CODE = ("md", "yaml", "yml", "txt", "rst"), ("py", "js", "html", "j2", "json", "jsonl", "csv", "toml")


def folder_findings(spark: SparkSession, path: str, terms: tuple[str, ...] | DataFrame = (), organizations: tuple[str, ...] = (), private: str = "private") -> DataFrame:
    """id (a file's path), line, category: findings in the text files of a folder and the folders in it, but for those in the private one.
    A file is a row; other kinds of files aren't read."""

    def read(suffixes: tuple[str, ...], times: bool) -> DataFrame:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").text(path, wholetext=True)
        files = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).where(~F.contains("file", F.lit(f"/{private}/")))
        return findings(files, terms, organizations, times, contact=False, id_col="file")

    return read(PROSE, True).unionByName(read(CODE, False))
