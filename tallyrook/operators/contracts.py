"""What may be published and what must never change: canonical JSON, strict reading, verification of manifests, exports, create-once files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strict_json
from ..functions.text import csv_safe
from ..sources.shared import kept
from . import evaluate, gates, manifest, merkle, privacy

# Limits and names of the contracts.
MOST_SOURCE_BYTES = 1 << 20
ENTRY_KEYS = ("doc_id", "gt", "image", "sha256_gt", "sha256_img", "split")
CSV_HEAD = ("DIA", "UNIDADE", "OBJETO", "DESCRICAO")
#: Rows that one task numbers.
ROWS_A_BUCKET = 1_000_000
BINARY_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "pdf")
DATABASE_SUFFIXES = ("db", "sqlite", "sqlite3")


def canonical_json(struct: Column, keys: Sequence[str]) -> Column:
    """A flat struct as compact JSON with keys in code point order; nulls are written, letters stay as they are."""
    return F.to_json(F.struct(*(struct[k].alias(k) for k in sorted(keys))), {"ignoreNullFields": "false"})


def canonical_sheet(text: Column) -> Column:
    """A truth sheet's text as canonical JSON without the pointer to its file; null if it isn't one strict JSON object."""
    return strict_json.canonical(text, without=("source_file",))


def manifest_sha(entries: DataFrame) -> DataFrame:
    """n_rows, sha: the root of the hash tree over the canonical lines, whatever their order."""
    return merkle.root(entries, canonical_json(F.struct(*ENTRY_KEYS), ENTRY_KEYS))


def entry_errors(lines: DataFrame, split: str | None = None) -> DataFrame:
    """The manifest's lines (line_number, text) with its fields and error: the first fault of each.

    blank line, not strict JSON (duplicate keys too), other keys than the six, a bad id, hash or path, another split than asked for, and an
    id, image or truth that several lines have."""
    verdict = strict_json.verdict(F.col("text"))
    kinds = ", ".join(f"{k} string" for k in ENTRY_KEYS)
    rows = lines.withColumn("json", verdict).withColumn("e", F.from_json("text", kinds)).withColumn("keys", F.array_sort(F.map_keys(F.from_json("text", "map<string,string>"))))
    rows = rows.select("line_number", "text", "json", "keys", "e.*")
    named = lambda folder, suffix: F.concat(F.lit(f"{folder}/"), F.col("doc_id"), F.lit(suffix))
    own = (
        F.when(F.trim("text") == "", "blank line").when(F.col("json") != "ok", F.concat(F.lit("not strict JSON: "), "json")).when(~exact_keys(F.col("keys"), ENTRY_KEYS), "other keys")
        .when(~F.coalesce(F.col("doc_id").rlike(manifest.DOC_ID), F.lit(False)), "bad id")
        .when(~F.coalesce(F.col("sha256_img").rlike(manifest.SHA256) & F.col("sha256_gt").rlike(manifest.SHA256), F.lit(False)), "bad hash")
        .when(~F.coalesce((F.col("image") == named("pngs", ".png")) & (F.col("gt") == named("gt", ".json")), F.lit(False)), "bad path")
        .when(~F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False)), "bad split")
    )
    if split is not None:
        own = own.when(F.col("split") != split, "wrong split")
    rows = rows.withColumn("own", own)
    # of lines without a fault, image and truth follow from the id: they are repeated where it is
    ids = rows.where("own is null").groupBy("doc_id").agg((F.count("*") > 1).alias("twice"))
    rows = rows.join(ids.where("twice"), "doc_id", "left")
    return rows.select("line_number", *ENTRY_KEYS, F.coalesce("own", F.when(F.col("twice"), "repeated doc_id")).alias("error"))


def verified(entries: DataFrame, files: DataFrame, truths: DataFrame, provenance: dict[str, str], count: int | None = None) -> DataFrame:
    """The entries with error: what of an entry doesn't hold against its files (path, sha256, png_valid) and truth sheets (doc_id, sha256,
    document_id, review_status, truth_source, no_change, n_occurrences, and the columns of provenance).

    Missing files, an image that isn't PNG, hashes that differ, a truth of another sheet, no change with occurrences, other provenance, and, where
    a count is given, another number of entries. One join each; nothing is collected."""
    images = files.select(F.col("path").alias("image"), F.col("sha256").alias("img_found"), "png_valid")
    rows = entries.join(images, "image", "left").join(truths.withColumnRenamed("sha256", "gt_found"), "doc_id", "left")
    other = [F.when(~F.col(c).eqNullSafe(F.col("split") if v == "<split>" else F.lit(v)), f"provenance: {c}") for c, v in provenance.items()]
    error = F.coalesce(
        F.when(F.col("img_found").isNull() | F.col("gt_found").isNull(), "files missing"), F.when(~F.col("png_valid"), "not a PNG"), F.when(F.col("img_found") != F.col("sha256_img"), "image hash differs"),
        F.when(F.col("gt_found") != F.col("sha256_gt"), "truth hash differs"), F.when(~F.col("document_id").eqNullSafe(F.col("doc_id")), "truth of another sheet"),
        F.when(~F.col("review_status").eqNullSafe("synthetic_ground_truth") | ~F.col("truth_source").eqNullSafe("generator"), "not generated truth"),
        F.when(F.col("no_change") & (F.col("n_occurrences") > 0), "no change with occurrences"), *other,
    )
    out = rows.select(*entries.columns, error.alias("error"))
    if count is None:
        return out
    n = entries.agg((F.count("*") != count).alias("miscounted"))  # one row
    return out.crossJoin(F.broadcast(n)).withColumn("error", F.coalesce("error", F.when(F.col("miscounted"), "another number of entries"))).drop("miscounted")


def exact_keys(keys: Column, wanted: Sequence[str]) -> Column:
    """Whether an array of keys holds exactly the wanted ones."""
    return F.coalesce(F.array_sort(keys) == F.array(*map(F.lit, sorted(wanted))), F.lit(False))


def bounded_json(content: Column) -> Column:
    """ok, or why a binary isn't one strict JSON object of at most MOST_SOURCE_BYTES; larger ones are not parsed. The content is written and
    computed once."""
    return F.get(F.transform(F.array(content), _bounded), F.lit(0))


def _bounded(content: Column) -> Column:
    text = F.when(F.is_valid_utf8(content), content.cast("string"))
    small = F.octet_length(content) <= MOST_SOURCE_BYTES
    verdict = strict_json.verdict(F.when(small, text))
    is_object = F.ltrim(text).startswith("{")
    return F.when(~small, "too large").when(text.isNull(), "not UTF-8").when(verdict != "ok", verdict).when(~is_object, "not an object").otherwise("ok")


def numbered(rows: DataFrame, key: str, bucket: Column) -> DataFrame:
    """The rows with place, from 1, in the order of a key. bucket: a number that rises with the key; a task numbers one bucket, and one row a
    bucket is added up. Buckets follow from the key's value alone, so that every run of the plan deals rows alike."""
    parted = rows.withColumn("_bucket", bucket)
    sizes = parted.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return parted.withColumn("_place", place).join(starts, "_bucket").withColumn("place", F.col("_start") + F.col("_place")).drop("_bucket", "_place", "_start")


def public(rows: DataFrame, whitelist: Sequence[str], key: str) -> DataFrame:
    """sheet, and the columns of the whitelist: sheets are named by their place in the order of the key, of any type, which doesn't go
    along. Rows are dealt by ranges of the key and written once, so that their places stay; what is counted is one number a range."""
    spread = rows.select(F.col(key).alias("_key"), *whitelist).withColumn("_row", F.xxhash64(*whitelist) if whitelist else F.lit(0))
    # rows of one key are dealt by their content too, so that a hot key isn't one task
    ranged = spread.repartitionByRange(rows.count() // ROWS_A_BUCKET + 1, "_key", "_row").sortWithinPartitions("_key", "_row")
    placed = kept(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_key", "_row"), "public")
    placed = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_inside", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_inside") + 1
    return placed.join(starts, "_range").select(F.concat(F.lit("sheet_"), place.cast("string")).alias("sheet"), *whitelist)


def publish(rows: DataFrame, path: str, terms: Sequence[str] = (), organizations: Sequence[str] = ()) -> None:
    """Write rows of public() as JSON, if no cell holds what must not be published; a finding is an error that names its category only, and
    leaves no output. A path that exists is an error too. The cells are searched in the pass that writes them."""
    lines = F.flatten(F.transform(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), lambda x: F.split(x, r"\R", -1)))
    any_line = lambda pattern: F.exists(lines, lambda t: t.rlike(pattern))
    checks: dict[str, Column] = {}
    for category, pattern in privacy.patterns(tuple(organizations)):
        held = any_line(pattern)
        checks[category] = checks[category] | held if category in checks else held
    if terms:
        checks["private-term"] = F.exists(lines, lambda t: reduce(or_, (F.contains(F.lower(t), F.lit(x.lower())) for x in terms)))
    gates.write_if(rows, path, dict(sorted(checks.items())), "json")


def publish_buckets(rows: DataFrame, n_sheets: int, path: str) -> None:
    """Write rows of evaluate.buckets() as JSON, if none breaks a rule of published metrics and the row of all sheets passes every release gate."""
    whole = F.col("level") == 3
    failures = evaluate.gate_failures(rows, F.lit(n_sheets), F.col("n_ran"))
    checks = {"inconsistent metrics": F.size(evaluate.inconsistencies(rows)) > 0, "release gate": whole & (F.size(failures) > 0)}
    gates.write_if(rows, path, checks, "json")


def export(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From sheet_id, blockers and shown (an array of pos, dia, unidade, objeto, descricao): the CSV rows of sheets that nothing blocks, cells
    made safe, and the audit, sheet_id, action, detail of each sheet with rows, exported or refused. A sheet without rows has neither."""
    free = F.size("blockers") == 0
    cells = F.transform("shown", lambda r: F.struct(r["pos"].alias("pos"), *(csv_safe(r[c.lower()]).alias(c) for c in CSV_HEAD)))
    rows = sheets.select("sheet_id", F.inline(F.filter(cells, lambda _: free)))
    n = F.size("shown").cast("string")
    entry = F.struct(F.when(free, "export_csv").otherwise("export_blocked").alias("action"), F.when(free, F.concat(F.lit("rows="), n)).otherwise(F.concat(F.lit("pending: "), F.array_join("blockers", ", "))).alias("detail"))
    return rows, sheets.select("sheet_id", F.inline(F.filter(F.array(entry), lambda _: F.size("shown") > 0)))


def write_csv(rows: DataFrame, path: str) -> None:
    """A CSV file a partition with the header, by Spark's committer; a path that exists is an error."""
    rows.select(*CSV_HEAD).write.mode("errorifexists").option("header", True).option("quoteAll", False).csv(path)


def persist_once(spark: SparkSession, path: str, content: bytes) -> str:
    """created, or verified if the file is there with the same bytes; other bytes are an error. The file is made by a create that fails if it
    is there, so of two writers at a time one creates and the other compares. A writer that is lost half way leaves a file with
    other bytes, which is an error for all that follow."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def same() -> bool:
        stream = system.open(where)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)) == content
        finally:
            stream.close()

    try:
        out = system.create(where, False)
    except Py4JJavaError:
        if not system.exists(where):
            raise
    else:
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return "created"
    if not same():
        raise ValueError(f"{path} is there with other content")
    return "verified"


def write_dataset(sheets: DataFrame, path: str) -> None:
    """A generated corpus: truth as JSON by split, and a manifest of names and hashes by split; a path that exists is an error."""
    truth = F.to_json(F.struct(*sorted(c for c in sheets.columns if c != "split")))
    rows = sheets.select("split", manifest.doc_name(F.col("sheet")).alias("doc_id"), truth.alias("gt_text"))
    rows.write.mode("errorifexists").partitionBy("split").json(f"{path}/gt")
    entries = rows.select("split", "doc_id", F.concat(F.lit("gt/"), "doc_id", F.lit(".json")).alias("gt"), F.sha2("gt_text", 256).alias("sha256_gt"))
    entries.write.mode("errorifexists").partitionBy("split").json(f"{path}/manifests")


def database_class(path: Column, tracked: Column) -> Column:
    """Where a database was found: the expected one, another private one, one under version control, one among data, one elsewhere."""
    parts = F.split(path, "/")
    return (
        F.when(path == "private/app.db", "expected_private_db").when(F.get(parts, F.lit(0)) == "private", "private_db").when(tracked, "tracked_outside_private")
        .when(F.array_contains(parts, "data"), "data_db").otherwise("db_outside_private")
    )


def database_level(kind: Column) -> Column:
    """0 clean, 1 warning, 2 blocker."""
    return F.when(kind == "tracked_outside_private", 2).when(kind.isin("data_db", "db_outside_private"), 1).otherwise(0)


def severity(levels: DataFrame, *by: str) -> DataFrame:
    """From (level, action): the highest level, and the actions of those above 0 in order."""
    actions = F.array_sort(F.collect_set(F.when(F.col("level") > 0, F.col("action"))))
    return levels.groupBy(*by).agg(F.max("level").alias("severity"), actions.alias("actions"))


def path_violations(paths: DataFrame) -> DataFrame:
    """path, violation: databases anywhere, and images outside samples, private and generated folders. paths: path, tracked."""
    low = F.lower("path")
    suffix = F.regexp_extract(low, r"\.([a-z0-9]+)$", 1)
    private = F.col("path").startswith("private/") | F.col("path").startswith("data/synthetic/")
    sample = F.col("path").startswith("samples/")
    v = (
        F.when(suffix.isin(*DATABASE_SUFFIXES) & F.col("tracked"), "tracked database").when(suffix.isin(*BINARY_SUFFIXES) & F.col("tracked") & ~sample, "tracked sensitive file")
        .when(~private & suffix.isin(*DATABASE_SUFFIXES), "database outside private").when(~private & suffix.isin(*BINARY_SUFFIXES) & ~sample, "sensitive file outside private")
    )
    return paths.withColumn("violation", v).where("violation is not null")


def output_allowed(path: Column, private_root: str) -> Column:
    """Whether detailed results may go there: inside the private folder, without a way out of it, and never among published documents."""
    inside = path.startswith(private_root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")
    return F.coalesce(inside & ~path.rlike("(^|/)docs(/|$)"), F.lit(False))
