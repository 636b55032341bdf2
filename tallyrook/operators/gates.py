"""Output that becomes visible only if what is written holds: checks are observed in the pass that writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Refused(ValueError):
    """Names the checks that failed, in order, and nothing of the rows."""

    def __init__(self, failed: list[str]):
        super().__init__(f"not published: {', '.join(failed)}")
        self.failed = failed


def write_if(rows: DataFrame, path: str, checks: dict[str, Column], format: str = "parquet") -> int:  # noqa: A002
    """Write the rows if no check counts anything; returns how many there are. A check is a condition of a row that must not hold (null: it
    doesn't). The rows are computed once: they go aside while Spark counts, and are moved to the path or removed. A path that
    exists is an error, before anything is computed and when the rows are moved."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    aside, there = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path.rstrip('/')}._aside-{uuid.uuid4().hex}", path))
    system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(there):
        raise FileExistsError(f"{path} exists")
    seen = Observation()
    counts = [F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in checks.items()]
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("_rows"), *counts).write.format(format).save(str(aside))
        found = seen.get
        failed = [name for name in checks if found.get(name)]
        if failed:
            raise Refused(failed)
        if system.exists(there) or not system.rename(aside, there):
            raise FileExistsError(f"{path} exists")
    finally:
        system.delete(aside, True)
    return found.get("_rows") or 0
