"""The ledger on a stream: the same outcomes as the fold of operators.ledger, with state kept for each draft.

An addition of this engine; the batch fold is what it is checked against. Events of a draft have to arrive within the
watermark; a micro-batch applies a draft's events in (ts, event_id) order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import Draft, begin, step

OUT = "draft_id long, event_id long, outcome string, detail string, revision long"
STATE = "revision long, status string, approved_revision long, approved_sha string, sha string, reviewable boolean, sent boolean"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    draft = Draft(*state.get) if state.exists else None
    first = draft is None
    events = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    out = []
    columns = [events[c].tolist() for c in ("event_id", "action", "sha", "reviewable", "expected")]
    for event_id, action, sha, reviewable, expected in zip(*columns, strict=True):
        draft = draft or begin(sha, reviewable)
        draft, outcome, detail = step(draft, first, action, sha, reviewable, None if pd.isna(expected) else int(expected))
        first = False
        out.append((key[0], event_id, outcome, detail, draft.revision))
    state.update(tuple(draft))
    yield pd.DataFrame(out, columns=["draft_id", "event_id", "outcome", "detail", "revision"])


def outcomes(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A streaming log (operators.ledger.log) to a stream of outcomes, one row an event."""
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    return log.withWatermark("ts", late).groupBy("draft_id").applyInPandasWithState(_step, OUT, STATE, "append", "NoTimeout")


def counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by action in windows of event time; a window comes out once the watermark passed it."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
