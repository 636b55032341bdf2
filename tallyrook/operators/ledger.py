"""The approval ledger as a fold over events: compare-and-set on revisions, stamps that edits revoke, simulation exactly once, pages.

An event log has one row an action: draft_id, ts, event_id, action (submit, edit, overwrite, approve, reject, simulate), sha (of
the content that the event brings), reviewable (whether that content could be approved) and expected (the revision that its
author saw; null asks for none). Whether an edit counts depends on the revision that the edits before it led to, so this is a fold and no
window: rows come sorted by draft and time, and one state goes along; no draft is gathered, however many events it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sheets import table

# What an event of the stream does to the draft of its user; outcomes that change a draft.
ACTIONS = {"signup": "submit", "click": "edit", "purchase": "approve", "error": "reject", "view": "simulate"}
CHANGES = ("submitted", "edited", "approval_revoked", "status:approved", "status:rejected", "simulation_completed")


class Draft(NamedTuple):
    revision: int
    status: str
    approved_revision: int | None
    approved_sha: str | None
    sha: str | None
    reviewable: bool
    sent: bool


def begin(sha: str | None, reviewable: bool) -> Draft:
    """A draft that nothing was done to yet; its content is that of its first event."""
    return Draft(1, "pending", None, None, sha, reviewable, False)


def step(d: Draft, first: bool, action: str, sha: str | None, reviewable: bool, expected: int | None) -> tuple[Draft, str, str | None]:
    """The draft after an event, the event's outcome, and the detail that the audit notes."""
    short = (sha or "")[:12]
    if action == "submit":
        return (d, "submitted", None) if first else (d, "already_submitted", None)
    if action == "overwrite":  # content changed behind the ledger's back
        return d._replace(sha=sha, reviewable=reviewable), "overwritten", None
    if action == "simulate":
        if d.status != "approved":
            return d, "simulation_blocked", f"status={d.status}"
        if d.sent:
            return d, "simulation_blocked", "already_simulated"
        if d.approved_revision != d.revision or d.approved_sha != d.sha:
            return d, "simulation_blocked", f"stale_approval rev={d.revision} approved_rev={d.approved_revision}"
        if not d.reviewable:
            return d, "simulation_blocked", "not_reviewable"
        return d._replace(sent=True), "simulation_completed", f"mode=simulated rev={d.revision} sha256={(d.sha or '')[:12]}"
    if expected is not None and expected != d.revision:
        return d, "conflict", f"rev={d.revision} expected={expected}"
    if d.sent:
        return d, "edit_blocked" if action == "edit" else "status_blocked", "already_simulated"
    if action == "edit":
        new = d._replace(revision=d.revision + 1, sha=sha, reviewable=reviewable)
        if d.status == "approved":
            return new._replace(status="pending", approved_revision=None, approved_sha=None), "approval_revoked", f"rev={new.revision} sha256={short}"
        return new, "edited", f"rev={new.revision} sha256={short}"
    if action == "approve":
        return d._replace(status="approved", approved_revision=d.revision, approved_sha=d.sha), "status:approved", f"rev={d.revision} sha256={(d.sha or '')[:12]}"
    return d._replace(status="rejected", approved_revision=None, approved_sha=None), "status:rejected", None


def log(events: DataFrame) -> DataFrame:
    """The stream of events as a log: every 13th edit goes past the ledger, every 7th event names a revision, every 5th content can't be
    approved."""
    action = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))[F.col("event_type")]
    k = F.col("event_id")
    return events.select(
        F.col("user_id").alias("draft_id"), "ts", "event_id", F.when((action == "edit") & (k % 13 == 0), "overwrite").otherwise(action).alias("action"), F.sha2("props", 256).alias("sha"),
        (k % 5 != 0).alias("reviewable"), F.when(k % 7 == 0, 1 + k % 4).cast("long").alias("expected"),
    )


def of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(table(spark, sf_dir, "events"))


_FOLDED = (("revision", pa.int64()), ("status", pa.string()), ("approved_revision", pa.int64()), ("approved_sha", pa.string()), ("state_sha", pa.string()), ("state_reviewable", pa.bool_()), ("sent", pa.bool_()), ("outcome", pa.string()), ("detail", pa.string()))
FOLDED = ", ".join(f"{n} {({pa.int64(): 'long', pa.string(): 'string', pa.bool_(): 'boolean'})[k]}" for n, k in _FOLDED)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    draft, state, first = None, None, True
    for batch in batches:
        rows = []
        for name, action, sha, reviewable, expected in zip(*(batch.column(c).to_pylist() for c in ("draft_id", "action", "sha", "reviewable", "expected")), strict=True):
            if state is None or name != draft:
                draft, state, first = name, begin(sha, reviewable), True
            state, outcome, detail = step(state, first, action, sha, reviewable, expected)
            first = False
            rows.append((*state, outcome, detail))
        columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_FOLDED)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(n for n, _ in _FOLDED)])


def outcomes(events: DataFrame) -> DataFrame:
    """The log with the draft's state after each event, the event's outcome and detail. Needs one shuffle by draft."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.repartition(F.col("draft_id")).sortWithinPartitions("draft_id", "ts", "event_id").mapInArrow(_fold, f"{kinds}, {FOLDED}")


def drafts(events: DataFrame) -> DataFrame:
    """One row a draft: status, revision, approved_revision and approved_sha (of a standing approval), sha, sent_at, created_at, updated_at."""
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    changed = F.when(F.col("outcome").isin(*CHANGES), F.col("ts"))
    return outcomes(events).groupBy("draft_id").agg(
        *(last(c).alias(n) for c, n in (("status", "status"), ("revision", "revision"), ("approved_revision", "approved_revision"), ("approved_sha", "approved_sha"), ("state_sha", "sha"), ("state_reviewable", "reviewable"))),
        F.min(F.when(F.col("outcome") == "simulation_completed", F.col("ts"))).alias("sent_at"), F.min("ts").alias("created_at"), F.coalesce(F.max(changed), F.min("ts")).alias("updated_at"),
    )


def snapshots(rows: DataFrame) -> DataFrame:
    """draft_id, revision, sha, n: the content that each revision began with, from outcomes(); n has to be 1, as revisions are appended once."""
    made = rows.where(F.col("outcome").isin("edited", "approval_revoked")).select("draft_id", "revision", F.col("state_sha").alias("sha"), F.lit(1).alias("one"))
    first = rows.groupBy("draft_id").agg(F.min_by("sha", F.struct("ts", "event_id")).alias("sha")).select("draft_id", F.lit(1).cast("long").alias("revision"), "sha", F.lit(1).alias("one"))
    return made.unionByName(first).groupBy("draft_id", "revision").agg(F.min("sha").alias("sha"), F.sum("one").alias("n"))


def snapshot_verdict(revision: Column, sha: Column, expected_revision: Column, expected_sha: Column) -> Column:
    """ok, invalid (not the form of a snapshot's identity) or changed (the draft is another by now)."""
    invalid = expected_revision.isNull() | (expected_revision < 1) | ~F.coalesce(expected_sha.rlike("^[0-9a-f]{64}$"), F.lit(False))
    return F.when(invalid, "invalid").when((revision != expected_revision) | ~sha.eqNullSafe(expected_sha), "changed").otherwise("ok")


def listed(rows: DataFrame) -> DataFrame:
    """All drafts, oldest first."""
    return rows.orderBy("created_at", "draft_id")


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of a total order."""
    return rows.orderBy(*order).limit(n)


def in_view(rows: DataFrame, view: str | None) -> DataFrame:
    """A status view: simulated drafts are those sent, and no longer among the approved."""
    if view is None:
        return rows
    if view == "simulated":
        return rows.where("sent_at is not null")
    return rows.where(F.col("status") == view).where("sent_at is null") if view == "approved" else rows.where(F.col("status") == view)


def view_of() -> Column:
    """The view that shows a row of drafts()."""
    return F.when(F.col("sent_at").isNotNull(), "simulated").otherwise(F.col("status"))


def queue_page(rows: DataFrame, size: int, cursor: tuple[str, int] | None = None, view: str | None = None) -> DataFrame:
    """A page by key: newest first, after the cursor (created_at, draft_id); one row more tells that there is a next page."""
    if not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 rows")
    rows = in_view(rows, view)
    if cursor:
        at, last = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("draft_id") < last)))
    return rows.orderBy(F.desc("created_at"), F.desc("draft_id")).limit(size + 1)


def audit_page(events: DataFrame, size: int, before_id: int | None = None) -> DataFrame:
    """The newest events before an id, in time order."""
    if not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 rows")
    rows = events if before_id is None else events.where(F.col("event_id") < before_id)
    return rows.orderBy(F.desc("event_id")).limit(size).orderBy("event_id")


def rfc3339(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def cursor(ts, draft) -> Column:
    """base64url of the JSON array [time, id], without padding."""
    raw = F.base64(F.concat(F.lit('["'), rfc3339(ts), F.lit('","'), draft.cast("string"), F.lit('"]')).cast("binary"))
    return F.regexp_replace(F.translate(F.regexp_replace(raw, r"\s", ""), "+/", "-_"), "=+$", "")


def decoded(text) -> Column:
    """struct(at, id) of a cursor, null if it isn't one."""
    padded = F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
    plain = F.try_to_binary(padded, F.lit("base64")).cast("string")
    parts = F.from_json(plain, "array<string>")
    good = (F.size(parts) == 2) & parts[0].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z$")
    return F.when(good, F.struct(parts[0].alias("at"), parts[1].alias("id")))
