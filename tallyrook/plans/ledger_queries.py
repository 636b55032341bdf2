"""Queries over the event log as an approval ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators.asof import as_of

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


OUTCOMES = """RECURSIVE log AS (SELECT user_id AS draft_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'click' THEN CASE WHEN event_id % 13 = 0 THEN 'overwrite' ELSE 'edit' END WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'simulate' END AS action,
  sha256(props) AS sha, event_id % 5 <> 0 AS reviewable, CASE WHEN event_id % 7 = 0 THEN 1 + event_id % 4 END AS expected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
fold AS (SELECT draft_id, 0::BIGINT AS rn, 1::BIGINT AS revision, 'pending' AS status, NULL::BIGINT AS approved_revision, NULL::VARCHAR AS approved_sha, sha AS state_sha, reviewable AS state_reviewable, false AS sent, ''::VARCHAR AS outcome, NULL::VARCHAR AS detail FROM log WHERE rn = 1
 UNION ALL SELECT draft_id, rn, CASE WHEN outcome IN ('edited', 'approval_revoked') THEN revision + 1 ELSE revision END,
  CASE outcome WHEN 'approval_revoked' THEN 'pending' WHEN 'status:approved' THEN 'approved' WHEN 'status:rejected' THEN 'rejected' ELSE status END,
  CASE WHEN outcome IN ('approval_revoked', 'status:rejected') THEN NULL WHEN outcome = 'status:approved' THEN revision ELSE approved_revision END,
  CASE WHEN outcome IN ('approval_revoked', 'status:rejected') THEN NULL WHEN outcome = 'status:approved' THEN state_sha ELSE approved_sha END,
  CASE WHEN outcome IN ('edited', 'approval_revoked', 'overwritten') THEN sha ELSE state_sha END, CASE WHEN outcome IN ('edited', 'approval_revoked', 'overwritten') THEN reviewable ELSE state_reviewable END,
  sent OR outcome = 'simulation_completed', outcome,
  CASE WHEN outcome = 'conflict' THEN 'rev=' || revision || ' expected=' || expected WHEN outcome IN ('edit_blocked', 'status_blocked') THEN 'already_simulated' WHEN outcome IN ('edited', 'approval_revoked') THEN 'rev=' || (revision + 1) || ' sha256=' || substr(sha, 1, 12)
   WHEN outcome = 'status:approved' THEN 'rev=' || revision || ' sha256=' || substr(state_sha, 1, 12) WHEN outcome = 'simulation_completed' THEN 'mode=simulated rev=' || revision || ' sha256=' || substr(state_sha, 1, 12)
   WHEN outcome = 'simulation_blocked' THEN CASE WHEN status <> 'approved' THEN 'status=' || status WHEN sent THEN 'already_simulated' WHEN approved_revision <> revision OR approved_sha <> state_sha THEN 'stale_approval rev=' || revision || ' approved_rev=' || approved_revision ELSE 'not_reviewable' END END
  FROM (SELECT l.draft_id, l.rn, l.sha, l.reviewable, l.expected, f.revision, f.status, f.approved_revision, f.approved_sha, f.state_sha, f.state_reviewable, f.sent,
   CASE WHEN action = 'submit' THEN CASE WHEN l.rn = 1 THEN 'submitted' ELSE 'already_submitted' END WHEN action = 'overwrite' THEN 'overwritten'
    WHEN action = 'simulate' THEN CASE WHEN status <> 'approved' OR sent OR approved_revision <> revision OR approved_sha <> state_sha OR NOT state_reviewable THEN 'simulation_blocked' ELSE 'simulation_completed' END
    WHEN expected IS NOT NULL AND expected <> revision THEN 'conflict' WHEN sent THEN CASE WHEN action = 'edit' THEN 'edit_blocked' ELSE 'status_blocked' END
    WHEN action = 'edit' THEN CASE WHEN status = 'approved' THEN 'approval_revoked' ELSE 'edited' END WHEN action = 'approve' THEN 'status:approved' ELSE 'status:rejected' END AS outcome
   FROM fold f JOIN log l ON l.draft_id = f.draft_id AND l.rn = f.rn + 1)),
outcomes AS (SELECT f.*, ts, event_id, action, sha FROM fold f JOIN log USING (draft_id, rn))"""
DRAFTS = OUTCOMES + """,
drafts AS (SELECT draft_id, arg_max(status, rn) AS status, arg_max(revision, rn) AS revision, arg_max_null(approved_revision, rn) AS approved_revision, arg_max_null(approved_sha, rn) AS approved_sha, arg_max(state_sha, rn) AS sha, min(ts) FILTER (outcome = 'simulation_completed') AS sent_at,
  min(ts) AS created_at, coalesce(max(ts) FILTER (outcome IN ('submitted', 'edited', 'approval_revoked', 'status:approved', 'status:rejected', 'simulation_completed')), min(ts)) AS updated_at FROM outcomes GROUP BY 1)"""
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%fZ')"


@query(f"WITH {OUTCOMES} SELECT draft_id, event_id, action, revision, status, outcome, detail FROM outcomes")
def ledger_revisions(spark, d):
    return L.outcomes(L.of(spark, d)).select("draft_id", "event_id", "action", "revision", "status", "outcome", "detail")


@query(f"WITH {DRAFTS} SELECT draft_id, status, revision, approved_revision, {_ISO.format('sent_at')} AS sent_at, {_ISO.format('created_at')} AS created_at, {_ISO.format('updated_at')} AS updated_at, sha FROM drafts")
def ledger_status(spark, d):
    rows = L.drafts(L.of(spark, d))
    return rows.select("draft_id", "status", F.col("revision").cast("long").alias("revision"), F.col("approved_revision").cast("long").alias("approved_revision"), *(L.rfc3339(F.col(c)).alias(c) for c in ("sent_at", "created_at", "updated_at")), "sha")


@query(f"WITH {OUTCOMES} SELECT draft_id, count_if(outcome = 'approval_revoked') AS revoked, count_if(outcome = 'edit_blocked') AS edits_blocked, count_if(outcome = 'status_blocked') AS status_blocked, count_if(outcome = 'conflict') AS conflicts FROM outcomes GROUP BY 1")
def ledger_stale_approvals(spark, d):
    n = lambda x, name: F.count_if(F.col("outcome") == x).alias(name)
    return L.outcomes(L.of(spark, d)).groupBy("draft_id").agg(n("approval_revoked", "revoked"), n("edit_blocked", "edits_blocked"), n("status_blocked", "status_blocked"), n("conflict", "conflicts"))


@query(f"WITH {OUTCOMES} SELECT outcome, regexp_extract(detail, '^[a-z_]+') AS reason, count(*) AS n, count(DISTINCT draft_id) AS n_drafts FROM outcomes WHERE action = 'simulate' GROUP BY 1, 2")
def ledger_simulation_outcome(spark, d):
    return L.outcomes(L.of(spark, d)).where("action = 'simulate'").groupBy("outcome", F.regexp_extract("detail", "^[a-z_]+", 0).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("draft_id").alias("n_drafts"))


@query(f"WITH {OUTCOMES} SELECT event_id, draft_id, outcome FROM outcomes WHERE event_id < 900 ORDER BY event_id DESC LIMIT 25")
def ledger_audit_page(spark, d):
    return L.audit_page(L.outcomes(L.of(spark, d)).select("event_id", "draft_id", "outcome"), 25, 900)


PAGE = "SELECT draft_id, status, {0} AS created_at FROM drafts WHERE {1} ORDER BY drafts.created_at DESC, draft_id DESC LIMIT {2}"


@query(f"WITH {DRAFTS} {PAGE.format(_ISO.format('drafts.created_at'), 'true', 26)}")
def queue_page_1(spark, d):
    return L.queue_page(L.drafts(L.of(spark, d)), 25).select("draft_id", "status", L.rfc3339(F.col("created_at")).alias("created_at"))


@query(f"WITH {DRAFTS} {PAGE.format(_ISO.format('drafts.created_at'), '''(drafts.created_at, draft_id) < (TIMESTAMP '2024-01-01 06:00:00', 50)''', 26)}")
def queue_page_2(spark, d):
    return L.queue_page(L.drafts(L.of(spark, d)), 25, ("2024-01-01 06:00:00", 50)).select("draft_id", "status", L.rfc3339(F.col("created_at")).alias("created_at"))


@query(f"WITH {DRAFTS} SELECT view, count(*) AS n FROM (SELECT CASE WHEN sent_at IS NOT NULL THEN 'simulated' ELSE status END AS view FROM drafts) GROUP BY 1")
def status_views(spark, d):
    """How many drafts each view of the queue shows, from one fold of the log."""
    return L.drafts(L.of(spark, d)).groupBy(L.view_of().alias("view")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {OUTCOMES}, states AS (SELECT draft_id, ts, max(event_id) AS event_id, arg_max(revision, event_id) AS revision, arg_max(status, event_id) AS status FROM outcomes GROUP BY 1, 2),
asked AS (SELECT draft_id, event_id AS request, ts + INTERVAL 30 MINUTE AS ts FROM outcomes WHERE action = 'simulate' UNION ALL SELECT draft_id, -draft_id, TIMESTAMP '2000-01-01' FROM outcomes GROUP BY draft_id)
SELECT a.draft_id, request, revision, status FROM asked a ASOF LEFT JOIN states s ON a.draft_id = s.draft_id AND a.ts >= s.ts"""
)
def revision_in_force(spark, d):
    """The revision and status that a draft had half an hour after each simulation was asked for, and before anything was done to it."""
    rows = L.outcomes(L.of(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    states = rows.select("draft_id", "ts", "event_id", "revision", "status")
    asked = rows.where("action = 'simulate'").select("draft_id", F.col("event_id").alias("request"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("ts"))
    early = rows.select("draft_id").distinct().select("draft_id", (-F.col("draft_id")).alias("request"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    return as_of(asked.unionByName(early), states, "draft_id", "ts", ["revision", "status"], tie="event_id").select("draft_id", "request", "revision", "status")


@query(
    f"""WITH {DRAFTS}, named AS (SELECT draft_id, '["' || {_ISO.format('created_at')} || '","' || draft_id || '"]' AS plain FROM drafts)
SELECT draft_id, rtrim(translate(base64(plain::BLOB), '+/', '-_'), '=') AS cursor, plain AS decoded FROM named"""
)
def cursor_codec(spark, d):
    rows = L.drafts(L.of(spark, d)).select("draft_id", L.cursor(F.col("created_at"), F.col("draft_id")).alias("cursor"))
    back = L.decoded(F.col("cursor"))
    return rows.withColumn("back", back).select("draft_id", "cursor", F.concat(F.lit('["'), "back.at", F.lit('","'), "back.id", F.lit('"]')).alias("decoded"))


@query(f"SELECT event_id, {_ISO.format('ts')} AS stamp FROM events")
def rfc3339(spark, d):
    return L.of(spark, d).select("event_id", L.rfc3339(F.col("ts")).alias("stamp"))


@query(f"WITH {DRAFTS} SELECT status, coalesce(approved_revision = revision AND approved_sha = sha, false) AS stamp_valid, count(*) AS n FROM drafts GROUP BY ALL")
def approval_stamps(spark, d):
    valid = F.coalesce((F.col("approved_revision") == F.col("revision")) & (F.col("approved_sha") == F.col("sha")), F.lit(False))
    return L.drafts(L.of(spark, d)).groupBy("status", valid.alias("stamp_valid")).agg(F.count("*").alias("n"))


SNAPSHOTS = OUTCOMES + """,
snapshots AS (SELECT draft_id, revision, min(sha) AS sha, count(*) AS n FROM (SELECT draft_id, revision, state_sha AS sha FROM outcomes WHERE outcome IN ('edited', 'approval_revoked') UNION ALL SELECT draft_id, 1, sha FROM log WHERE rn = 1) GROUP BY 1, 2)"""


@query(f"WITH {SNAPSHOTS} SELECT draft_id, revision, sha, n FROM snapshots")
def ledger_snapshots(spark, d):
    """Revisions are written once: n is 1."""
    return L.snapshots(L.outcomes(L.of(spark, d)))


@query(f"WITH {SNAPSHOTS} SELECT o.draft_id, event_id, o.revision, s.sha, s.sha = state_sha AS untouched FROM outcomes o JOIN snapshots s ON s.draft_id = o.draft_id AND s.revision = o.revision WHERE outcome = 'status:approved'")
def approved_snapshots(spark, d):
    """The snapshot of each approved revision, and whether the content is still the one that the revision began with."""
    rows = L.outcomes(L.of(spark, d))
    found = L.snapshots(rows).select("draft_id", "revision", F.col("sha").alias("kept"))
    approved = rows.where("outcome = 'status:approved'").select("draft_id", "event_id", "revision", "state_sha").join(found, ["draft_id", "revision"])
    return approved.select("draft_id", "event_id", "revision", F.col("kept").alias("sha"), (F.col("kept") == F.col("state_sha")).alias("untouched"))


@query(
    f"""WITH {OUTCOMES}, asked AS (SELECT *, event_id % 6 AS expected_revision, CASE event_id % 4 WHEN 0 THEN upper(state_sha) WHEN 1 THEN sha ELSE state_sha END AS expected_sha FROM outcomes)
SELECT draft_id, event_id, CASE WHEN expected_revision < 1 OR NOT regexp_matches(expected_sha, '^[0-9a-f]{{64}}$') THEN 'invalid' WHEN revision <> expected_revision OR state_sha <> expected_sha THEN 'changed' ELSE 'ok' END AS verdict FROM asked"""
)
def snapshot_check(spark, d):
    """Whether the snapshot that a page was made from is still the draft's."""
    k = F.col("event_id")
    sha = F.when(k % 4 == 0, F.upper("state_sha")).when(k % 4 == 1, F.col("sha")).otherwise(F.col("state_sha"))
    return L.outcomes(L.of(spark, d)).select("draft_id", "event_id", L.snapshot_verdict(F.col("revision"), F.col("state_sha"), k % 6, sha).alias("verdict"))


@query(f"WITH {DRAFTS} SELECT draft_id, status, {_ISO.format('created_at')} AS created_at, sha FROM drafts")
def drafts_listed(spark, d):
    return L.listed(L.drafts(L.of(spark, d))).select("draft_id", "status", L.rfc3339(F.col("created_at")).alias("created_at"), "sha")
