"""Registered queries on reviewers' actions derived from events, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import compare, reviews
from .corpus import table

_FIELD = "CASE {} % 7 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(L.FIELDS)) + " END"
#: A case per user, its events in order of time behind one that opens it.
_EVENTS = f"""
SELECT case_id, seq, kind, CASE WHEN seq > 0 AND event_id % 7 = 0 THEN -1 END AS expected_revision,
  CASE kind WHEN 'created' THEN CASE case_id % 4 WHEN 0 THEN 'SPAM' WHEN 1 THEN 'GENERAL' ELSE 'BL_COMPARISON' END
    WHEN 'assign' THEN CASE WHEN h < 80 THEN 'Ana' END WHEN 'workflow' THEN CASE WHEN h < 60 THEN 'waiting' ELSE 'lost' END
    WHEN 'category' THEN CASE WHEN h < 60 THEN 'BL_COMPARISON' WHEN h < 80 THEN 'GENERAL' ELSE 'SPAM' END
    WHEN 'revision' THEN concat('d', cast(event_id AS varchar(12))) WHEN 'classified' THEN 'GENERAL' WHEN 'published' THEN 'BL_COMPARISON' END AS value,
  CASE WHEN kind IN ('created', 'pair') THEN 'si' END AS si_id,
  CASE WHEN kind = 'created' THEN 'bl' WHEN kind = 'pair' THEN CASE WHEN h >= 80 THEN 'si' WHEN h >= 60 THEN 'gone' ELSE 'bl' END END AS bl_id,
  CASE kind WHEN 'correct' THEN CASE event_id % 4 WHEN 0 THEN 'bl' WHEN 1 THEN 'x' ELSE 'si' END WHEN 'revision' THEN CASE WHEN h < 60 THEN 'bl' ELSE 'gone' END END AS document_id,
  CASE WHEN kind = 'correct' THEN {_FIELD.format("event_id")} END AS field,
  CASE WHEN kind = 'created' THEN CASE WHEN case_id % 3 > 0 THEN CASE case_id % 4 WHEN 0 THEN 'SPAM' WHEN 1 THEN 'GENERAL' ELSE 'BL_COMPARISON' END END
    WHEN kind = 'published' THEN 'BL_COMPARISON' WHEN kind = 'correct' THEN concat('v', cast(event_id % 3 AS varchar(12))) END AS normalized,
  CASE WHEN kind = 'correct' AND event_id % 13 = 0 THEN 'missing_value' END AS issue,
  CASE WHEN kind = 'correct' THEN CASE WHEN event_id % 5 = 0 THEN 'old' ELSE 'f' END END AS fingerprint,
  cast(event_id % 6 AS int) AS sources, event_id % 5 = 0 AS ocr, event_id % 2 = 0 AS verified, event_id % 11 = 0 AS transcribed, event_id % 3 = 0 AS conflict,
  CASE WHEN kind <> 'pair' OR h < 40 OR h >= 60 THEN 'why' END AS reason,
  CASE WHEN kind = 'published' AND event_id % 4 = 0 OR kind = 'classified' AND event_id % 3 = 0 THEN 0 END AS run,
  CASE WHEN kind = 'created' THEN CASE WHEN case_id % 5 > 0 THEN case_id % 5 > 1 END WHEN kind = 'published' THEN event_id % 5 > 0 END AS pair_valid
FROM (SELECT *, CASE WHEN seq = 0 THEN 'created' WHEN k = 0 THEN 'assign' WHEN k = 1 THEN 'workflow' WHEN k < 4 THEN 'category' WHEN k = 4 THEN 'not_spam' WHEN k < 7 THEN 'pair'
    WHEN k < 12 THEN 'correct' WHEN k = 12 THEN 'retry' WHEN k = 13 THEN 'revision' WHEN k = 14 THEN 'classified' ELSE 'published' END AS kind
  FROM (SELECT event_id, user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id * 7919 % 100 AS h, event_id * 7919 % 20 AS k FROM events
    UNION ALL SELECT DISTINCT 0, user_id, 0, 0, 0 FROM events) AS numbered) AS named
"""
_READINGS = f"""
SELECT user_id AS case_id, role, lower(role) AS document_id, {_FIELD.format("f")} AS field, CASE WHEN (user_id + f) % 9 > 0 THEN concat('v', cast(CASE WHEN role = 'BL' AND (user_id + f) % 4 = 0 THEN 9 ELSE (user_id + f) % 3 END AS varchar(9))) END AS normalized,
  CASE WHEN (user_id + f) % 9 = 0 THEN 'missing_value' END AS issue, 'f' AS fingerprint
FROM (SELECT DISTINCT user_id FROM events) AS u CROSS JOIN (SELECT 0 AS f UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) AS fields CROSS JOIN (SELECT 'SI' AS role UNION ALL SELECT 'BL') AS roles
"""


def _events(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    opened = F.when(F.col("kind") == "created", F.array(F.lit("si"), F.lit("bl"), F.lit("x")))
    return spark.sql(_EVENTS).withColumn("documents", opened).withColumn("result_revision", F.lit(None).cast("long"))


def _readings(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_READINGS)


def review_outcomes(spark, sf_dir):
    out = reviews.replay(_events(spark, sf_dir))
    return out.select("case_id", "seq", "kind", "outcome", "error", "revision", "input_revision", "workflow", "assignee", "suggested", "accepted", "source", "processing", "stage", "si_id", "bl_id", "run", F.coalesce("report_revision", F.lit(0)).alias("report_revision"), "pair_valid")


def review_corrections(spark, sf_dir):
    return reviews.correction_history(reviews.replay(_events(spark, sf_dir)), _readings(spark, sf_dir))


def review_findings(spark, sf_dir):
    """All findings after the corrections; untouched ones are taken over."""
    readings = _readings(spark, sf_dir)
    fixes = reviews.corrections(reviews.replay(_events(spark, sf_dir)))
    out = reviews.compare_again(compare.findings(readings), readings, fixes)
    return out.select("case_id", "field", "si_value", "bl_value", "si_issue", "bl_issue", "outcome")


_FOLD = f"""WITH RECURSIVE ev AS MATERIALIZED ({_EVENTS}),
st AS (
SELECT case_id, seq, kind, 'ok' AS why, 1 AS revision, 1 AS input_revision, 'open' AS workflow, 'Unassigned' AS assignee, value AS suggested, normalized AS accepted, 'model' AS source,
  CASE WHEN pair_valid IS NULL THEN 'queued' ELSE 'completed' END AS processing, CASE WHEN pair_valid IS NULL THEN 'created' ELSE 'processed' END AS stage, si_id, bl_id, 1 AS run,
  CASE WHEN pair_valid IS NOT NULL THEN 1 END AS report_revision, pair_valid, ['si', 'bl', 'x'] AS docs, 3 AS n FROM ev WHERE seq = 0
UNION ALL
SELECT case_id, seq, kind, why, revision + CASE WHEN ok THEN 1 ELSE 0 END, input_revision + CASE WHEN ok AND kind IN ('category', 'not_spam', 'pair', 'correct', 'revision') THEN 1 ELSE 0 END,
  CASE WHEN ok AND kind = 'workflow' THEN value WHEN ok AND kind IN ('not_spam', 'revision') THEN 'open' ELSE workflow END,
  CASE WHEN ok AND kind = 'assign' THEN value ELSE assignee END,
  CASE WHEN ok AND kind IN ('classified', 'published') AND source <> 'human' THEN value ELSE suggested END,
  CASE WHEN ok AND kind = 'category' THEN value WHEN ok AND kind = 'not_spam' THEN NULL WHEN ok AND kind IN ('classified', 'published') AND source <> 'human' THEN normalized ELSE accepted END,
  CASE WHEN ok AND kind IN ('category', 'not_spam') THEN 'human' ELSE source END,
  CASE WHEN ok AND (kind IN ('pair', 'retry', 'revision') OR kind = 'category' AND value = 'BL_COMPARISON') THEN 'queued' WHEN ok AND kind IN ('category', 'not_spam', 'correct', 'published') THEN 'completed' ELSE processing END,
  CASE WHEN NOT ok THEN stage WHEN kind = 'category' THEN CASE WHEN value = 'BL_COMPARISON' THEN 'classification_accepted' ELSE 'category_changed' END WHEN kind = 'not_spam' THEN 'classification_required'
    WHEN kind = 'pair' THEN 'pair_accepted' WHEN kind = 'correct' THEN 'reading_corrected' WHEN kind = 'retry' THEN 'retry_requested' WHEN kind = 'revision' THEN 'revision_attached' WHEN kind = 'classified' THEN 'classified' WHEN kind = 'published' THEN 'processed' ELSE stage END,
  CASE WHEN ok AND kind = 'pair' THEN new_si WHEN ok AND kind = 'revision' AND si_id = document_id THEN value ELSE si_id END,
  CASE WHEN ok AND kind = 'pair' THEN new_bl WHEN ok AND kind = 'revision' AND bl_id = document_id AND si_id <> document_id THEN value ELSE bl_id END,
  run + CASE WHEN ok AND (kind IN ('pair', 'retry', 'revision') OR kind = 'category' AND value = 'BL_COMPARISON') THEN 1 ELSE 0 END,
  CASE WHEN ok AND kind IN ('category', 'pair', 'revision') THEN NULL WHEN ok AND kind = 'correct' THEN input_revision + 1 WHEN ok AND kind = 'published' THEN input_revision ELSE report_revision END,
  CASE WHEN ok AND kind IN ('category', 'pair', 'revision') THEN NULL WHEN ok AND kind = 'published' THEN new_valid ELSE pair_valid END,
  CASE WHEN ok AND kind = 'revision' THEN list_append(list_filter(docs, lambda d: d <> document_id), value) ELSE docs END, n + CASE WHEN ok AND kind = 'revision' THEN 1 ELSE 0 END
FROM (SELECT *, why = 'ok' AS ok FROM (SELECT s.* EXCLUDE (seq, kind, why), e.seq, e.kind, e.value, e.normalized, e.document_id, e.si_id AS new_si, e.bl_id AS new_bl, e.pair_valid AS new_valid,
    CASE WHEN e.kind IN ('classified', 'published') THEN CASE WHEN e.run <> s.run THEN 'superseded' ELSE 'ok' END WHEN e.expected_revision <> s.revision THEN 'conflict'
      WHEN e.kind = 'assign' AND e.value IS NULL THEN 'unknown_reviewer' WHEN e.kind = 'workflow' AND e.value = 'lost' THEN 'unknown_workflow'
      WHEN e.kind = 'not_spam' AND NOT (coalesce(accepted = 'SPAM', false) OR accepted IS NULL AND suggested = 'SPAM' AND source <> 'human') THEN 'no_spam'
      WHEN e.kind IN ('pair', 'correct', 'revision') AND accepted IS DISTINCT FROM 'BL_COMPARISON' THEN 'category_required'
      WHEN e.kind = 'pair' THEN CASE WHEN e.si_id = e.bl_id THEN 'same_document' WHEN NOT (list_contains(docs, e.si_id) AND list_contains(docs, e.bl_id) AND e.reason IS NOT NULL) THEN 'unread_or_unexplained' WHEN e.conflict THEN 'identifiers_conflict' ELSE 'ok' END
      WHEN e.kind = 'correct' THEN CASE WHEN NOT coalesce(s.pair_valid AND s.report_revision = s.input_revision, false) THEN 'no_current_comparison' WHEN NOT (list_contains(docs, s.si_id) AND list_contains(docs, s.bl_id)) THEN 'pair_changed'
        WHEN NOT list_contains(docs, e.document_id) THEN 'foreign_document' WHEN e.ocr AND NOT e.verified THEN 'unverified_ocr' WHEN e.transcribed AND NOT e.verified THEN 'unverified_transcription' WHEN e.sources = 0 THEN 'no_evidence'
        WHEN e.document_id NOT IN (s.si_id, s.bl_id) THEN 'not_in_pair' ELSE 'ok' END
      WHEN e.kind = 'revision' THEN CASE WHEN NOT list_contains(docs, e.document_id) THEN 'unknown_document' WHEN n >= 24 THEN 'too_many_versions' ELSE 'ok' END ELSE 'ok' END AS why
  FROM st s JOIN ev e ON e.case_id = s.case_id AND e.seq = s.seq + 1) AS judged) AS stepped),
fix AS (SELECT st.case_id, st.seq, e.document_id, e.field, e.normalized, e.issue, e.fingerprint, st.input_revision FROM st JOIN ev e USING (case_id, seq) WHERE st.kind = 'correct' AND why = 'ok'),
rd AS ({_READINGS})
"""

ORACLES = {
    "review_outcomes": _FOLD + "SELECT case_id, seq, kind, CASE WHEN why = 'ok' THEN 'applied' WHEN why IN ('conflict', 'superseded') THEN why ELSE 'rejected' END AS outcome, CASE WHEN why NOT IN ('ok', 'conflict', 'superseded') THEN why END AS error, revision, input_revision, workflow, assignee, suggested, accepted, source, processing, stage, si_id, bl_id, run, coalesce(report_revision, 0) AS report_revision, pair_valid FROM st",
    "review_corrections": _FOLD + "SELECT fix.case_id, seq, fix.document_id, fix.field, CASE WHEN row_number() OVER w > 1 THEN lag(fix.normalized) OVER w ELSE rd.normalized END AS before, fix.normalized AS after, input_revision FROM fix LEFT JOIN rd USING (case_id, document_id, field) WINDOW w AS (PARTITION BY fix.case_id, fix.document_id, fix.field ORDER BY seq)",
    "review_findings": _FOLD + """, last AS (SELECT * FROM fix QUALIFY row_number() OVER (PARTITION BY case_id, document_id, field ORDER BY seq DESC) = 1),
r AS (SELECT rd.case_id, rd.role, rd.field, CASE WHEN last.fingerprint = rd.fingerprint THEN last.normalized ELSE rd.normalized END AS v, CASE WHEN last.fingerprint = rd.fingerprint THEN last.issue ELSE rd.issue END AS issue FROM rd LEFT JOIN last USING (case_id, document_id, field))
SELECT s.case_id, s.field, s.v AS si_value, b.v AS bl_value, s.issue AS si_issue, b.issue AS bl_issue, CASE WHEN s.issue IS NOT NULL OR b.issue IS NOT NULL OR s.v IS NULL OR b.v IS NULL THEN 'unresolved' WHEN s.v = b.v THEN 'match' ELSE 'mismatch' END AS outcome
FROM r s JOIN r b USING (case_id, field) WHERE s.role = 'SI' AND b.role = 'BL'""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
