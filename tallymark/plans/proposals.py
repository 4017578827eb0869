"""Registered queries on proposals, mail sections, numbers and layout, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import mail
from ..functions.numbers import numeric_candidates as _numeric_candidates
from ..operators import compare, layout, proposals, references
from ..streaming import replay_actions
from .corpus import sql_with, table, view
from .queries import _EMAILS, _ORDINAL, _READ, _SETS, _emails, _findings


def _fields():
    return F.array(*(F.lit(x) for x in L.FIELDS))


def _when(remainder: str, value: str):
    return F.expr(f"CASE WHEN {remainder} THEN {value} END")


def role_choice(spark, sf_dir):
    rows = view(spark, sf_dir, "c1")
    role = F.when(F.col("case_id") % 2 == 0, "SI").otherwise("BL")
    return rows.select("case_id", proposals.role_of(role, F.col("confidence_pct") / 100, _when("case_id % 31 = 0", "'BL'")).alias("role"))


def cascade_steps(spark, sf_dir):
    n = F.col("case_id") % 6
    step = proposals.cascade_step(F.col("accepted"), F.col("suggested"), n, _when("case_id % 3 = 0", "suggested"), _when("case_id % 4 <> 0", "case_id % 6"), F.col("case_id") % 11 == 0)
    return _emails(spark, sf_dir).select("case_id", step.alias("step"))


def combined_readings(spark, sf_dir):
    """The draft's readings first, the instruction's as those of a second reader; the seven of a case in one row."""
    both = proposals.combine_readers(F.col("bl_value"), F.col("bl_issue"), F.col("si_value"), F.col("si_issue"))
    rows = _findings(spark, sf_dir).select("case_id", "field", both.alias("r")).select("case_id", "field", "r.*")
    return compare.in_one_row(rows, "normalized", "issue", "reader")


def selected_readings(spark, sf_dir):
    status = F.expr("CASE WHEN case_id % 10 = 0 THEN 'missing' WHEN case_id % 9 = 0 THEN 'uncertain' ELSE 'present' END")
    rows = _findings(spark, sf_dir).select("case_id", "field", proposals.selected_reading(status, F.col("bl_value"), F.col("bl_issue")).alias("r"))
    return rows.groupBy("field", F.coalesce("r.issue", F.lit("none")).alias("issue")).agg(F.count("*").alias("n"), F.count("r.normalized").alias("n_values"))


def selection_checks(spark, sf_dir):
    ids = F.collect_list(F.when(F.col("l_linenumber") > 1, F.col("l_partkey") % 25).cast("int"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(ids.alias("ids"))
    status = F.when(F.col("case_id") % 5 == 0, "missing").otherwise("present")
    return rows.select("case_id", proposals.selection_error(status, F.col("ids"), F.sequence(F.lit(0), F.lit(23))).alias("error"))


def extraction_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.get(_fields(), F.col("l_linenumber").cast("int") - 1).alias("field"), (F.col("l_suppkey") % 30).alias("selected"), (F.col("l_partkey") % 103 / 100).alias("confidence"))
    return proposals.extraction_errors(rows, known=F.col("selected") != 0)


def pair_verdicts(spark, sf_dir):
    found = references.shared_tokens(view(spark, sf_dir, "c4")).groupBy("case_id").agg(F.sort_array(F.collect_list("token")).alias("offered"))
    rows = found.withColumn("selected", F.expr("CASE WHEN case_id % 6 = 0 THEN 'NONE' WHEN case_id % 17 = 0 THEN 'OTHER' ELSE offered[0] END"))
    weights = F.expr("map_from_entries(transform(array_append(offered, 'NONE'), x -> struct(x, CASE WHEN x <> selected THEN 0.04D / size(offered) WHEN case_id % 8 = 0 THEN 0.5D ELSE 0.96D END)))")
    current = F.expr("CASE WHEN case_id % 13 = 0 THEN array('X') ELSE offered END")
    return rows.select("case_id", proposals.pair_verdict(F.col("selected"), F.expr("case_id * 37 % 100 / 100D"), weights, F.col("offered"), current).alias("verdict"))


def stage_reuse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    inputs = docs.select("doc_id", F.md5("text").alias("fingerprint"), F.lit("v2").alias("version"))
    saved = docs.where("doc_id % 3 <> 0").select("doc_id", F.expr("md5(CASE WHEN doc_id % 5 = 0 THEN concat(text, 'x') ELSE text END)").alias("fingerprint"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'v1' ELSE 'v2' END").alias("version"))
    return proposals.mark_reusable(inputs, saved, ["doc_id", "fingerprint", "version"]).select("doc_id", "reused")


def late_results(spark, sf_dir):
    log = view(spark, sf_dir, "c11")
    actions = log.select("case_id", F.col("seq").cast("long").alias("seq"), "kind", F.when(F.col("stale"), F.lit(-1)).cast("long").alias("expected_revision"))
    current = replay_actions(actions).groupBy("case_id").agg(F.max("input_revision").alias("current_revision"))
    active = log.groupBy("case_id").agg(F.when(F.col("case_id") % 2 == 1, F.max("event_id")).alias("active_run"))
    results = log.select("case_id", F.col("event_id").alias("run_id"), (F.col("event_id") % 3 + 1).alias("input_revision"))
    return proposals.fence_results(results, current.join(active, "case_id")).select("run_id", "state")


def mail_sections(spark, sf_dir):
    body = F.expr(r"""concat(CASE WHEN doc_id % 2 = 0 THEN 'WARNING: This email originated outside.\n\n' ELSE '' END, coalesce(text, ''),
      CASE WHEN doc_id % 3 = 0 THEN '\nBest regards,\nTel: 1\n' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN '\n-----Original Message-----\nFrom: a\nSent: b\nSubject: c\n\nold' ELSE '' END)""")
    rows = table(spark, sf_dir, "documents").select("doc_id", body.alias("body")).select("doc_id", "body", mail.sections(F.col("body")).alias("s"))
    whole = F.concat(*(F.col(f"s.{x}") for x in mail.SECTIONS)) == F.col("body")
    return rows.select("doc_id", *(F.char_length(f"s.{x}").cast("long").alias(x) for x in mail.SECTIONS), whole.alias("lossless"))


def numeric_candidates(spark, sf_dir):
    order = F.array_position(_fields(), F.col("field"))
    blocks = view(spark, sf_dir, "b").select("case_id", "role", order.alias("block"), F.lit("native").alias("method"), "text")
    return _numeric_candidates(blocks, keys=["case_id", "role"])


def _words(spark, sf_dir):
    """Texts are dealt by id, so their words lie together."""
    texts = table(spark, sf_dir, "documents").where("text is not null").groupBy("doc_id").agg(F.collect_list("text").alias("texts")).select("doc_id", F.explode("texts").alias("text"))
    words = texts.select("doc_id", F.posexplode(F.split("text", r"[\x20\x09-\x0D]+", -1)).alias("pos", "text")).where("text <> ''")
    at, column = F.floor(F.col("pos") % 400 / 10), F.col("pos") % 10
    top = at * 12 + F.col("pos") % 4 + F.floor(at / 5) * 20
    x0 = column * 60.0
    return words.select("doc_id", F.floor(F.col("pos") / 400).cast("int").alias("page"), "text", x0.alias("x0"), (x0 + F.when(F.col("pos") % 7 == 0, 60).otherwise(50)).alias("x1"), top.cast("double").alias("top"), (top + 9.0).alias("bottom"), F.concat(F.lit("f"), F.col("pos") % 3).alias("font"))


def pdf_blocks(spark, sf_dir):
    """Words of documents set ten to a line, forty lines to a page."""
    return layout.pdf_blocks(layout.pdf_lines(_words(spark, sf_dir), together=True)).select("doc_id", "page", "block", "x0", "top", "x1", "bottom", F.md5("text").alias("text_md5"))


def word_blocks(spark, sf_dir):
    """Lines of documents as paragraphs, every seventh a table row."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("item", "text"))
    kind = F.expr("CASE WHEN item % 7 = 6 THEN 'table' WHEN item % 11 = 10 THEN 'boundary' ELSE 'paragraph' END")
    return layout.word_blocks(lines.withColumn("kind", kind)).select("doc_id", "first_item", "last_item", F.md5("text").alias("text_md5"))


_TOKENS = _SETS + ", t AS (SELECT case_id, role, unnest([shipment, booking, oc]) AS token FROM ids), c AS (SELECT case_id, token FROM t WHERE token <> '' GROUP BY 1, 2 HAVING count(DISTINCT role) = 2), cases AS (SELECT DISTINCT case_id FROM c)"
_SOUND = "{0}_value IS NOT NULL AND {0}_issue IS NULL"
_BL, _SI = _SOUND.format("bl"), _SOUND.format("si")

ORACLES: dict[str, str] = {
    "role_choice": sql_with("c1") + " SELECT case_id, CASE WHEN case_id % 31 = 0 THEN 'BL' WHEN confidence_pct >= 80 THEN CASE WHEN case_id % 2 = 0 THEN 'SI' ELSE 'BL' END ELSE 'UNKNOWN' END AS role FROM c1",
    "cascade_steps": _EMAILS + "SELECT case_id, CASE WHEN case_id % 6 = 0 OR coalesce(accepted IS NOT NULL AND suggested <> 'GENERAL', false) THEN 'text' WHEN case_id % 3 = 0 THEN 'names' WHEN case_id % 4 = 0 THEN 'text' WHEN case_id % 6 <= 4 AND case_id % 11 <> 0 THEN 'previews' ELSE 'names' END AS step FROM e",
    "combined_readings": _READ + f", m AS (SELECT case_id, field, CASE WHEN {_BL} THEN bl_value WHEN {_SI} THEN si_value ELSE bl_value END AS normalized, CASE WHEN {_BL} THEN CASE WHEN {_SI} AND bl_value <> si_value THEN 'provider_disagreement' END WHEN {_SI} THEN NULL ELSE bl_issue END AS issue, CASE WHEN NOT ({_BL}) AND {_SI} THEN 'second' ELSE 'first' END AS reader FROM findings) SELECT case_id, " + ", ".join(f"string_agg(coalesce({x}, '-'), '|' ORDER BY {_ORDINAL}) AS {x}" for x in ("normalized", "issue", "reader")) + " FROM m GROUP BY case_id",
    "selected_readings": _READ + "SELECT field, coalesce(CASE WHEN case_id % 10 = 0 THEN 'missing_value' WHEN case_id % 9 = 0 THEN 'model_uncertain' ELSE bl_issue END, 'none') AS issue, count(*) AS n, count(CASE WHEN case_id % 10 <> 0 AND case_id % 9 <> 0 THEN bl_value END) AS n_values FROM findings GROUP BY 1, 2",
    "selection_checks": "WITH x AS (SELECT l_orderkey AS case_id, CASE WHEN l_linenumber > 1 THEN l_partkey % 25 END AS id FROM lineitem) SELECT case_id, CASE WHEN count(DISTINCT id) < count(id) THEN 'repeated_source' WHEN max(id) = 24 THEN 'unknown_source' WHEN case_id % 5 <> 0 AND count(id) = 0 THEN 'no_source' END AS error FROM x GROUP BY case_id",
    "extraction_checks": "SELECT l_orderkey AS document, CASE WHEN count(*) <> 7 OR count(DISTINCT l_linenumber) <> 7 OR max(l_linenumber) > 7 THEN 'fields' WHEN bool_or(l_suppkey % 30 = 0) THEN 'reference' WHEN bool_or(l_partkey % 103 > 100) THEN 'confidence' END AS error FROM lineitem GROUP BY 1",
    "pair_verdicts": _TOKENS + " SELECT case_id, CASE WHEN case_id % 6 <> 0 AND case_id % 17 = 0 THEN 'unknown_reference' WHEN case_id % 8 = 0 THEN 'bad_distribution' WHEN case_id % 6 = 0 OR case_id * 37 % 100 < 95 THEN 'unsure' WHEN case_id % 13 = 0 THEN 'stale' ELSE 'accepted' END AS verdict FROM cases",
    "stage_reuse": "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND text IS NOT NULL AS reused FROM documents",
    "late_results": sql_with("c11") + ", s AS (SELECT case_id, 1 + count(*) FILTER (NOT stale AND kind IN ('category', 'not_spam')) AS current, max(event_id) AS last FROM c11 GROUP BY 1) SELECT event_id AS run_id, CASE WHEN event_id % 3 + 1 = current AND (case_id % 2 <> 1 OR event_id = last) THEN 'published' ELSE 'superseded' END AS state FROM c11 JOIN s USING (case_id)",
    "mail_sections": r"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, length(t) AS n, doc_id % 3 = 0 AND regexp_matches(t, '\S') AS signed FROM d) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 41 ELSE 0 END AS automatic_notice, n + CASE WHEN signed THEN 1 ELSE CASE WHEN doc_id % 3 = 0 THEN 22 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END END AS current_message, CASE WHEN signed THEN 21 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END ELSE 0 END AS signature, CASE WHEN doc_id % 5 = 0 THEN 58 ELSE 0 END AS quoted_history, true AS lossless FROM f",
}

QUERIES = {name: f for name, f in list(globals().items()) if name in ORACLES or name in ("numeric_candidates", "pdf_blocks", "word_blocks")}
