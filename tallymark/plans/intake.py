"""Registered queries on what comes in, derived from pages and orders, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake
from .corpus import table

_MOST = 900
#: Each page as a file; some empty, some without a suffix or with one that nothing reads.
_FILES = "SELECT page_id, concat('inbox/v1.2/', CASE page_id % 9 WHEN 0 THEN 'scan.PDF' WHEN 1 THEN 'a.b.txt' WHEN 2 THEN 'README' WHEN 3 THEN 'x.exe' WHEN 4 THEN 'list.xlsx' WHEN 5 THEN '.pdf' WHEN 6 THEN 'p.jpeg' WHEN 7 THEN 'n.docx' ELSE 'q.' END) AS filename, CASE WHEN page_id % 13 = 0 THEN 0 ELSE length(html) END AS length FROM pages"


def document_dispatch(spark, sf_dir):
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return intake.dispatch(spark.sql(_FILES).withColumn("length", F.col("length").cast("long")), most_bytes=_MOST).select("page_id", "reader", "issue")


def import_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    error = F.when(F.col("o_orderkey") % 6 == 0, "invalid_json")
    missing = F.when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("a.pdf"), F.lit("b.pdf"))).when(F.col("o_orderkey") % 4 == 2, F.array(F.lit("c.pdf")))
    return intake.preview(rows.select(error.alias("error"), missing.alias("missing")))


def tenant_documents(spark, sf_dir):
    """Customers ask for the orders of their neighbours as well as their own."""
    orders = table(spark, sf_dir, "orders")
    documents = orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("workspace_id"))
    requests = orders.select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") + F.col("o_orderkey") % 3 % 2).alias("workspace_id"))
    return intake.of_tenant(documents, requests.unionByName(requests.select((-F.col("document_id") - 1).alias("document_id"), "workspace_id")))


def group_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", intake.group_id(F.lit("evaluation"), F.col("n_name")).alias("group_id"))


_HEX = "sha256(concat('evaluation', chr(10), n_name))"
ORACLES = {
    "document_dispatch": f"""WITH f AS ({_FILES}) SELECT page_id, CASE WHEN length > 0 AND length <= {_MOST} THEN CASE page_id % 9 WHEN 0 THEN 'pdf' WHEN 1 THEN 'text' WHEN 4 THEN 'sheet' WHEN 6 THEN 'image' WHEN 7 THEN 'word' END END AS reader,
  CASE WHEN coalesce(length, 0) = 0 THEN 'empty_document' WHEN length > {_MOST} THEN concat('document_size_limit_exceeded:', length, '>{_MOST}') WHEN page_id % 9 IN (2, 5, 8) THEN 'unsupported_document_type:none' WHEN page_id % 9 = 3 THEN 'unsupported_document_type:.exe' END AS issue FROM f""",
    "import_preview": "SELECT count(*) FILTER (o_orderkey % 6 <> 0) AS valid, count(*) FILTER (o_orderkey % 6 = 0) AS invalid, CAST(sum(CASE o_orderkey % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS missing_files FROM orders",
    "tenant_documents": "SELECT o_orderkey AS document_id, o_custkey + o_orderkey % 3 % 2 AS workspace_id, o_orderkey % 3 <> 1 AS found FROM orders UNION ALL SELECT -o_orderkey - 1, o_custkey + o_orderkey % 3 % 2, false FROM orders",
    "group_ids": f"SELECT n_nationkey, concat_ws('-', substr({_HEX}, 1, 8), substr({_HEX}, 9, 4), substr({_HEX}, 13, 4), substr({_HEX}, 17, 4), substr({_HEX}, 21, 12)) AS group_id FROM nation",
}
QUERIES = {name: globals()[name] for name in ORACLES}
