"""Registered queries on blocks with places, derived from line items, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regions
from .corpus import table

#: A document per order, a block per line; every fourth document is a sheet.
_BLOCKS = """
SELECT doc_id, block, k, text, sheet, method, page, x0, c,
  cast(sum(10 + s % 5 * 10) OVER (PARTITION BY doc_id ORDER BY block) AS bigint) AS top,
  cast(sum(CASE WHEN s % 6 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block) AS bigint) AS r
FROM (SELECT l_orderkey AS doc_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS int) AS block, l_suppkey AS s, l_partkey % 7 AS k,
  CASE l_partkey % 7 WHEN 0 THEN concat('Shipper: S', cast(l_suppkey AS varchar(9))) WHEN 1 THEN 'CONSIGNEE' WHEN 2 THEN '12 Jalan Api' WHEN 3 THEN 'Destination port: X' WHEN 4 THEN 'Port of Discharge: Y' WHEN 5 THEN concat('kept ', l_returnflag) ELSE '7 Old Mill Road' END AS text,
  l_orderkey % 4 = 0 AS sheet, CASE WHEN l_suppkey % 13 = 0 THEN 'ocr' ELSE 'native' END AS method, CASE WHEN l_suppkey % 17 = 0 THEN 2 ELSE 1 END AS page,
  CASE WHEN l_partkey % 11 = 0 THEN 180 WHEN l_partkey % 5 = 0 THEN 56 WHEN l_partkey % 3 = 0 THEN 54 ELSE 50 END AS x0,
  l_partkey % 3 AS c
FROM lineitem) AS lines
"""


def _blocks(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    rows = spark.sql(_BLOCKS)
    place = F.struct(
        F.when(F.col("sheet"), "xlsx").otherwise("pdf").alias("kind"), F.when(~F.col("sheet"), F.col("page")).alias("page"),
        *(F.when(~F.col("sheet"), x).cast("double").alias(n) for n, x in (("x0", F.col("x0")), ("top", F.col("top")), ("x1", F.col("x0") + 100), ("bottom", F.col("top") + 10))),
        F.when(F.col("sheet"), "S").alias("sheet"), F.when(F.col("sheet"), F.concat(F.chr(65 + F.col("c")), F.col("r").cast("string"))).alias("cell"),
    )
    return rows.select("doc_id", "block", "text", "method", F.array(place).cast(f"array<{regions.LOCATION}>").alias("locations"))


def _selections(blocks: DataFrame) -> DataFrame:
    """Two a document: the second and third block as shipper, the first as port of discharge."""
    doc = blocks.groupBy("doc_id").agg(F.max("block").alias("last"))
    party = F.struct(F.lit("shipper").alias("field"), F.filter(F.array(F.lit(2), F.lit(3)), lambda x: x <= F.col("last")).alias("blocks"))
    port = F.struct(F.lit("port_of_discharge").alias("field"), F.array(F.lit(1)).alias("blocks"))
    return doc.select("doc_id", F.inline(F.array(party, port)))


def party_regions(spark, sf_dir):
    return regions.party_regions(_blocks(spark, sf_dir))


def party_completions(spark, sf_dir):
    """The second block of every document chosen, as shipper or as number of containers."""
    blocks = _blocks(spark, sf_dir)
    field = F.when(F.col("doc_id") % 3 == 0, "container_count").otherwise("shipper")
    choices = blocks.groupBy("doc_id").agg(F.max(F.when(F.col("block") == 2, F.col("block"))).alias("block")).withColumn("field", field)
    out = regions.complete_selections(regions.party_regions(blocks), choices)
    return out.select("doc_id", "field", F.array_join("blocks", ",").alias("blocks"))


def selection_issues(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return regions.selection_issues(blocks, _selections(blocks))


_REGIONS = f"""WITH b AS ({_BLOCKS}),
a AS (SELECT *, max(CASE WHEN k IN (0, 1) THEN block END) OVER (PARTITION BY doc_id ORDER BY block) AS anchor FROM b),
w AS (SELECT *, lag(top + 10) OVER g AS bottom, lag(method) OVER g AS method_before, lag(page) OVER g AS page_before, first_value(x0) OVER g AS left_edge,
    max(r) OVER p AS rows_end, min(c) OVER p AS cols_from, max(c) OVER p AS cols_to
  FROM a WINDOW g AS (PARTITION BY doc_id, anchor ORDER BY block), p AS (PARTITION BY doc_id, anchor ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CASE WHEN block = anchor THEN true WHEN anchor IS NULL OR k IN (0, 1, 3, 4) OR method <> method_before THEN false
    WHEN sheet THEN r = rows_end + 1 AND c BETWEEN cols_from AND cols_to
    ELSE page = page_before AND (top - bottom <= 20 OR (top - bottom <= 30 AND k IN (2, 6) AND abs(x0 - left_edge) <= 5)) AND x0 BETWEEN left_edge - 2 AND left_edge + 102 END AS member FROM w),
h AS (SELECT doc_id, block, k, CASE WHEN bool_and(member) OVER (PARTITION BY doc_id, anchor ORDER BY block) THEN anchor ELSE block END AS region FROM m),
reg AS (SELECT *, count(*) OVER (PARTITION BY doc_id, region) AS n FROM h)
"""

ORACLES = {
    "party_regions": _REGIONS + "SELECT doc_id, block, region, n FROM reg",
    "party_completions": _REGIONS + """, d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'container_count' ELSE 'shipper' END AS field, max(CASE WHEN block = 2 THEN region END) AS region, max(block) AS last FROM reg GROUP BY doc_id)
SELECT d.doc_id, field, CASE WHEN last < 2 THEN '' WHEN field = 'container_count' THEN '2' ELSE (SELECT string_agg(block, ',' ORDER BY block) FROM reg WHERE reg.doc_id = d.doc_id AND reg.region = d.region) END AS blocks FROM d""",
    "selection_issues": _REGIONS + """, t AS (SELECT doc_id, region, any_value(n) AS n, count(*) FILTER (block IN (2, 3)) AS chosen FROM reg GROUP BY ALL),
p AS (SELECT doc_id, bool_or(chosen BETWEEN 1 AND n - 1) AS part FROM t GROUP BY doc_id),
q AS (SELECT doc_id, bool_or(block = 1 AND k = 3) AND bool_or(block > 1 AND k = 4) AS review FROM b GROUP BY doc_id)
SELECT doc_id, 'shipper' AS field, CASE WHEN part THEN 'incomplete_party_evidence' END AS issue FROM p
UNION ALL SELECT doc_id, 'port_of_discharge', CASE WHEN review THEN 'destination_port_requires_review' END FROM q""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
