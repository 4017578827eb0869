"""Test corpora derived from the given tables; the SQL runs alike in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS: dict[str, str] = {}
_SHIP = """
WITH line AS (
  SELECT l_orderkey, count(*) AS n_lines, cast(sum(l_quantity) AS bigint)*100 AS kg, min(l_suppkey) AS suppkey FROM lineitem GROUP BY l_orderkey),
ship AS (
  SELECT o.o_orderkey AS case_id, o.o_orderkey % 20 AS k, s.s_name AS shipper, c.c_name AS party,
         sn.n_nationkey AS pol_key, sn.n_name AS pol, cn.n_nationkey AS pod_key, cn.n_name AS pod,
         ln.n_lines, ln.kg
  FROM orders o JOIN line ln ON ln.l_orderkey = o.o_orderkey
  JOIN supplier s ON s.s_suppkey = ln.suppkey JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation sn ON sn.n_nationkey = s.s_nationkey JOIN nation cn ON cn.n_nationkey = c.c_nationkey)
"""

#: Role, field and text of each row that a shipment gives.
_ROWS = [
    ('SI', 'shipper', "concat('Shipper: ', shipper)"),
    ('BL', 'shipper', "concat('Shipper/Exporter: ', shipper)"),
    ('SI', 'consignee', "concat('Consignee: ', party)"),
    ('BL', 'consignee', "CASE WHEN k = 7 THEN concat('CONSIGNEE: ', upper(party)) ELSE concat('Consignee: ', party) END"),
    ('SI', 'notify_party', "concat('Notify Party: ', party)"),
    ('BL', 'notify_party', "CASE WHEN k = 11 THEN concat('Consignee: ', party) ELSE concat('Party to Notify: ', party) END"),
    ('SI', 'port_of_loading', "concat('Port of Loading: ', pol)"),
    ('BL', 'port_of_loading', "CASE WHEN k = 8 THEN concat('POL: ', pol, ' (N', chr(cast(65 + pol_key AS int)), 'PRT)') ELSE concat('Port of Loading: ', pol) END"),
    ('SI', 'port_of_discharge', "concat('Port of Discharge: ', pod)"),
    ('BL', 'port_of_discharge', "CASE WHEN k = 2 THEN concat('POD: NATION_', cast((pod_key + 1) % 25 AS varchar(9))) ELSE concat('POD: ', pod) END"),
    ('SI', 'container_count', "concat('No. of Containers: ', cast(n_lines AS varchar(9)))"),
    ('BL', 'container_count', "CASE WHEN k = 0 THEN concat('Container Count: ', cast(n_lines + 1 AS varchar(9))) WHEN k = 12 THEN concat('Containers: ', cast(n_lines AS varchar(9)), ' x 40''HC') ELSE concat('Container Count: ', cast(n_lines AS varchar(9))) END"),
    ('SI', 'gross_weight_kg', "concat('Gross Weight (KG): ', cast(kg AS varchar(12)), ' KG')"),
    ('BL', 'gross_weight_kg', "CASE WHEN k = 1 THEN concat('Gross Weight: ', cast(kg + 1000 AS varchar(12)), ' kg') WHEN k = 3 THEN concat('Gross Wt: ', cast(cast(cast(kg AS decimal(12,0)) / 1000 AS decimal(15,3)) AS varchar(20)), ' MT') WHEN k = 4 THEN 'Gross Weight: N/A' WHEN k = 5 THEN concat('Gross Weight: ', cast(kg AS varchar(12)), ' tons') WHEN k = 6 THEN concat('Gross Weight: ', cast(kg AS varchar(12))) ELSE concat('Gross Weight: ', cast(kg AS varchar(12)), ' kg') END"),
]
VIEWS["b"] = _SHIP + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT case_id, k, '{role}' AS role, '{field}' AS field, {text} AS text FROM ship" for role, field, text in _ROWS) + ") AS raw"
#: The same rows in one pass over the shipments.
_ONE_PASS = _SHIP + "SELECT case_id, k, inline(array(" + ", ".join(f"struct('{role}' AS role, '{field}' AS field, {text} AS text)" for role, field, text in _ROWS) + ")) FROM ship"
VIEWS["c1"] = """
SELECT o_orderkey AS case_id, o_custkey % 10 AS workspace_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'BL_COMPARISON' WHEN '2-HIGH' THEN 'SI_REQUEST' WHEN '3-MEDIUM' THEN 'INVOICE_QUERY' WHEN '4-NOT SPECIFIED' THEN 'GENERAL' ELSE 'SPAM' END AS truth,
  CASE WHEN o_orderkey % 50 = 0 THEN 'GENERAL' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'BL_COMPARISON' WHEN '2-HIGH' THEN 'SI_REQUEST' WHEN '3-MEDIUM' THEN 'INVOICE_QUERY' WHEN '4-NOT SPECIFIED' THEN 'GENERAL' ELSE 'SPAM' END END AS suggested,
  cast((o_orderkey * 37) % 100 AS int) AS confidence_pct,
  CASE WHEN o_orderkey % 97 = 0 THEN 'human' ELSE 'model' END AS source,
  CASE o_orderstatus WHEN 'P' THEN 'open' WHEN 'F' THEN 'completed' ELSE 'waiting' END AS workflow,
  CASE WHEN o_orderkey % 61 = 0 THEN 'failed' WHEN o_orderkey % 67 = 0 THEN 'running' ELSE 'completed' END AS processing,
  concat('Order ', cast(o_orderkey AS varchar(12)), ' ', o_orderpriority) AS subject, o_orderdate AS received_at
FROM orders
"""
VIEWS["c2"] = """
SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 20 = 13 THEN 'ocr' ELSE 'native' END AS method,
  CASE WHEN o_orderkey % 40 = 13 THEN 79 WHEN o_orderkey % 40 = 33 THEN NULL ELSE 95 END AS ocr_pct,
  CASE WHEN o_orderkey % 20 = 14 THEN 70 ELSE 98 END AS field_pct, o_orderkey % 23 = 0 AS has_override FROM orders
"""
VIEWS["c3_name"] = """
SELECT lower(n_name) AS alias, concat('N', chr(cast(65 + n_nationkey AS int)), 'PRT') AS code FROM nation
UNION ALL SELECT 'port_shared', concat('N', chr(cast(65 + n_nationkey AS int)), 'PRT') FROM nation WHERE n_nationkey < 2
"""
VIEWS["c3_code"] = """
SELECT concat('N', chr(cast(65 + n_nationkey AS int)), 'PRT') AS code FROM nation WHERE n_nationkey < 20
"""
VIEWS["c4"] = """
SELECT o_orderkey AS case_id, 'SI' AS role, concat('Shipment ID: SHIP-', cast(100000 + o_orderkey AS varchar(12)), chr(10), 'Booking Ref: BK-', cast(200000 + o_custkey AS varchar(12))) AS text FROM orders
UNION ALL SELECT o_orderkey, 'BL', CASE WHEN o_orderkey % 20 = 9 THEN concat('Shipment ID: SHIP-', cast(900000 + o_orderkey AS varchar(12)), chr(10), 'Booking No. BK-', cast(200000 + o_custkey AS varchar(12)))
  WHEN o_orderkey % 20 = 10 THEN 'Draft Bill of Lading' WHEN o_orderkey % 20 = 15 THEN concat('OC No.: SHIP-', cast(100000 + o_orderkey AS varchar(12)))
  ELSE concat('Shipment Reference: SHIP-', cast(100000 + o_orderkey AS varchar(12)), chr(10), 'Booking No. BK-', cast(200000 + o_custkey AS varchar(12))) END FROM orders
"""
VIEWS["c7"] = """
SELECT p_brand AS sheet, cast(p_partkey AS int) + 1 AS row_no, 'A' AS col, p_name AS value, false AS uncertain FROM part
UNION ALL SELECT p_brand, cast(p_partkey AS int) + 1, 'B', cast(p_size AS varchar(9)), p_partkey % 11 = 0 FROM part WHERE p_partkey % 5 <> 0
"""
VIEWS["c9"] = """
SELECT event_id AS run_id, user_id AS case_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'running' ELSE 'superseded' END AS status,
  cast(event_id % 4 AS int) AS attempts, ts AS created_at, ts + INTERVAL 90 SECOND AS lease_until, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 5 SECOND END AS dispatched_at FROM events
"""
VIEWS["c10"] = """
SELECT event_id AS reservation_id, CASE WHEN user_id % 2 = 0 THEN 'demo' ELSE 'development' END AS purpose, cast(32768 AS bigint) AS amount,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id * 7 % 60000 END AS input_tokens, event_id % 500 AS output_tokens, cast('0.30' AS decimal(18,6)) AS in_rate, cast('1.20' AS decimal(18,6)) AS out_rate FROM events
"""
VIEWS["c11"] = """
SELECT event_id, user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
  CASE event_type WHEN 'click' THEN 'assign' WHEN 'error' THEN 'retry' WHEN 'purchase' THEN 'workflow' WHEN 'signup' THEN 'category' ELSE 'not_spam' END AS kind, event_id % 7 = 0 AS stale FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views."""
    sql = _ONE_PASS if name == "b" else VIEWS[name]
    for t in TABLES:
        if t in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def sql_with(*names: str) -> str:
    """The views as common table expressions for an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names).replace("\nship AS (", "\nship AS MATERIALIZED (")
