"""The property graph that the plans query: node tables with one key each, typed edge tables (src, dst, properties), and their union.

``Graph`` projects the driver's tables onto the model; ``WITH`` is the same projection in SQL. Only the columns that a plan selects are
read, and filters reach the scans, for each table is a plain projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

WITH = """
WITH g_company AS (SELECT 'C' || c_custkey AS ticker, c_name AS name, c_mktsegment AS sector FROM customer),
g_filing AS (SELECT 'F' || o_orderkey AS id, o_orderpriority AS form_type, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
  'Q' || quarter(o_orderdate) AS fiscal_period, CAST(o_orderdate AS DATE) AS filing_date FROM orders),
g_submitted AS (SELECT 'C' || o_custkey AS src, 'F' || o_orderkey AS dst FROM orders),
g_metric AS (SELECT 'M' || p_partkey AS id, p_type AS canonical_name, p_brand AS statement_category, p_name AS reported_label FROM part),
g_reports AS (SELECT 'F' || l_orderkey AS src, 'M' || l_partkey AS dst, l_extendedprice AS value, l_returnflag AS currency, l_linenumber AS seq FROM lineitem),
g_segment AS (SELECT 'S' || n_nationkey AS id, n_name AS name, r_name AS segment_type FROM nation JOIN region ON n_regionkey = r_regionkey),
g_has_segment AS (SELECT 'M' || l_partkey AS src, 'S' || s_nationkey AS dst, sum(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
g_event AS (SELECT 'E' || event_id AS id, event_type AS item_code, value, user_id, ts FROM events),
g_entity AS (SELECT 'R' || r_regionkey AS id, r_name AS name, 'Region' AS entity_type FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'Nation' FROM nation
  UNION ALL SELECT 'P' || s_suppkey, s_name, 'Supplier' FROM supplier
  UNION ALL SELECT 'C' || c_custkey, c_name, 'Customer' FROM customer),
g_connects AS (SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'in_region' AS rel FROM nation
  UNION ALL SELECT 'P' || s_suppkey, 'N' || s_nationkey, 'based_in' FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'served_in' FROM customer),
g_edge AS (SELECT src, dst, 'SUBMITTED' AS rel FROM g_submitted UNION ALL SELECT src, dst, 'REPORTS_METRIC' FROM g_reports
  UNION ALL SELECT src, dst, 'HAS_SEGMENT' FROM g_has_segment)
"""


class Graph:
    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name)

    @staticmethod
    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    @property
    def company(self) -> DataFrame:
        return self.raw("customer").select(self.key("C", "c_custkey").alias("ticker"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"))

    @property
    def filing(self) -> DataFrame:
        return self.raw("orders").select(
            self.key("F", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("form_type"), F.year("o_orderdate").alias("fiscal_year"),
            F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("fiscal_period"), F.to_date("o_orderdate").alias("filing_date"),
        )

    @property
    def submitted(self) -> DataFrame:
        return self.raw("orders").select(self.key("C", "o_custkey").alias("src"), self.key("F", "o_orderkey").alias("dst"))

    @property
    def metric(self) -> DataFrame:
        return self.raw("part").select(self.key("M", "p_partkey").alias("id"), F.col("p_type").alias("canonical_name"), F.col("p_brand").alias("statement_category"), F.col("p_name").alias("reported_label"))

    @property
    def reports(self) -> DataFrame:
        return self.raw("lineitem").select(self.key("F", "l_orderkey").alias("src"), self.key("M", "l_partkey").alias("dst"), F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("currency"), F.col("l_linenumber").alias("seq"))

    @property
    def segment(self) -> DataFrame:
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(self.key("S", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("segment_type"))

    @property
    def has_segment(self) -> DataFrame:
        lines = self.raw("lineitem").join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return lines.groupBy(self.key("M", "l_partkey").alias("src"), self.key("S", "s_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("value"))

    @property
    def event(self) -> DataFrame:
        return self.raw("events").select(self.key("E", "event_id").alias("id"), F.col("event_type").alias("item_code"), "value", "user_id", "ts")

    @property
    def entity(self) -> DataFrame:
        parts = (("region", "R", "r_regionkey", "r_name", "Region"), ("nation", "N", "n_nationkey", "n_name", "Nation"), ("supplier", "P", "s_suppkey", "s_name", "Supplier"), ("customer", "C", "c_custkey", "c_name", "Customer"))
        return reduce(DataFrame.unionByName, (self.raw(t).select(self.key(p, k).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("entity_type")) for t, p, k, n, kind in parts))

    @property
    def connects(self) -> DataFrame:
        parts = (("nation", "N", "n_nationkey", "R", "n_regionkey", "in_region"), ("supplier", "P", "s_suppkey", "N", "s_nationkey", "based_in"), ("customer", "C", "c_custkey", "N", "c_nationkey", "served_in"))
        return reduce(DataFrame.unionByName, (self.raw(t).select(self.key(p, a).alias("src"), self.key(q, b).alias("dst"), F.lit(rel).alias("rel")) for t, p, a, q, b, rel in parts))

    @property
    def edge(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (df.select("src", "dst", F.lit(rel).alias("rel")) for df, rel in ((self.submitted, "SUBMITTED"), (self.reports, "REPORTS_METRIC"), (self.has_segment, "HAS_SEGMENT"))))
