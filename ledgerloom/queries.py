"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import drift
from .plans import corpus, evidence, filings, graphs, relational, scalars, shown, streams  # noqa: F401
from .registry import ORACLE, QUERIES, query
from .session import table

__all__ = ["ORACLE", "QUERIES"]


@query()
def p4_found(spark, sf):
    return drift.schema_changes(table(spark, sf, "run_report")).select("pipeline_id", "file_name", "stage", "change_kind", "old_path", "new_path").distinct()


@query()
def p4_table(spark, sf):
    return drift.consistent_table(table(spark, sf, "run_report"))


# The leaves of the readable records, the first of each file and stage, in SQL.
_LEAVES = r"""WITH r AS (SELECT * FROM (SELECT pipeline_id, file_name, line_id, raw, regexp_extract(file_name, '_(\d{8}_\d{6})\.json$', 1) AS stamp, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.stage') END AS stage, CASE WHEN json_valid(raw) THEN json_type(raw, '$.stage') END AS kind FROM run_report WHERE pipeline_id IS NOT NULL) WHERE stamp <> '' AND kind = 'VARCHAR'),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id, file_name, stage ORDER BY line_id) AS n FROM r) WHERE n = 1),
t AS (SELECT o.pipeline_id, o.file_name, o.stage, o.stamp, j.fullkey AS k, j.type AS ty, j.value AS v FROM o, json_tree(o.raw) j),
l AS (SELECT pipeline_id, file_name, stage, stamp, replace(substr(k, 3), '"', '') AS path, CASE WHEN ty = 'VARCHAR' THEN 'string' WHEN ty = 'BOOLEAN' THEN 'boolean' WHEN ty = 'ARRAY' THEN 'array' WHEN ty IN ('NULL', 'OBJECT') THEN '' ELSE 'number' END AS kind FROM t WHERE k <> '$' AND NOT contains(k, '[') AND (ty <> 'OBJECT' OR v::VARCHAR = '{}'))"""


@query(
    _LEAVES + r""",
c AS (SELECT stage, path, kind, count(*) AS n_records, min(stamp) AS first_at FROM l GROUP BY 1, 2, 3),
b AS (SELECT stage, path, count(*) AS n_types, arg_max(kind, (n_records, kind)) AS canonical_type FROM c WHERE kind <> '' GROUP BY 1, 2)
SELECT stage, path, kind, n_records, first_at, coalesce(n_types, 0) AS n_types, canonical_type FROM c LEFT JOIN b USING (stage, path)"""
)
def p4_schema(spark, sf):
    return drift.fused_schema(table(spark, sf, "run_report"))


@query(
    _LEAVES + """,
q AS (SELECT pipeline_id, stage, file_name, lag(file_name) OVER (PARTITION BY pipeline_id, stage ORDER BY stamp, file_name) AS before FROM o),
p AS (SELECT DISTINCT pipeline_id, stage, file_name, path FROM l)
SELECT q.pipeline_id, q.file_name, q.stage, 'appears' AS move, p.path FROM q JOIN p USING (pipeline_id, stage, file_name) WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p b WHERE b.pipeline_id = q.pipeline_id AND b.stage = q.stage AND b.file_name = q.before AND b.path = p.path)
UNION ALL SELECT q.pipeline_id, q.file_name, q.stage, 'vanishes', b.path FROM q JOIN p b ON b.pipeline_id = q.pipeline_id AND b.stage = q.stage AND b.file_name = q.before WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pipeline_id = q.pipeline_id AND p.stage = q.stage AND p.file_name = q.file_name AND p.path = b.path)"""
)
def p4_path_moves(spark, sf):
    """The paths that appear and vanish by the changes of p4_found, a renamed one doing both."""
    c = drift.schema_changes(table(spark, sf, "run_report"))
    come = c.where("change_kind IN ('added', 'renamed')").select("pipeline_id", "file_name", "stage", F.lit("appears").alias("move"), F.col("new_path").alias("path"))
    return come.unionByName(c.where("change_kind IN ('removed', 'renamed')").select("pipeline_id", "file_name", "stage", F.lit("vanishes").alias("move"), F.col("old_path").alias("path")))
