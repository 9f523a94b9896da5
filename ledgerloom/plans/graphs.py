"""Graph algorithms and time series over the projected graph (groups H and I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pattern, series, traversal
from ..registry import query
from .graph import WITH, Graph

_SYM = WITH.replace("WITH", "WITH RECURSIVE", 1) + ", sym AS (SELECT src, dst FROM g_connects UNION SELECT dst, src FROM g_connects) "


def _seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(_SYM + ", walk AS (SELECT 'P1' AS id, 0 AS depth UNION SELECT s.dst, depth + 1 FROM walk JOIN sym s ON s.src = walk.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM walk GROUP BY 1")
def i1_k_hop(spark, sf):
    return traversal.k_hop(Graph(spark, sf).connects, _seeds(spark, "P1"), 2)


@query(_SYM + ", d1 AS (SELECT DISTINCT dst AS id FROM sym WHERE src = 'P1'), d2 AS (SELECT dst AS id FROM d1 JOIN sym ON src = id), d3 AS (SELECT dst AS id FROM d2 JOIN sym ON src = id) SELECT id, min(depth) AS depth FROM (SELECT 'P1' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2 UNION ALL SELECT id, 2 FROM d3) GROUP BY 1")
def i2_ring_neighbourhood(spark, sf):
    return traversal.ring_neighbourhood(Graph(spark, sf).connects, _seeds(spark, "P1"), 2)


@query(WITH + "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, rel FROM g_connects")
def i3_unordered_pairs(spark, sf):
    e = pattern.unordered_first(pattern.symmetric(Graph(spark, sf).connects).withColumn("seq", F.lit(0)), "seq")
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel")


@query(WITH + ", e AS (SELECT DISTINCT src, dst FROM g_connects) SELECT a.src AS a, a.dst AS b, NULL::VARCHAR AS c, 1 AS n_hops FROM e a WHERE a.src IN ('C7', 'P2') UNION ALL SELECT a.src, a.dst, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src IN ('C7', 'P2') AND b.dst <> a.src AND b.dst <> a.dst")
def i5_two_hop_paths(spark, sf):
    return traversal.two_hop_paths(Graph(spark, sf).connects, _seeds(spark, "C7", "P2"))


@query(WITH + "SELECT 4 AS depth")
def i7_eccentricity(spark, sf):
    return spark.createDataFrame([(traversal.eccentricity(Graph(spark, sf).connects, _seeds(spark, "P1")),)], "depth int")


@query(_SYM + ", walk AS (SELECT ['N1'] AS path, t FROM (VALUES ('R1'), ('N6')) v(t) UNION ALL SELECT list_append(path, s.dst), t FROM walk JOIN sym s ON s.src = list_last(path) WHERE len(path) <= 4 AND NOT list_contains(path, s.dst) AND list_last(path) <> t) SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS n_hops FROM walk WHERE list_last(path) = t")
def i8_simple_paths(spark, sf):
    pairs = spark.createDataFrame([("N1", "R1"), ("N1", "N6")], "s string, t string")
    p = traversal.simple_paths(pattern.symmetric(Graph(spark, sf).connects), pairs, 4)
    return p.select(F.array_join("path", ">").alias("path"), "n_hops")


@query("SELECT src, dst, arg_max(rel, seq) AS rel, max(seq) AS seq FROM (SELECT ticker AS src, name AS dst, entity_type AS rel, mention_id AS seq FROM extracted_entity WHERE entity_type IS NOT NULL) GROUP BY 1, 2")
def i9_collapsed(spark, sf):
    e = Graph(spark, sf).raw("extracted_entity").where("entity_type IS NOT NULL")
    return traversal.collapsed(e.select(F.col("ticker").alias("src"), F.col("name").alias("dst"), F.col("entity_type").alias("rel"), F.col("mention_id").alias("seq")))


@query("SELECT count(*) FILTER (WHERE l_partkey <> l_suppkey) AS n_edges, count(*) FILTER (WHERE l_partkey = l_suppkey) AS n_loops FROM lineitem")
def i10_self_loops(spark, sf):
    e = Graph(spark, sf).raw("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return e.agg(F.count_if(F.col("src") != F.col("dst")).alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops"))


@query(WITH + "SELECT count(*) AS n_nodes, (SELECT count(*) FROM g_connects) AS n_edges, (SELECT count(DISTINCT rel) FROM g_connects) AS n_types FROM g_entity")
def i12_graph_metrics(spark, sf):
    g = Graph(spark, sf)
    kinds = g.entity.select(F.lit(1).alias("node"), F.lit(None).cast("string").alias("rel")).unionByName(g.connects.select(F.lit(0).alias("node"), "rel"))
    return kinds.agg(F.count_if(F.col("node") == 1).alias("n_nodes"), F.count_if(F.col("node") == 0).alias("n_edges"), F.count_distinct("rel").alias("n_types"))


@query(WITH + "SELECT 'duplicate company' AS fault, count(*) AS n FROM (SELECT ticker FROM g_company GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'filing without filer', count(*) FROM g_filing WHERE id NOT IN (SELECT dst FROM g_submitted) UNION ALL SELECT 'metric never reported', count(*) FROM g_metric WHERE id NOT IN (SELECT dst FROM g_reports) UNION ALL SELECT 'filer of several', count(*) FROM (SELECT dst FROM g_submitted GROUP BY 1 HAVING count(*) > 1)")
def i13_integrity(spark, sf):
    """The integrity suite: a row per kind of fault with its number."""
    g = Graph(spark, sf)
    more = lambda df, k: df.groupBy(k).count().where("count > 1")
    parts = (
        ("duplicate company", more(g.company, "ticker")),
        ("filing without filer", g.filing.join(g.submitted.select(F.col("dst").alias("id")), "id", "left_anti")),
        ("metric never reported", g.metric.join(g.reports.select(F.col("dst").alias("id")), "id", "left_anti")),
        ("filer of several", more(g.submitted, "dst")),
    )
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n") for name, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(WITH + "SELECT DISTINCT '[' || src || '] --(' || rel || ': ' || src || ' in ' || dst || ')--> [' || dst || ']' AS line FROM g_connects")
def i14_ledger(spark, sf):
    e = Graph(spark, sf).connects
    return traversal.ledger(e.withColumn("description", F.concat("src", F.lit(" in "), "dst")))


@query(WITH + "SELECT id, CASE WHEN depth = 0 THEN 'seed' ELSE 'near' END AS role FROM (SELECT 'R1' AS id, 0 AS depth UNION ALL SELECT src, 1 FROM g_connects WHERE dst = 'R1') ORDER BY depth, id LIMIT 4")
def f8_trimmed(spark, sf):
    g = Graph(spark, sf)
    e = g.connects.where("rel = 'in_region'")
    nodes, _ = traversal.trimmed(traversal.k_hop(e, _seeds(spark, "R1"), 1), e, 4, 3)
    return nodes.select("id", F.when(F.col("depth") == 0, "seed").otherwise("near").alias("role"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT 'N' || s_nationkey AS a, 'P' || s_suppkey AS b FROM supplier), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS root FROM sym UNION SELECT s.b, r.root FROM r JOIN sym s ON s.a = r.id) SELECT id, min(root) AS component FROM r GROUP BY 1")
def i_components(spark, sf):
    """Connected components, an extension."""
    e = Graph(spark, sf).raw("supplier").select(Graph.key("N", "s_nationkey").alias("src"), Graph.key("P", "s_suppkey").alias("dst"))
    return traversal.components(e, e.select(F.explode(F.array("src", "dst")).alias("id")))


# -- H -------------------------------------------------------------------------------------------------------------------------


_BARS = "WITH b AS (SELECT event_type AS key, CAST(ts AS DATE) AS day, avg(value) AS close, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2), s AS (SELECT *, lag(close) OVER (PARTITION BY key ORDER BY day) AS p, row_number() OVER (PARTITION BY key ORDER BY day) AS no FROM b)"


def _bars(spark, sf):
    e = Graph(spark, sf).raw("events")
    return e.groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("at")).agg(F.avg("value").alias("close"), F.max("value").alias("high"), F.min("value").alias("low"))


@query(_BARS + " SELECT key, day AS at, round(CASE WHEN no >= 20 THEN avg(close) OVER w END, 6) AS sma20, round(CASE WHEN no >= 20 THEN avg(close) OVER w + 2 * stddev_pop(close) OVER w END, 6) AS upper, round(CASE WHEN no >= 15 THEN avg(greatest(high - low, abs(high - p), abs(low - p))) OVER v END, 6) AS atr14, round(CASE WHEN no >= 15 THEN 100 - 100 / (1 + avg(greatest(close - p, 0)) OVER v / avg(greatest(p - close, 0)) OVER v) END, 6) AS rsi14 FROM s WINDOW w AS (PARTITION BY key ORDER BY day ROWS 19 PRECEDING), v AS (PARTITION BY key ORDER BY day ROWS 13 PRECEDING)")
def h_indicators(spark, sf):
    return series.indicators(_bars(spark, sf)).select("key", "at", *(F.round(c, 6).alias(c) for c in ("sma20", "upper", "atr14", "rsi14")))


@query(_BARS.replace("WITH b", "WITH RECURSIVE b") + ", seed AS (SELECT key, avg(close) AS e FROM s WHERE no <= 12 GROUP BY 1), r AS (SELECT key, 12::BIGINT AS no, e FROM seed UNION ALL SELECT r.key, s.no, s.close * (2 / 13.0) + r.e * (11 / 13.0) FROM r JOIN s ON s.key = r.key AND s.no = r.no + 1) SELECT key, round(arg_max(e, no), 6) AS ema FROM r GROUP BY 1")
def h3_ema(spark, sf):
    return series.ema(_bars(spark, sf), 12).select("key", F.round("ema", 6).alias("ema"))


@query("SELECT v.vec_id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, v.vec_id LIMIT 10")
def h13_vector_search(spark, sf):
    v = Graph(spark, sf).raw("embeddings")
    asked = [float(x) for x in v.where("vec_id = 0").first()["embedding"]]
    return series.vector_search(v, "vec_id", "embedding", asked, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(score, 6) AS score FROM (SELECT v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.label = 3) ORDER BY score DESC, vec_id LIMIT 5")
def o10_scoped_search(spark, sf):
    v = Graph(spark, sf).raw("embeddings")
    asked = [float(x) for x in v.where("vec_id = 0").first()["embedding"]]
    return series.vector_search(v, "vec_id", "embedding", asked, 5, F.col("label") == 3).select("vec_id", F.round("score", 6).alias("score"))
