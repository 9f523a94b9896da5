"""Scans, filters, pattern joins, aggregations, rankings and set operations over the graph (groups A to G)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import merge, pattern, ranking
from ..registry import query
from .graph import WITH, Graph

# -- A: scans and lookups ------------------------------------------------------------------------------------------------------


@query(WITH + "SELECT ticker, name, sector FROM g_company")
def a1_label_scan(spark, sf):
    return Graph(spark, sf).company


@query(WITH + "SELECT ticker, name, sector FROM g_company WHERE ticker = 'C7'")
def a2_key_lookup(spark, sf):
    return Graph(spark, sf).company.where("ticker = 'C7'").limit(1)


@query(WITH + "SELECT t AS ticker, EXISTS (SELECT 1 FROM g_company WHERE ticker = upper(t)) AS present FROM (VALUES ('c7'), ('C1'), ('nobody')) v(t)")
def a3_existence_probe(spark, sf):
    asked = spark.createDataFrame([("c7",), ("C1",), ("nobody",)], "ticker string")
    known = Graph(spark, sf).company.select(F.col("ticker").alias("k"), F.lit(True).alias("hit"))
    return asked.join(known, F.upper("ticker") == F.col("k"), "left").select("ticker", F.coalesce("hit", F.lit(False)).alias("present"))


@query(WITH + "SELECT id, canonical_name FROM g_metric WHERE id IN (SELECT DISTINCT dst FROM g_reports WHERE currency = 'R')")
def a4_key_list_scan(spark, sf):
    g = Graph(spark, sf)
    return g.metric.select("id", "canonical_name").join(g.reports.where("currency = 'R'").select(F.col("dst").alias("id")), "id", "left_semi")


@query(WITH + "SELECT table_name, count(*) AS n FROM (SELECT 'Company' AS table_name FROM g_company UNION ALL SELECT 'Filing' FROM g_filing UNION ALL SELECT 'Metric' FROM g_metric UNION ALL SELECT 'REPORTS_METRIC' FROM g_reports) GROUP BY 1")
def a27_fingerprint(spark, sf):
    g = Graph(spark, sf)
    parts = (("Company", g.company), ("Filing", g.filing), ("Metric", g.metric), ("REPORTS_METRIC", g.reports))
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in parts))


# -- B: projections and predicates ---------------------------------------------------------------------------------------------


@query(WITH + "SELECT id AS accession, form_type AS form, CAST(NULL AS VARCHAR) AS scale, filing_date AS period_end FROM g_filing WHERE form_type = '1-URGENT' AND fiscal_year = 1995")
def b1_projection_with_missing(spark, sf):
    f = Graph(spark, sf).filing.where("form_type = '1-URGENT' AND fiscal_year = 1995")
    return f.select(F.col("id").alias("accession"), F.col("form_type").alias("form"), F.lit(None).cast("string").alias("scale"), F.col("filing_date").alias("period_end"))


@query(WITH + "SELECT id, canonical_name FROM g_metric WHERE contains(canonical_name, 'ECONOMY') OR contains(canonical_name, 'LARGE') OR contains(reported_label, 'a')")
def b4_substring(spark, sf):
    m = Graph(spark, sf).metric
    return m.where(F.col("canonical_name").contains("ECONOMY") | F.col("canonical_name").contains("LARGE") | F.col("reported_label").contains("a")).select("id", "canonical_name")


@query(WITH + "SELECT ticker, name FROM g_company WHERE lower(ticker) = lower('c12') OR lower(name) = lower('customer#000000020') OR lower(name) = 'customer_20'")
def b5_case_folded_equality(spark, sf):
    c = Graph(spark, sf).company
    return c.where((F.lower("ticker") == "c12") | (F.lower("name") == "customer#000000020") | (F.lower("name") == "customer_20")).select("ticker", "name")


@query(WITH + "SELECT id, name, contains(lower(name), 'nation_1') AS name_holds, contains('where is nation_1 of region_2', lower(name)) AS held FROM g_entity WHERE contains(lower(name), 'nation_1') OR contains('where is nation_1 of region_2', lower(name))")
def b6_containment_both_ways(spark, sf):
    e = Graph(spark, sf).entity
    a, b = F.lower("name").contains("nation_1"), F.lit("where is nation_1 of region_2").contains(F.lower("name"))
    return e.where(a | b).select("id", "name", a.alias("name_holds"), b.alias("held"))


@query(WITH + "SELECT id, form_type, fiscal_year FROM g_filing WHERE fiscal_year = 1996 AND fiscal_period = 'Q2'")
def b9_temporal_conjunction(spark, sf):
    return temporal(Graph(spark, sf).filing, fiscal_year=1996, fiscal_period="Q2").select("id", "form_type", "fiscal_year")


def temporal(filings: DataFrame, **wanted) -> DataFrame:
    """Filings under optional equality filters (B9); a filter that is None keeps everything."""
    return filings.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in wanted.items() if v is not None), F.lit(True)))


@query("SELECT mention_id, name FROM extracted_entity WHERE list_has_all(regexp_split_to_array(lower(name), '[^a-z0-9]+'), ['port', 'vogimp'])")
def b10_token_predicate(spark, sf):
    e = Graph(spark, sf).raw("extracted_entity").select("mention_id", "name")
    asked = F.array(F.lit("port"), F.lit("vogimp"))
    return e.where(F.lower("name").contains("port") | F.lower("name").contains("vogimp")).where(F.forall(asked, lambda t: F.array_contains(F.split(F.lower("name"), "[^a-z0-9]+"), t)))


@query(WITH + "SELECT ticker FROM g_company c WHERE NOT EXISTS (SELECT 1 FROM g_submitted s JOIN g_filing f ON f.id = s.dst WHERE s.src = c.ticker AND f.fiscal_year >= 1997)")
def b11_not_exists(spark, sf):
    g = Graph(spark, sf)
    recent = g.submitted.join(g.filing.where("fiscal_year >= 1997").select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("ticker"))
    return g.company.select("ticker").join(recent, "ticker", "left_anti")


@query("SELECT parsed_id, coalesce(nullif(document_type, ''), 'unknown') AS document_type FROM parsed_document")
def b14_coalesce_default(spark, sf):
    return Graph(spark, sf).raw("parsed_document").select("parsed_id", F.coalesce(F.nullif("document_type", F.lit("")), F.lit("unknown")).alias("document_type"))


@query("SELECT id FROM chunk WHERE contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' share repurchases ')")
def b15_word_boundary(spark, sf):
    return Graph(spark, sf).raw("chunk").where(pattern.contains_word(F.col("text"), F.lit("share repurchases"))).select("id")


@query("SELECT c.name AS issuer, count(*) AS n_texts FROM (SELECT DISTINCT split_part(name, ' ', 1) AS name FROM company WHERE length(split_part(name, ' ', 1)) >= 4) c JOIN documents d ON contains(' ' || regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || lower(c.name) || ' ') GROUP BY 1")
def b16_issuer_mentions(spark, sf):
    """Issuers named in texts: the words of a text are looked up, so texts are never paired with all issuers. Names of under four
    letters are told from words by their case only and are left out here."""
    g = Graph(spark, sf)
    known = g.raw("company").select(F.split("name", " ")[0].alias("issuer")).where(F.length("issuer") >= 4).distinct()
    words = g.raw("documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("word"))
    return words.join(known.withColumn("word", F.lower("issuer")), "word").groupBy("issuer").agg(F.count("*").alias("n_texts"))


@query("SELECT id, list_bool_or([contains(lower(question), w) FOR w IN ['change', 'compare', 'trend']]) AS gated FROM (SELECT id, question FROM eval_question)")
def b17_keyword_gate(spark, sf):
    words = F.array(*map(F.lit, ("change", "compare", "trend")))
    return Graph(spark, sf).raw("eval_question").select("id", F.exists(words, lambda w: F.lower("question").contains(w)).alias("gated"))


@query("SELECT filing_seq, form_type, filing_date FROM filing WHERE filing_date BETWEEN DATE '2019-01-01' AND DATE '2020-12-31' AND upper(form_type) IN ('10-K', '10-Q')")
def b21_manifest_filter(spark, sf):
    f = Graph(spark, sf).raw("filing")
    return f.where(F.col("filing_date").between("2019-01-01", "2020-12-31") & F.upper("form_type").isin("10-K", "10-Q")).select("filing_seq", "form_type", "filing_date")


def company_scope(df: DataFrame, ticker: str | None = None, tickers: list[str] | None = None, everything: bool = False) -> DataFrame:
    """Rows of exactly one kind of scope (B22): a ticker, a list of tickers, or all; no scope gives no rows, two scopes are an error."""
    if sum((ticker is not None, tickers is not None, everything)) > 1:
        raise ValueError("give one scope")
    if everything:
        return df
    wanted = [t.upper() for t in ([ticker] if ticker is not None else tickers or [])]
    return df.where(F.upper(F.trim("ticker")).isin(wanted)) if wanted else df.limit(0)


@query("SELECT upper(trim(ticker)) AS ticker, count(*) AS n FROM parsed_document WHERE upper(trim(ticker)) IN ('QVEX', 'XWGG') GROUP BY 1")
def b22_company_scope(spark, sf):
    p = company_scope(Graph(spark, sf).raw("parsed_document"), tickers=["qvex", "XWGG"])
    return p.groupBy(F.upper(F.trim("ticker")).alias("ticker")).agg(F.count("*").alias("n"))


# -- C: joins ------------------------------------------------------------------------------------------------------------------


@query(WITH + "SELECT c.ticker, f.id, f.form_type FROM g_company c JOIN g_submitted s ON c.ticker = s.src JOIN g_filing f ON f.id = s.dst WHERE c.sector = 'BUILDING'")
def c1_one_hop(spark, sf):
    g = Graph(spark, sf)
    return pattern.hop(g.company.where("sector = 'BUILDING'"), "ticker", g.submitted, g.filing, "id").select("ticker", "id", "form_type")


def _reports(g: Graph) -> DataFrame:
    """The pattern Company -SUBMITTED-> Filing -REPORTS_METRIC-> Metric. A filing and the edge to its filer are one row of one table, so
    that hop is a projection; the joins run on the tables' own keys, and the ids are written out behind them."""
    c = g.raw("customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"))
    f = g.raw("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("form_type"), F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("fiscal_period"))
    m = g.raw("part").select("p_partkey", F.col("p_type").alias("canonical_name"), F.col("p_brand").alias("statement_category"))
    r = g.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("currency"))
    return r.join(m, "p_partkey").join(f, "o_orderkey").join(c, "c_custkey").withColumn("ticker", Graph.key("C", "c_custkey"))


_TWO = " FROM g_company c JOIN g_submitted s ON c.ticker = s.src JOIN g_filing f ON f.id = s.dst JOIN g_reports r ON r.src = f.id JOIN g_metric m ON m.id = r.dst "


@query(WITH + "SELECT c.ticker, c.name AS company, f.form_type AS form, f.fiscal_year, f.fiscal_period AS period, m.canonical_name AS metric, r.value, CAST(NULL AS VARCHAR) AS scale, r.currency" + _TWO + "WHERE contains(m.canonical_name, 'PROMO') OR contains(m.canonical_name, 'ECONOMY')")
def report_metric_by_company(spark, sf):
    """The canned report of a metric by company: two typed hops, a substring filter pushed to the metrics, and an ordered projection."""
    r = _reports(Graph(spark, sf)).where(F.col("canonical_name").contains("PROMO") | F.col("canonical_name").contains("ECONOMY"))
    return r.select("ticker", F.col("name").alias("company"), F.col("form_type").alias("form"), "fiscal_year", F.col("fiscal_period").alias("period"), F.col("canonical_name").alias("metric"), "value", F.lit(None).cast("string").alias("scale"), "currency").orderBy("ticker", F.col("value").desc())


@query(WITH + "SELECT c.ticker, f.form_type AS form, f.fiscal_year, f.fiscal_period AS period, m.canonical_name AS metric, r.value, r.currency" + _TWO + "WHERE m.statement_category IN ('Brand#11', 'Brand#12')")
def report_profitability(spark, sf):
    r = _reports(Graph(spark, sf)).where(F.col("statement_category").isin("Brand#11", "Brand#12"))
    return r.select("ticker", F.col("form_type").alias("form"), "fiscal_year", F.col("fiscal_period").alias("period"), F.col("canonical_name").alias("metric"), "value", "currency").orderBy("ticker", F.col("fiscal_year").desc(), "metric")


@query(WITH + "SELECT m.canonical_name AS metric, s.name AS segment, s.segment_type AS type, d.value FROM g_metric m JOIN g_has_segment d ON m.id = d.src JOIN g_segment s ON s.id = d.dst WHERE contains(m.canonical_name, 'PROMO')")
def report_segment_breakdown(spark, sf):
    g = Graph(spark, sf)
    m = g.metric.where(F.col("canonical_name").contains("PROMO")).select("id", "canonical_name")
    s = g.segment.withColumnRenamed("id", "segment_id")
    return pattern.hop(m, "id", g.has_segment, s, "segment_id").select(F.col("canonical_name").alias("metric"), F.col("name").alias("segment"), F.col("segment_type").alias("type"), "value").orderBy(F.col("value").desc(), "metric", "segment")


@query(WITH + "SELECT c.ticker, f.fiscal_year, f.fiscal_period AS period, m.canonical_name AS metric, r.value, r.currency" + _TWO + "WHERE m.statement_category IN ('Brand#21', 'Brand#22', 'Brand#23') AND (contains(m.canonical_name, 'STANDARD') OR contains(m.canonical_name, 'SMALL'))")
def report_balance_sheet(spark, sf):
    r = _reports(Graph(spark, sf)).where(F.col("statement_category").isin("Brand#21", "Brand#22", "Brand#23") & (F.col("canonical_name").contains("STANDARD") | F.col("canonical_name").contains("SMALL")))
    return r.select("ticker", "fiscal_year", F.col("fiscal_period").alias("period"), F.col("canonical_name").alias("metric"), "value", "currency").orderBy("ticker", F.col("fiscal_year").desc(), "metric")


@query(WITH + "SELECT c.ticker, f.fiscal_year, f.fiscal_period AS period, m.canonical_name AS metric, r.value, r.currency" + _TWO + "WHERE m.statement_category = 'Brand#13'")
def report_cash_flow(spark, sf):
    r = _reports(Graph(spark, sf)).where("statement_category = 'Brand#13'")
    return r.select("ticker", "fiscal_year", F.col("fiscal_period").alias("period"), F.col("canonical_name").alias("metric"), "value", "currency").orderBy("ticker", F.col("fiscal_year").desc(), "metric")


@query(WITH + "SELECT c.ticker, f.form_type AS form, m.canonical_name AS metric, r.value" + _TWO + "WHERE c.ticker = 'C7'")
def b18_ticker_scoped_report(spark, sf):
    mine = _reports(Graph(spark, sf)).where("c_custkey = 7")
    return mine.select("ticker", F.col("form_type").alias("form"), F.col("canonical_name").alias("metric"), "value")


@query(WITH + "SELECT DISTINCT f.id AS filing_id, s.id AS segment_id FROM g_filing f JOIN g_reports r ON r.src = f.id JOIN g_has_segment h ON h.src = r.dst JOIN g_segment s ON s.id = h.dst WHERE f.form_type = '1-URGENT' AND f.fiscal_year = 1995 AND s.segment_type = 'ASIA' OR f.id = 'F7' AND s.id = h.dst AND r.src = f.id AND h.src = r.dst")
def c3_two_hop_mixed(spark, sf):
    """Filings joined to segments over a shared metric: one edge followed forwards, the next one from its source."""
    g = Graph(spark, sf)
    f = g.filing.select(F.col("id").alias("filing_id"), "form_type", "fiscal_year")
    two = f.join(g.reports.select(F.col("src").alias("filing_id"), F.col("dst").alias("metric_id")), "filing_id").join(g.has_segment.select(F.col("src").alias("metric_id"), F.col("dst").alias("segment_id")), "metric_id")
    all_ = two.join(g.segment.select(F.col("id").alias("segment_id"), "segment_type"), "segment_id")
    return all_.where("form_type = '1-URGENT' AND fiscal_year = 1995 AND segment_type = 'ASIA' OR filing_id = 'F7'").select("filing_id", "segment_id").distinct()


@query(WITH + "SELECT src, dst, rel FROM g_edge WHERE src IN ('F1', 'F7', 'C7', 'M5')")
def c4_untyped_relation(spark, sf):
    return Graph(spark, sf).edge.where(F.col("src").isin("F1", "F7", "C7", "M5"))


@query(WITH + "SELECT a, b, rel FROM (SELECT src AS a, dst AS b, rel FROM g_connects UNION ALL SELECT dst, src, rel FROM g_connects) WHERE a IN ('N3', 'R1')")
def c5_undirected(spark, sf):
    return pattern.symmetric(Graph(spark, sf).connects).where(F.col("src").isin("N3", "R1")).select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel")


_SYM = WITH + ", sym AS (SELECT src, dst FROM g_connects UNION ALL SELECT dst, src FROM g_connects) "


@query(_SYM + "SELECT count(*) AS n_paths, count(DISTINCT x.src) AS n_starts FROM sym x JOIN sym y ON x.dst = y.src AND y.dst <> x.src")
def c6_undirected_two_hop(spark, sf):
    """Undirected paths of two edges that don't walk back: counted per middle node, so that the paths of a hub are never expanded."""
    e = pattern.symmetric(Graph(spark, sf).connects).select("src", "dst")
    pairs = e.groupBy("src", "dst").agg(F.count("*").alias("c"))  # parallel edges
    out = pairs.groupBy(F.col("src").alias("mid")).agg(F.sum("c").alias("n"))
    ways = pairs.join(out, F.col("dst") == F.col("mid")).join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("c").alias("back")), ["src", "dst"])
    per = ways.select("src", (F.col("c") * (F.col("n") - F.col("back"))).alias("paths")).where("paths > 0")
    return per.agg(F.coalesce(F.sum("paths"), F.lit(0)).cast("bigint").alias("n_paths"), F.count_distinct("src").alias("n_starts"))


@query(_SYM + "SELECT 1 AS leg, src AS a, dst AS b FROM sym WHERE src = 'R1' UNION ALL SELECT 2, y.src, y.dst FROM sym x JOIN sym y ON x.dst = y.src WHERE x.src = 'R1'")
def c7_two_legs(spark, sf):
    e = pattern.symmetric(Graph(spark, sf).connects).select("src", "dst")
    first = e.where("src = 'R1'")
    second = first.select(F.col("dst").alias("src")).join(e, "src").select("src", "dst")
    legs = first.select(F.lit(1).alias("leg"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return legs.unionByName(second.select(F.lit(2).alias("leg"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query("SELECT count(*) FILTER (WHERE f.id IS NULL) AS n_dangling, count(*) FILTER (WHERE f.id IS NOT NULL) AS n_kept FROM (SELECT id, filing_id FROM chunk) c LEFT JOIN (SELECT DISTINCT id FROM filing) f ON c.filing_id = f.id")
def c9_dangling_edges(spark, sf):
    g = Graph(spark, sf)
    e = g.raw("chunk").select(F.col("filing_id").alias("src"), F.col("id").alias("dst"))
    kept, dangling = pattern.endpoints_stored(e, g.raw("filing"), "id", g.raw("chunk").select("id").distinct(), "id")
    counts = kept.select(F.lit(1).alias("k")).unionByName(dangling.select(F.lit(0).alias("k")))
    return counts.agg(F.count_if(F.col("k") == 0).alias("n_dangling"), F.count_if(F.col("k") == 1).alias("n_kept"))


@query("SELECT id, min(filing_seq) AS filing_seq FROM filing WHERE batch_no > 0 AND id IS NOT NULL AND id NOT IN (SELECT id FROM filing WHERE batch_no = 0 AND id IS NOT NULL) GROUP BY id")
def c10_idempotent_load(spark, sf):
    f = Graph(spark, sf).raw("filing").select("id", "filing_seq", "batch_no")
    return merge.idempotent_nodes(f.where("batch_no > 0"), f.where("batch_no = 0"), "id", ["filing_seq"]).select("id", "filing_seq")


@query("SELECT DISTINCT coalesce(ticker, '') AS src, coalesce(id, '') AS dst, coalesce(source_authority, '') AS authority FROM filing WHERE batch_no > 0 AND (coalesce(ticker, ''), coalesce(id, ''), coalesce(source_authority, '')) NOT IN (SELECT (coalesce(ticker, ''), coalesce(id, ''), coalesce(source_authority, '')) FROM filing WHERE batch_no = 0)")
def c11_new_arcs(spark, sf):
    f = Graph(spark, sf).raw("filing").select(F.col("ticker").alias("src"), F.col("id").alias("dst"), F.col("source_authority").alias("authority"), "batch_no")
    new = merge.new_arcs(f.where("batch_no > 0"), f.where("batch_no = 0"), ["src", "dst", "authority"])
    return new.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("src", "dst", "authority")))


@query("SELECT c.id AS chunk_id, coalesce(f.ticker, '') AS filer FROM chunk c LEFT JOIN (SELECT id, min(ticker) AS ticker FROM filing GROUP BY id) f ON c.filing_id = f.id")
def c12_filer_of_chunk(spark, sf):
    g = Graph(spark, sf)
    filers = g.raw("filing").groupBy("id").agg(F.min("ticker").alias("filer")).withColumnRenamed("id", "filing_id")
    return g.raw("chunk").select(F.col("id").alias("chunk_id"), "filing_id").join(filers, "filing_id", "left").select("chunk_id", F.coalesce("filer", F.lit("")).alias("filer"))


@query(WITH + "SELECT src, dst, rel FROM g_connects WHERE src IN (SELECT id FROM g_entity WHERE entity_type <> 'Customer') AND dst IN (SELECT id FROM g_entity WHERE entity_type <> 'Customer')")
def c13_induced_subgraph(spark, sf):
    g = Graph(spark, sf)
    return pattern.induced(g.connects, g.entity.where("entity_type <> 'Customer'"))


@query("WITH s AS (SELECT ticker, filing_seq AS span_id, CAST(fiscal_year * 400 AS BIGINT) AS start, CAST(fiscal_year * 400 + 90 + filing_seq % 50 AS BIGINT) AS stop FROM filing WHERE ticker IS NOT NULL AND fiscal_year > 0), p AS (SELECT mention_id AS point_id, ticker, CAST(804000 + mention_id % 8000 AS BIGINT) AS off FROM extracted_entity) SELECT point_id, span_id, start FROM (SELECT point_id, span_id, start, row_number() OVER (PARTITION BY point_id ORDER BY start, stop, span_id) AS n FROM p JOIN s USING (ticker) WHERE start <= off AND off < stop) WHERE n = 1")
def c14_span_containment(spark, sf):
    g = Graph(spark, sf)
    year = F.col("fiscal_year")
    s = g.raw("filing").where("fiscal_year > 0").select("ticker", F.col("filing_seq").alias("span_id"), (year * 400).alias("start"), (year * 400 + 90 + F.col("filing_seq") % 50).alias("end"))
    p = g.raw("extracted_entity").select(F.col("mention_id").alias("point_id"), "ticker", (F.lit(804000) + F.col("mention_id") % 8000).cast("bigint").alias("offset"))
    return pattern.containment(p, s, "ticker", width=200)


@query("SELECT c.id, f.filing_date, f.form_type FROM (SELECT id, ticker, DATE '2016-01-01' + CAST(page_start * 30 AS INTEGER) AS at FROM chunk WHERE ticker IS NOT NULL) c ASOF LEFT JOIN (SELECT ticker, filing_date, max(form_type) AS form_type FROM filing WHERE filing_date IS NOT NULL GROUP BY 1, 2) f ON c.ticker = f.ticker AND c.at >= f.filing_date")
def c15_as_of(spark, sf):
    g = Graph(spark, sf)
    c = g.raw("chunk").where("ticker IS NOT NULL").select("id", "ticker", F.date_add(F.lit("2016-01-01").cast("date"), (F.col("page_start") * 30).cast("int")).alias("filing_date"))
    f = g.raw("filing").where("filing_date IS NOT NULL").select("ticker", "filing_date", F.struct("filing_date", "form_type").alias("f"))
    got = pattern.as_of(c, f, ["ticker"], "filing_date", "f")
    return got.select("id", F.col("f.filing_date").alias("filing_date"), F.col("f.form_type").alias("form_type"))


_RULES = [("R1", "10-K", None), ("R2", None, "annual|10-K"), ("R3", None, "8-K"), ("R4", "8-k", None), ("R5", None, "def 14a|proxy")]


@query("WITH r(rule_id, tag, label) AS (VALUES ('R1', '10-K', NULL), ('R2', NULL, 'annual|10-k'), ('R3', NULL, '8-k'), ('R4', '8-k', NULL), ('R5', NULL, 'def 14a|proxy')) SELECT filing_seq, rule_id, min(matched_on) AS matched_on FROM (SELECT filing_seq, rule_id, '1 tag' AS matched_on FROM filing JOIN r ON lower(form_type) = lower(tag) UNION ALL SELECT filing_seq, rule_id, '2 label' FROM filing JOIN r ON regexp_matches(lower(document_title), label)) GROUP BY 1, 2")
def c16_rules(spark, sf):
    """All rules that match a row, by exact tag first, then by label pattern. The rules are a short fixed list, tested as columns."""
    f = Graph(spark, sf).raw("filing")
    hits = []
    for rule, tag, label in _RULES:
        on = F.when(F.lower("form_type") == tag.lower(), "1 tag") if tag else F.when(F.lower("document_title").rlike(label.lower()), "2 label")
        hits.append(F.when(on.isNotNull(), F.struct(F.lit(rule).alias("rule_id"), on.alias("matched_on"))))
    return f.select("filing_seq", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("filing_seq", "h.*")


_GAZETTEER = {"Regulator": "regulators? in|inquiry", "Lender": "borrowings of", "Customer": "customers of the", "Litigant": "litigation brought by"}


@query("WITH g(kind, pat) AS (VALUES ('Regulator', 'regulators? in|inquiry'), ('Lender', 'borrowings of'), ('Customer', 'customers of the'), ('Litigant', 'litigation brought by')) SELECT filing_seq, kind, regexp_extract(lower(content), pat) AS name FROM filing, g WHERE regexp_matches(lower(content), pat)")
def c17_gazetteer(spark, sf):
    low = F.lower("content")
    hits = [F.when(low.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(low, f"({p})", 1).alias("name"))) for k, p in _GAZETTEER.items()]
    return Graph(spark, sf).raw("filing").select("filing_seq", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("filing_seq", "h.*")


@query("SELECT DISTINCT a.filing_id, a.name AS product, b.name AS regulator FROM (SELECT c.filing_id, e.name FROM extracted_entity e JOIN chunk c ON e.chunk_id = c.id WHERE e.entity_type = 'Product') a JOIN (SELECT c.filing_id, e.name FROM extracted_entity e JOIN chunk c ON e.chunk_id = c.id WHERE e.entity_type = 'RegulatoryBody') b USING (filing_id)")
def c18_pairs_within_document(spark, sf):
    g = Graph(spark, sf)
    m = g.raw("extracted_entity").select("chunk_id", "name", "entity_type").join(g.raw("chunk").select(F.col("id").alias("chunk_id"), "filing_id"), "chunk_id").select("filing_id", "name", "entity_type").distinct()
    a = m.where("entity_type = 'Product'").select("filing_id", F.col("name").alias("product"))
    b = m.where("entity_type = 'RegulatoryBody'").select("filing_id", F.col("name").alias("regulator"))
    return a.join(b, "filing_id").distinct()


@query(WITH + "SELECT b.src, b.dst, b.rel FROM (VALUES ('C7', 'N3', 'BRIDGE'), ('C8', 'N999', 'BRIDGE'), ('P1', 'R1', 'BRIDGE')) b(src, dst, rel) WHERE src IN (SELECT id FROM g_entity) AND dst IN (SELECT id FROM g_entity)")
def c21_bridge_edges(spark, sf):
    bridge = spark.createDataFrame([("C7", "N3", "BRIDGE"), ("C8", "N999", "BRIDGE"), ("P1", "R1", "BRIDGE")], "src string, dst string, rel string")
    return pattern.induced(bridge, Graph(spark, sf).entity)


@query("SELECT DISTINCT e.name, c.ticker IS NOT NULL AS attached FROM extracted_entity e LEFT JOIN (SELECT ticker, lower(name) AS k FROM company) c ON lower(e.name) = c.k WHERE e.name IS NOT NULL")
def c22_backbone_flag(spark, sf):
    g = Graph(spark, sf)
    known = g.raw("company").select(F.lower("name").alias("k")).distinct().withColumn("hit", F.lit(True))
    return g.raw("extracted_entity").select("name").where("name IS NOT NULL").distinct().join(known, F.lower("name") == F.col("k"), "left").select("name", F.col("hit").isNotNull().alias("attached"))


@query("SELECT parsed_id, coalesce(x.filing_seq, y.filing_seq) AS filing_seq FROM (SELECT parsed_id, form_type, upper(trim(ticker)) AS t, fiscal_year AS y FROM parsed_document) p LEFT JOIN (SELECT form_type, upper(ticker) AS t, CAST(fiscal_year AS VARCHAR) AS y, min(filing_seq) AS filing_seq FROM filing GROUP BY ALL) x ON p.form_type = x.form_type AND p.t = x.t AND p.y = x.y LEFT JOIN (SELECT form_type, upper(ticker) AS t, min(filing_seq) AS filing_seq FROM filing GROUP BY ALL) y ON p.form_type = y.form_type AND p.t = y.t")
def c24_exact_else_first(spark, sf):
    g = Graph(spark, sf)
    p = g.raw("parsed_document").select("parsed_id", "form_type", F.upper(F.trim("ticker")).alias("t"), F.col("fiscal_year").alias("y"))
    f = g.raw("filing").select("form_type", F.upper("ticker").alias("t"), F.col("fiscal_year").cast("string").alias("y"), "filing_seq")
    exact = f.groupBy("form_type", "t", "y").agg(F.min("filing_seq").alias("exact"))
    loose = exact.groupBy("form_type", "t").agg(F.min("exact").alias("loose"))
    return p.join(exact, ["form_type", "t", "y"], "left").join(loose, ["form_type", "t"], "left").select("parsed_id", F.coalesce("exact", "loose").alias("filing_seq"))


# -- D: aggregations -----------------------------------------------------------------------------------------------------------


@query(WITH + "SELECT rel, count(*) AS n FROM g_edge GROUP BY 1")
def d1_counts_per_relation(spark, sf):
    return Graph(spark, sf).edge.groupBy("rel").agg(F.count("*").alias("n"))


@query(WITH + "SELECT form_type, max(fiscal_year) AS latest FROM g_filing GROUP BY 1")
def d2_max_year_by_form(spark, sf):
    return Graph(spark, sf).filing.groupBy("form_type").agg(F.max("fiscal_year").alias("latest"))


@query("SELECT entity_type, count(*) AS n FROM extracted_entity GROUP BY 1 ORDER BY n DESC, entity_type LIMIT 15")
def d3_top_types(spark, sf):
    return Graph(spark, sf).raw("extracted_entity").groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "entity_type").limit(15)


@query(WITH + "SELECT DISTINCT fiscal_year, fiscal_period FROM g_filing")
def d4_distinct_periods(spark, sf):
    return Graph(spark, sf).filing.select("fiscal_year", "fiscal_period").distinct()


@query("SELECT upper(trim(ticker)) AS ticker, count(*) AS n_filings, array_to_string(list_sort(list_distinct(list(form_type))), ',') AS forms, max(filing_date) AS latest FROM filing WHERE ticker IS NOT NULL GROUP BY 1")
def d5_company_overview(spark, sf):
    f = Graph(spark, sf).raw("filing").where("ticker IS NOT NULL")
    return f.groupBy(F.upper(F.trim("ticker")).alias("ticker")).agg(F.count("*").alias("n_filings"), F.array_join(F.sort_array(F.collect_set("form_type")), ",").alias("forms"), F.max("filing_date").alias("latest"))


@query("SELECT form_type, CAST(CASE WHEN fiscal_year > 0 THEN fiscal_year ELSE year(filing_date) END AS BIGINT) AS fy, count(*) AS n FROM filing GROUP BY 1, 2")
def d6_form_and_year(spark, sf):
    fy = F.when(F.col("fiscal_year") > 0, F.col("fiscal_year")).otherwise(F.year("filing_date").cast("bigint"))
    return Graph(spark, sf).raw("filing").groupBy("form_type", fy.alias("fy")).agg(F.count("*").alias("n"))


@query("SELECT id, count(*) AS n FROM filing GROUP BY 1 HAVING count(*) <> 1")
def d7_degree_check(spark, sf):
    return Graph(spark, sf).raw("filing").groupBy("id").agg(F.count("*").alias("n")).where("n <> 1")


@query("SELECT count(DISTINCT (coalesce(ticker, ''), coalesce(form_type, ''), coalesce(accession, ''))) AS n FROM filing")
def d8_distinct_identities(spark, sf):
    return Graph(spark, sf).raw("filing").agg(F.count_distinct(F.struct(*merge.same_text("ticker", "form_type", "accession"))).alias("n"))


@query("SELECT count(*) FILTER (WHERE fiscal_year = -1) AS n_year, count(*) FILTER (WHERE filing_date = DATE '0001-01-01') AS n_date, count(*) FILTER (WHERE reporting_lag_in_days = -1) AS n_lag FROM filing")
def d9_sentinels(spark, sf):
    f = Graph(spark, sf).raw("filing")
    return f.agg(F.count_if(F.col("fiscal_year") == -1).alias("n_year"), F.count_if(F.col("filing_date") == F.lit("0001-01-01").cast("date")).alias("n_date"), F.count_if(F.col("reporting_lag_in_days") == -1).alias("n_lag"))


@query("SELECT l_orderkey, l_partkey, min_by(l_extendedprice, (l_linenumber, l_extendedprice)) AS value, count(DISTINCT l_extendedprice) - 1 AS n_conflicts FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_extendedprice) > 1")
def d10_conflicts(spark, sf):
    rows = Graph(spark, sf).raw("lineitem").withColumn("v", F.col("l_extendedprice"))
    return merge.resolved_conflicts(rows, ["l_orderkey", "l_partkey"], "l_extendedprice", "l_linenumber", "v").where("n_conflicts > 0").withColumnRenamed("l_extendedprice", "value")


@query("SELECT fiscal_year, fiscal_period, count(*) AS n, count(DISTINCT reporting_lag_in_days) AS n_lags FROM filing GROUP BY 1, 2")
def d11_values_per_period(spark, sf):
    return Graph(spark, sf).raw("filing").groupBy("fiscal_year", "fiscal_period").agg(F.count("*").alias("n"), F.count_distinct("reporting_lag_in_days").alias("n_lags"))


@query(WITH + "SELECT max(n) AS widest, min(n) AS narrowest, count(*) AS n_metrics FROM (SELECT src, count(*) AS n FROM g_has_segment GROUP BY 1)")
def d12_widest_group(spark, sf):
    n = Graph(spark, sf).has_segment.groupBy("src").agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("widest"), F.min("n").alias("narrowest"), F.count("*").alias("n_metrics"))


@query("SELECT name, arg_max(coalesce(description, ''), (length(coalesce(description, '')), -mention_id)) AS description, arg_max(coalesce(entity_type, ''), (length(coalesce(entity_type, '')), -mention_id)) AS entity_type FROM extracted_entity WHERE name IS NOT NULL GROUP BY 1")
def d14_richer_nodes(spark, sf):
    rows = Graph(spark, sf).raw("extracted_entity").where("name IS NOT NULL").select("name", "mention_id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("entity_type", F.lit("")).alias("entity_type"))
    return merge.richer_nodes(rows, "name", ["description", "entity_type"], "mention_id")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_discount DESC, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def d15_best_confidence(spark, sf):
    rows = Graph(spark, sf).raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount")
    return merge.best_confidence(rows, ["l_orderkey", "l_partkey"], "l_discount", "l_suppkey")


@query("SELECT src, dst, rel, min(seq) AS seq FROM (SELECT ticker AS src, name AS dst, entity_type AS rel, mention_id AS seq FROM extracted_entity) GROUP BY 1, 2, 3")
def d16_first_edge(spark, sf):
    e = Graph(spark, sf).raw("extracted_entity").select(F.col("ticker").alias("src"), F.col("name").alias("dst"), F.col("entity_type").alias("rel"), F.col("mention_id").alias("seq"))
    return merge.first_wins(e, ["src", "dst", "rel"], ["seq"])


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(text) ORDER BY length(text), id) AS n FROM chunk WHERE text IS NOT NULL) WHERE n = 1")
def d17_undominated(spark, sf):
    c = Graph(spark, sf).raw("chunk").where("text IS NOT NULL").select("id", F.sha2(F.lower("text"), 256).alias("t"), F.length("text").alias("n"))
    return merge.undominated(c, "t", "n", "id", []).select("id")


_HINTS = {"income": ("net sales", "gross margin", "operating income"), "balance": ("inventory", "accounts receivable", "goodwill"), "cash": ("free cash flow", "capital expenditure")}


@query("SELECT id, CASE WHEN greatest(a, b, c) = 0 THEN 'other' WHEN a >= b AND a >= c THEN 'income' WHEN b >= c THEN 'balance' ELSE 'cash' END AS category FROM (SELECT id, contains(t, 'net sales')::INT + contains(t, 'gross margin')::INT + contains(t, 'operating income')::INT AS a, contains(t, 'inventory')::INT + contains(t, 'accounts receivable')::INT + contains(t, 'goodwill')::INT AS b, contains(t, 'free cash flow')::INT + contains(t, 'capital expenditure')::INT AS c FROM (SELECT id, lower(text) AS t FROM chunk))")
def d18_category_vote(spark, sf):
    low = F.lower("text")
    votes = {k: reduce(lambda a, b: a + b, (low.contains(h).cast("int") for h in hints)) for k, hints in _HINTS.items()}
    best = F.greatest(*votes.values())
    pick = F.coalesce(*(F.when(v == best, F.lit(k)) for k, v in votes.items()))
    return Graph(spark, sf).raw("chunk").select("id", F.when(best == 0, F.lit("other")).otherwise(pick).alias("category"))


@query("SELECT src, rel, n, round(100.0 * n / total, 4) AS share FROM (SELECT ticker AS src, entity_type AS rel, count(*) AS n, sum(count(*)) OVER () AS total FROM extracted_entity GROUP BY 1, 2) WHERE n >= 5 ORDER BY n DESC, src, rel LIMIT 5")
def d19_fan_out(spark, sf):
    e = Graph(spark, sf).raw("extracted_entity")
    total = e.count()
    n = e.groupBy(F.col("ticker").alias("src"), F.col("entity_type").alias("rel")).agg(F.count("*").alias("n"))
    top = n.where("n >= 5").orderBy(F.col("n").desc(), F.col("src").asc_nulls_last(), F.col("rel").asc_nulls_last()).limit(5)
    return top.select("src", "rel", "n", F.round(F.lit(100.0) * F.col("n") / F.lit(total), 4).alias("share"))


@query("SELECT event_type, max(n) AS n, max(CASE WHEN r = least(greatest(round_even(0.5 * n + 0.5, 0), 1), n) THEN value END) AS p50, max(CASE WHEN r = least(greatest(round_even(0.9 * n + 0.5, 0), 1), n) THEN value END) AS p90, max(CASE WHEN r = least(greatest(round_even(0.99 * n + 0.5, 0), 1), n) THEN value END) AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1")
def d20_nearest_rank(spark, sf):
    return ranking.nearest_rank(Graph(spark, sf).raw("events").select("event_type", "value"), ["event_type"], "value", [50, 90, 99])


@query("SELECT event_type, max(n) AS n, max(CASE WHEN r = least(floor(n * 0.5), n - 1) THEN value END) AS p50, max(CASE WHEN r = least(floor(n * 0.95), n - 1) THEN value END) AS p95, max(CASE WHEN r = least(floor(n * 0.99), n - 1) THEN value END) AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1")
def d21_index_percentile(spark, sf):
    return ranking.index_percentile(Graph(spark, sf).raw("events").select("event_type", "value"), ["event_type"], "value", [0.5, 0.95, 0.99])


@query("SELECT source, count(*) AS n, round(coalesce(100.0 * avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 0), 6) AS english FROM documents GROUP BY 1")
def d22_rates(spark, sf):
    return Graph(spark, sf).raw("documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.coalesce(100.0 * F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias("english"))


@query("SELECT 'events{type=' || event_type || ',user=' || CAST(user_id % 4 AS VARCHAR) || '}' AS counter, count(*) AS n FROM events GROUP BY 1")
def d23_labelled_counters(spark, sf):
    name = F.concat(F.lit("events{type="), "event_type", F.lit(",user="), (F.col("user_id") % 4).cast("string"), F.lit("}"))
    return Graph(spark, sf).raw("events").groupBy(name.alias("counter")).agg(F.count("*").alias("n"))


@query("SELECT entity_type, count(*) AS n, count(*) FILTER (WHERE description IS NULL) AS n_bare, count(DISTINCT name) AS n_names, count(*) FILTER (WHERE lower(name) LIKE '%(the %company%)%') AS n_defined FROM extracted_entity GROUP BY 1")
def d24_registry_totals(spark, sf):
    e = Graph(spark, sf).raw("extracted_entity")
    return e.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(F.col("description").isNull()).alias("n_bare"), F.count_distinct("name").alias("n_names"), F.count_if(F.lower("name").like("%(the %company%)%")).alias("n_defined"))


# -- E and F: windows and top-k ------------------------------------------------------------------------------------------------

_SERIES = ("trend", "over the", "each quarter", "each year", "every quarter", "every year", "history", "historical", "by quarter", "by year", "yearly", "quarterly", "trajectory", "progression", "last n", "past n")


def period_cap(question: str) -> int:
    """Periods kept per concept and issuer: 16 for questions about a series, else 3."""
    return 16 if any(w in question.lower() for w in _SERIES) else 3


def _periods(spark, sf) -> DataFrame:
    f = Graph(spark, sf).raw("filing").where("ticker IS NOT NULL").select(F.upper("ticker").alias("issuer"), F.col("form_type").alias("concept"), F.nullif("period_end_date", F.lit("0001-01-01").cast("date")).alias("period_end"), "filing_seq")
    return f


def _top_periods(n: int) -> str:
    return f"SELECT issuer, concept, period_end, filing_seq, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY concept, issuer ORDER BY period_end DESC NULLS LAST, filing_seq) AS rank FROM (SELECT upper(ticker) AS issuer, form_type AS concept, nullif(period_end_date, DATE '0001-01-01') AS period_end, filing_seq FROM filing WHERE ticker IS NOT NULL)) WHERE rank <= {n}"


@query(_top_periods(3))
def e1_top_periods(spark, sf):
    return ranking.top_k(_periods(spark, sf), ["concept", "issuer"], [F.col("period_end").desc_nulls_last(), F.col("filing_seq")], period_cap("latest quarter"))


@query(_top_periods(16))
def e1_top_periods_series(spark, sf):
    return ranking.top_k(_periods(spark, sf), ["concept", "issuer"], [F.col("period_end").desc_nulls_last(), F.col("filing_seq")], period_cap("quarterly revenue trend"))


@query("SELECT section, arg_max(id, (coalesce(page_end, -1), id)) AS id FROM chunk WHERE section IS NOT NULL GROUP BY 1")
def e3_latest_per_group(spark, sf):
    return Graph(spark, sf).raw("chunk").where("section IS NOT NULL").groupBy("section").agg(F.max_by("id", F.struct(F.coalesce("page_end", F.lit(-1)), "id")).alias("id"))


@query("SELECT ticker, form_type, filing_seq, reporting_lag_in_days FROM (SELECT *, row_number() OVER (PARTITION BY ticker, form_type ORDER BY CASE WHEN form_type = '10-K' THEN -reporting_lag_in_days ELSE reporting_lag_in_days END, filing_seq) AS n FROM filing WHERE reporting_lag_in_days > 0 AND ticker IS NOT NULL) WHERE n = 1")
def e4_span_choice(spark, sf):
    f = Graph(spark, sf).raw("filing").where("reporting_lag_in_days > 0 AND ticker IS NOT NULL").select("ticker", "form_type", "filing_seq", "reporting_lag_in_days")
    order = F.when(F.col("form_type") == "10-K", -F.col("reporting_lag_in_days")).otherwise(F.col("reporting_lag_in_days"))
    return merge.first_wins(f, ["ticker", "form_type"], [order, F.col("filing_seq")])


@query("SELECT ticker, min_by(form_type, (length(form_type), form_type)) AS form_type, max(period_end_date) AS period_end FROM filing f WHERE ticker IS NOT NULL AND period_end_date = (SELECT max(period_end_date) FROM filing g WHERE g.ticker = f.ticker) GROUP BY 1")
def e5_latest_shortest(spark, sf):
    f = Graph(spark, sf).raw("filing").where("ticker IS NOT NULL").select("ticker", "form_type", F.col("period_end_date").alias("period_end"))
    top = f.groupBy("ticker").agg(F.max("period_end").alias("period_end"))
    return f.join(top, ["ticker", "period_end"]).groupBy("ticker", "period_end").agg(F.min_by("form_type", F.struct(F.length("form_type"), "form_type")).alias("form_type")).select("ticker", "form_type", "period_end")


@query("SELECT filing_id, id, chunk_index, lead(chunk_index) OVER (PARTITION BY filing_id ORDER BY chunk_index, id) AS next_index FROM chunk")
def e6_lead(spark, sf):
    c = Graph(spark, sf).raw("chunk").select("filing_id", "id", "chunk_index")
    return c.withColumn("next_index", F.lead("chunk_index").over(W.partitionBy("filing_id").orderBy("chunk_index", "id")))


@query("SELECT id, last_value(section IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY chunk_index, id ROWS UNBOUNDED PRECEDING) AS heading FROM chunk")
def e8_carry_forward(spark, sf):
    c = Graph(spark, sf).raw("chunk").select("id", "ticker", F.struct("chunk_index", "id").alias("at"), "section")
    return ranking.carried_forward(c, ["ticker"], "at", "section", "heading").select("id", "heading")


@query("SELECT user_id, event_id, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT user_id, event_id, t, CASE WHEN lag(t) OVER (PARTITION BY user_id ORDER BY t) IS NULL OR t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 20000 THEN 1 ELSE 0 END AS o FROM (SELECT user_id, event_id, epoch_us(ts) / 1e6 + event_id * 1e-9 AS t FROM events))")
def e9_gap_runs(spark, sf):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.col("event_id") * 1e-9
    e = Graph(spark, sf).raw("events").select("user_id", "event_id", seconds.alias("t"))
    return ranking.sessions(e, ["user_id"], "t", 20000.0).select("user_id", "event_id", "run")


@query("SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 AND coalesce(sector, '') <> '' THEN name || ' · ' || sector ELSE name END AS name FROM (SELECT ticker AS id, name, sector FROM company)")
def e10_disambiguated(spark, sf):
    return merge.disambiguated(Graph(spark, sf).raw("company").select(F.col("ticker").alias("id"), "name", "sector"), "name", "sector").select("id", "name")


@query("SELECT ticker, mention_id, CAST(rank AS INTEGER) AS rank FROM (SELECT ticker, mention_id, row_number() OVER (PARTITION BY ticker ORDER BY mention_id) AS rank FROM extracted_entity WHERE ticker IS NOT NULL) WHERE rank <= 5 ORDER BY rank, ticker LIMIT 150")
def e11_quotas(spark, sf):
    e = Graph(spark, sf).raw("extracted_entity").where("ticker IS NOT NULL").select("ticker", "mention_id")
    return ranking.with_quotas(e, "ticker", [F.col("mention_id")], 5, 150)


@query("SELECT name, entity_type, n, lead(n) OVER (PARTITION BY name ORDER BY n DESC, entity_type) AS runner_up FROM (SELECT name, entity_type, count(*) AS n FROM extracted_entity WHERE name IS NOT NULL GROUP BY 1, 2)")
def e12_runner_up(spark, sf):
    n = Graph(spark, sf).raw("extracted_entity").where("name IS NOT NULL").groupBy("name", "entity_type").agg(F.count("*").alias("n"))
    return n.withColumn("runner_up", F.lead("n").over(W.partitionBy("name").orderBy(F.col("n").desc(), F.col("entity_type").asc_nulls_last())))


@query("SELECT file_name, arg_max(line_id, (line_no, line_id)) AS last_line FROM run_report GROUP BY 1")
def e13_last_record(spark, sf):
    return Graph(spark, sf).raw("run_report").groupBy("file_name").agg(F.max_by("line_id", F.struct("line_no", "line_id")).alias("last_line"))


@query(WITH + "SELECT id, form_type, fiscal_year FROM g_filing ORDER BY fiscal_year DESC, form_type, id LIMIT 100")
def f1_order_limit(spark, sf):
    return Graph(spark, sf).filing.select("id", "form_type", "fiscal_year").orderBy(F.col("fiscal_year").desc(), "form_type", "id").limit(100)


@query("SELECT id, name, CAST(r AS INTEGER) AS match_rank FROM (SELECT ticker AS id, name, CASE WHEN lower(name) = 'virzeskor motors inc.' THEN 0 WHEN starts_with(lower(name), 'virzeskor') THEN 1 WHEN list_contains(regexp_split_to_array(lower(name), '[^a-z0-9]+'), 'motors') THEN 2 WHEN contains(lower(name), 'motor') THEN 3 ELSE 4 END AS r FROM company) WHERE r < 4")
def f6_match_rank(spark, sf):
    low = F.lower("name")
    r = F.when(low == "virzeskor motors inc.", 0).when(low.startswith("virzeskor"), 1).when(F.array_contains(F.split(low, "[^a-z0-9]+"), "motors"), 2).when(low.contains("motor"), 3).otherwise(4)
    return Graph(spark, sf).raw("company").select(F.col("ticker").alias("id"), "name", r.alias("match_rank")).where("match_rank < 4").orderBy("match_rank", F.length("name"), "name")


@query("SELECT ticker, name, len(list_filter(w, lambda x: NOT list_contains(['cement', 'ltd', 'goutselt'], x))) AS extra, len(w) AS n_words FROM (SELECT ticker, name, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM company) WHERE list_has_any(w, ['cement', 'goutselt'])")
def f7_token_overlap(spark, sf):
    w = F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda x: x != "")
    asked, wanted = F.array(*map(F.lit, ("cement", "ltd", "goutselt"))), F.array(F.lit("cement"), F.lit("goutselt"))
    c = Graph(spark, sf).raw("company").where(F.arrays_overlap(w, wanted))
    return c.select("ticker", "name", F.size(F.filter(w, lambda x: ~F.array_contains(asked, x))).cast("bigint").alias("extra"), F.size(w).cast("bigint").alias("n_words")).orderBy("extra", "n_words", "name")


@query("SELECT ticker, mention_id, length(name) AS n, sum(length(name)) OVER (PARTITION BY ticker ORDER BY mention_id ROWS UNBOUNDED PRECEDING) <= 600 AS fits FROM extracted_entity WHERE ticker IS NOT NULL AND name IS NOT NULL")
def f12_text_budget(spark, sf):
    e = Graph(spark, sf).raw("extracted_entity").where("ticker IS NOT NULL AND name IS NOT NULL").select("ticker", "mention_id", F.length("name").cast("bigint").alias("n"))
    return e.withColumn("fits", F.sum("n").over(W.partitionBy("ticker").orderBy("mention_id").rowsBetween(W.unboundedPreceding, 0)) <= 600)


# -- G: set operations ---------------------------------------------------------------------------------------------------------


@query(WITH + "SELECT id, label FROM (SELECT ticker AS id, 'Company' AS label FROM g_company UNION ALL SELECT id, 'Metric' FROM g_metric UNION ALL SELECT id, 'Segment' FROM g_segment)")
def g2_label_union(spark, sf):
    g = Graph(spark, sf)
    parts = ((g.company.select(F.col("ticker").alias("id")), "Company"), (g.metric.select("id"), "Metric"), (g.segment.select("id"), "Segment"))
    return reduce(DataFrame.unionByName, (df.withColumn("label", F.lit(n)) for df, n in parts))


@query("SELECT DISTINCT ticker FROM filing WHERE form_type = '10-K' AND ticker IN (SELECT ticker FROM chunk)")
def g4_intersection(spark, sf):
    g = Graph(spark, sf)
    return g.raw("filing").where("form_type = '10-K'").select("ticker").distinct().join(g.raw("chunk").select("ticker"), "ticker", "left_semi")


@query("SELECT ticker FROM company EXCEPT SELECT upper(trim(ticker)) FROM parsed_document")
def g5_difference(spark, sf):
    g = Graph(spark, sf)
    return g.raw("company").select("ticker").exceptAll(g.raw("parsed_document").select(F.upper(F.trim("ticker")).alias("ticker")).distinct()).distinct()


@query("SELECT id, filing_seq, form_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY filing_seq DESC) AS n FROM filing) WHERE n = 1")
def g7_last_wins(spark, sf):
    return merge.first_wins(Graph(spark, sf).raw("filing").select("id", "filing_seq", "form_type"), ["id"], [F.col("filing_seq").desc()])


@query("SELECT name, arg_min(kind, p) AS kind FROM (SELECT name, 'issuer' AS kind, 0 AS p FROM company UNION ALL SELECT canonical_name, 'reference', 1 FROM canonical_entity UNION ALL SELECT former_name, 'former', 2 FROM canonical_entity WHERE former_name IS NOT NULL) GROUP BY 1")
def g8_priority_merge(spark, sf):
    g = Graph(spark, sf)
    parts = ((g.raw("company").select("name"), "issuer"), (g.raw("canonical_entity").select(F.col("canonical_name").alias("name")), "reference"), (g.raw("canonical_entity").where("former_name IS NOT NULL").select(F.col("former_name").alias("name")), "former"))
    all_ = reduce(DataFrame.unionByName, (df.select("name", F.lit(k).alias("kind"), F.lit(i).alias("p")) for i, (df, k) in enumerate(parts)))
    return all_.groupBy("name").agg(F.min_by("kind", "p").alias("kind"))
