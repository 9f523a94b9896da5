"""Scalar functions over whole tables (groups J, K, L and the smaller ones of U and V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fiscal as K
from ..functions import strings as J
from ..registry import query
from .corpus import _BARE
from .graph import Graph


def raw(spark, sf, name):
    return Graph(spark, sf).raw(name)


_FOLD = "trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '\\.', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '[\\s_]+', ' ', 'g'))"


@query("SELECT mention_id, trim(regexp_replace(regexp_replace(name, '&nbsp;|&#160;|&#xa0;| ', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM extracted_entity")
def j1_clean_text(spark, sf):
    return raw(spark, sf, "extracted_entity").select("mention_id", J.clean_text(F.col("name")).alias("clean"))


@query(f"SELECT canonical_id, {_FOLD.format('canonical_name')} AS folded FROM canonical_entity")
def j4_folded(spark, sf):
    return raw(spark, sf, "canonical_entity").select("canonical_id", J.folded(F.col("canonical_name")).alias("folded"))


@query(f"SELECT ticker, trim(regexp_replace({_FOLD.format('name')}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM company")
def j5_hyphen_slug(spark, sf):
    return raw(spark, sf, "company").select("ticker", J.hyphen_slug(F.col("name")).alias("slug"))


@query("SELECT canonical_id, regexp_replace(lower(strip_accents(canonical_name)), '[^0-9a-z]+', '', 'g') AS slug FROM canonical_entity")
def j6_squash_slug(spark, sf):
    return raw(spark, sf, "canonical_entity").select("canonical_id", J.squash_slug(F.col("canonical_name")).alias("slug"))


@query(f"SELECT ticker, array_to_string(list_sort(list_distinct(list_filter(string_split({_FOLD.format('name')}, ' '), lambda t: length(t) >= 3 AND t NOT IN ('and', 'for', 'from', 'into', 'its', 'that', 'the', 'with')))), ' ') AS tokens FROM company")
def j7_content_tokens(spark, sf):
    return raw(spark, sf, "company").select("ticker", F.array_join(J.content_tokens(F.col("name")), " ").alias("tokens"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}]+(?:[-''’][\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}]+)*|[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]')) AS n FROM documents")
def j9_count_tokens(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", J.count_tokens(F.col("text")).cast("bigint").alias("n"))


@query("SELECT id, CASE WHEN length(w) < 4 OR NOT ends_with(w, 's') OR regexp_matches(w, '(ss|us|is|as|os)$') THEN w WHEN ends_with(w, 'ies') AND length(w) > 4 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(ches|shes|sses|xes|zes)$') THEN left(w, -2) ELSE left(w, -1) END AS singular FROM (SELECT id, lower(list_last(regexp_extract_all(question, '[A-Za-z]+'))) AS w FROM eval_question)")
def j11_singular(spark, sf):
    w = F.lower(F.element_at(F.regexp_extract_all("question", F.lit("[A-Za-z]+"), 0), -1))
    return raw(spark, sf, "eval_question").select("id", J.singular(w).alias("singular"))


_CLEAN = f"regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(trim({_BARE.format('name')}), '\\s*\\([^)]*\\)', '', 'g'), '[''’]s?$', ''), '’', ''''), '\\s+', ' ', 'g'), '^[ \\t\\n\\r.,;:!?''-]+|[ \\t\\n\\r.,;:!?''-]+$', '', 'g')"
_NO_NAMES = ", ".join(f"'{w}'" for w in (*J.PLACEHOLDERS, *J.NON_ENTITY_WORDS))


@query(f"SELECT mention_id, coalesce(length(n) >= 2 AND lower(n) NOT IN ({_NO_NAMES}), false) AS usable FROM (SELECT mention_id, {_CLEAN} AS n FROM extracted_entity)")
def j12_usable_name(spark, sf):
    return raw(spark, sf, "extracted_entity").select("mention_id", J.usable_name(F.col("name")).alias("usable"))


@query("SELECT parsed_id, line_no, trim(cell) AS cell, CASE WHEN regexp_full_match(d, '\\d*\\.?\\d+') THEN CAST(d AS DOUBLE) END AS value, contains(cell, '%') AS is_percent FROM (SELECT parsed_id, line_no, cell, regexp_replace(regexp_replace(cell, '[$%,]', '', 'g'), '\\s+', '', 'g') AS d FROM (SELECT parsed_id, CAST(n AS BIGINT) AS line_no, unnest(string_split(l, '|')) AS cell FROM (SELECT parsed_id, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM parsed_document) WHERE starts_with(l, '|'))) WHERE regexp_full_match(trim(cell), '\\$?[\\d.,]+%?')")
def j18_parse_number_cells(spark, sf):
    lines = raw(spark, sf, "parsed_document").select("parsed_id", F.posexplode(F.split("content", "\n")).alias("at", "l")).where(F.col("l").startswith("|"))
    cells = lines.select("parsed_id", (F.col("at") + 1).cast("bigint").alias("line_no"), F.explode(F.split("l", r"\|")).alias("cell")).where(F.trim("cell").rlike(r"^\$?[\d.,]+%?$"))
    got = cells.withColumn("n", J.parse_number(F.col("cell")))
    return got.select("parsed_id", "line_no", F.trim("cell").alias("cell"), "n.value", "n.is_percent")


@query("SELECT id, array_to_string(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '\\p{Nd}{4}-\\p{Nd}{2}-\\p{Nd}{2}', ' ', 'g'), '\\b\\p{Nd}{1,2}/\\p{Nd}{1,2}/\\p{Nd}{2,4}\\b', ' ', 'g'), '\\(?-?\\p{Nd}[\\p{Nd},]*\\.?\\p{Nd}*\\)?%?'), lambda x: rtrim(x, ',')), lambda x: replace(trim(x, '()%'), ',', '') <> '' AND NOT regexp_full_match(replace(trim(x, '()%'), ',', ''), '\\p{Nd}{4}|0\\p{Nd}{6,9}|\\p{Nd}{1,2}')), ' ') AS figures FROM chunk")
def j20_figures(spark, sf):
    return raw(spark, sf, "chunk").select("id", F.array_join(J.figures(F.col("text")), " ").alias("figures"))


@query("SELECT id, array_to_string(regexp_extract_all(id || ' ' || question, 'EQ-\\d+|E\\d+'), ' ') AS tags FROM eval_question")
def j21_tag_like(spark, sf):
    return raw(spark, sf, "eval_question").select("id", F.array_join(F.regexp_extract_all(F.concat_ws(" ", "id", "question"), F.lit(r"EQ-\d+|E\d+"), 0), " ").alias("tags"))


@query()
def j22_sentences(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", F.posexplode(J.sentences(F.col("text"))).alias("sentence_no", "sentence"))


@query("SELECT id, p AS padded FROM (SELECT id, ' ' || trim(regexp_replace(regexp_replace(lower(question), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || ' ' AS p FROM eval_question)")
def j25_padded(spark, sf):
    return raw(spark, sf, "eval_question").select("id", J.padded(F.col("question")).alias("padded"))


@query("SELECT ticker, array_to_string(list_distinct(list_filter(list_transform(string_split_regex(trim(name), '(?i)[,.]|\\s+(?:inc|corporation|corp|ltd|plc|co|company|holdings)\\b'), lambda p: trim(p)), lambda p: p <> '')), '|') AS forms FROM company")
def j33_issuer_forms(spark, sf):
    return raw(spark, sf, "company").select("ticker", F.array_join(J.issuer_forms(F.col("name")), "|").alias("forms"))


@query("SELECT doc_id, round(coalesce(length(regexp_replace(text, '[^ ]', '', 'g')) / nullif(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')), 0), 0), 6) AS density FROM documents")
def j34_space_density(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", F.round(J.space_density(F.col("text")), 6).alias("density"))


@query("SELECT ticker, sic_code, CASE WHEN starts_with(sic_code, '60') OR starts_with(sic_code, '61') THEN 'banking' WHEN starts_with(sic_code, '7') THEN 'services' WHEN starts_with(sic_code, '2') OR starts_with(sic_code, '3') THEN 'manufacturing' ELSE 'other' END AS area FROM company")
def j36_prefix_map(spark, sf):
    first = [("60", "banking"), ("61", "banking"), ("7", "services"), ("2", "manufacturing"), ("3", "manufacturing")]
    return raw(spark, sf, "company").select("ticker", "sic_code", F.coalesce(*(F.when(F.col("sic_code").startswith(p), F.lit(a)) for p, a in first), F.lit("other")).alias("area"))


@query("SELECT filing_seq, CAST(period_end_date - CAST(90 AS INTEGER) AS DATE) AS start, 91 AS days FROM filing WHERE form_type = '10-Q' AND period_end_date > DATE '1000-01-01'")
def k2_period_span(spark, sf):
    f = raw(spark, sf, "filing").where("form_type = '10-Q' AND period_end_date > DATE'1000-01-01'")
    return f.withColumn("s", K.period_span(F.lit("3M"), F.col("period_end_date"))).select("filing_seq", "s.start", "s.days")


@query("SELECT f.filing_seq, CAST(year(f.filing_date) + CASE WHEN month(f.filing_date) * 100 + day(f.filing_date) > c.fiscal_year_end_month * 100 + 28 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year FROM filing f JOIN company c ON f.ticker = c.ticker WHERE c.fiscal_year_end_month > 0 AND f.filing_date IS NOT NULL")
def k3_fiscal_year(spark, sf):
    c = raw(spark, sf, "company").where("fiscal_year_end_month > 0").select("ticker", "fiscal_year_end_month")
    f = raw(spark, sf, "filing").where("filing_date IS NOT NULL").select("filing_seq", "ticker", "filing_date").join(c, "ticker")
    return f.select("filing_seq", K.fiscal_year(F.col("filing_date"), F.col("fiscal_year_end_month").cast("int"), F.lit(28)).alias("fiscal_year"))


@query("SELECT f.filing_seq, make_date(CASE WHEN month(f.filing_date) * 100 + day(f.filing_date) > c.fiscal_year_end_month * 100 + 28 THEN year(f.filing_date) ELSE year(f.filing_date) - 1 END, c.fiscal_year_end_month, 28) + 1 AS year_start FROM filing f JOIN company c ON f.ticker = c.ticker WHERE c.fiscal_year_end_month > 0 AND f.filing_date > DATE '1000-01-01'")
def k4_fiscal_year_start(spark, sf):
    c = raw(spark, sf, "company").where("fiscal_year_end_month > 0").select("ticker", F.col("fiscal_year_end_month").cast("int").alias("m"))
    f = raw(spark, sf, "filing").where("filing_date > DATE'1000-01-01'").select("filing_seq", "ticker", "filing_date").join(c, "ticker")
    return f.select("filing_seq", K.fiscal_year_start(F.col("filing_date"), F.col("m"), F.lit(28)).alias("year_start"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN d2 - d1 + 1 < 28 OR CAST(d2 AS DATE) - greatest(d1, make_date(year(d2), 1, 1)) + 1 >= CASE WHEN d1 < make_date(year(d2), 1, 1) THEN make_date(year(d2), 1, 1) - d1 ELSE 0 END THEN year(d2) ELSE year(d2) - 1 END AS calendar_year FROM (SELECT l_orderkey, l_partkey, l_suppkey, CAST(o_orderdate AS DATE) AS d1, CAST(l_shipdate AS DATE) AS d2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def k9_calendar_year(spark, sf):
    g = Graph(spark, sf)
    l = g.raw("lineitem").join(g.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return l.select("l_orderkey", "l_partkey", "l_suppkey", K.calendar_year_overlap(F.to_date("o_orderdate"), F.to_date("l_shipdate")).cast("bigint").alias("calendar_year"))


@query("SELECT filing_seq, CAST(CASE WHEN filing_date <> DATE '0001-01-01' AND period_end_date <> DATE '0001-01-01' THEN filing_date - period_end_date END AS INTEGER) AS lag FROM filing")
def k10_reporting_lag(spark, sf):
    return raw(spark, sf, "filing").select("filing_seq", K.reporting_lag(F.col("period_end_date"), F.col("filing_date")).alias("lag"))


@query("SELECT filing_seq, 'FY' || (year(filing_date) + CASE WHEN month(filing_date) > 9 THEN 1 ELSE 0 END) || '-Q' || CAST(floor(((month(filing_date) - 10 + 12) % 12) / 3) + 1 AS INTEGER) AS label FROM filing WHERE filing_date IS NOT NULL")
def k11_quarter_label(spark, sf):
    return raw(spark, sf, "filing").where("filing_date IS NOT NULL").select("filing_seq", K.quarter_label(F.col("filing_date"), F.lit(9)).alias("label"))


@query("SELECT parsed_id, coalesce(try_strptime(filing_date, '%Y-%m-%d'), try_strptime(filing_date, '%m/%d/%Y'))::DATE AS filing_date FROM parsed_document")
def k14_dates(spark, sf):
    return raw(spark, sf, "parsed_document").select("parsed_id", K.iso_date(F.col("filing_date")).alias("filing_date"))


@query("SELECT parsed_id, coalesce(TRY_CAST(nullif(trim(fiscal_year), '') AS BIGINT), -1) AS fiscal_year, coalesce(try_strptime(left(filing_date, 10), '%Y-%m-%d')::DATE, DATE '0001-01-01') AS filing_date, coalesce(ticker, '') AS ticker FROM parsed_document")
def load_coercion(spark, sf):
    p = raw(spark, sf, "parsed_document")
    return p.select("parsed_id", K.coerced(F.col("fiscal_year"), "bigint").alias("fiscal_year"), K.coerced(F.col("filing_date"), "date").alias("filing_date"), K.coerced(F.col("ticker"), "string").alias("ticker"))


@query("SELECT filing_seq, left(sha1(concat_ws(chr(31), coalesce(ticker, 'None'), coalesce(form_type, 'None'), coalesce(CAST(fiscal_year AS VARCHAR), 'None'), coalesce(accession, 'None'))), 16) AS content_id FROM filing")
def stable_identity(spark, sf):
    return raw(spark, sf, "filing").select("filing_seq", K.stable_id(*map(F.col, ("ticker", "form_type", "fiscal_year", "accession"))).alias("content_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def l3_json_field(spark, sf):
    return raw(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT id, CAST(i AS INTEGER) AS i, array_to_string(g, '+') AS tags FROM (SELECT id, unnest(acceptable) AS g, generate_subscripts(acceptable, 1) AS i FROM eval_question)")
def l1_exploded_sets(spark, sf):
    return raw(spark, sf, "eval_question").select("id", F.posexplode("acceptable").alias("i", "g")).select("id", (F.col("i") + 1).alias("i"), F.array_join("g", "+").alias("tags"))


@query("SELECT filing_id, array_to_string(list_sort(list_distinct(list(section))), ';') AS sections FROM chunk GROUP BY 1")
def l8_joined_lists(spark, sf):
    return raw(spark, sf, "chunk").groupBy("filing_id").agg(F.array_join(F.sort_array(F.collect_set("section")), ";").alias("sections"))


@query("SELECT filing_id, id, 'E' || row_number() OVER (PARTITION BY filing_id ORDER BY chunk_index, id) AS tag FROM chunk")
def l9_positional_tags(spark, sf):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("filing_id").orderBy("chunk_index", "id"))
    return raw(spark, sf, "chunk").select("filing_id", "id", F.concat(F.lit("E"), n.cast("string")).alias("tag"))


@query("SELECT id, CASE WHEN regexp_matches(t, 'material|significant') THEN 'high' WHEN contains(t, 'could have') THEN 'medium' WHEN regexp_matches(t, '\\bmay\\b|\\bmight\\b') THEN 'low' ELSE 'medium' END AS severity FROM (SELECT id, lower(text) AS t FROM chunk)")
def u3_ordered_cues(spark, sf):
    t = F.lower("text")
    return raw(spark, sf, "chunk").select("id", F.when(t.rlike("material|significant"), "high").when(t.contains("could have"), "medium").when(t.rlike(r"\bmay\b|\bmight\b"), "low").otherwise("medium").alias("severity"))


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE text = '') AS n_empty, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1")
def u6_corpus_tally(spark, sf):
    return raw(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "").alias("n_empty"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal) >= 1e3 AND c_acctbal > 0 THEN printf('$%.2fK', c_acctbal / 1e3) ELSE printf('$%.2f', c_acctbal) END AS shown FROM customer WHERE abs(c_acctbal * 1000 - floor(c_acctbal * 1000)) < 1")
def h8_large_numbers(spark, sf):
    from ..operators.series import large

    return raw(spark, sf, "customer").select("c_custkey", large(F.col("c_acctbal")).alias("shown"))
