"""Documents, entity resolution, retrieval, grading, sources and sinks over whole tables (groups A, M, N, O, P, V)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import strings as J
from ..operators import documents as M
from ..operators import grading, merge, pattern, ranking, resolution
from ..operators.drift import readable
from ..registry import query
from ..session import new_folder
from ..sources import files as A
from .graph import Graph


def raw(spark, sf, name):
    return Graph(spark, sf).raw(name)


# -- A: sources and sinks, as round trips through the shared folder ------------------------------------------------------------


@query("SELECT filing_seq, coalesce(fiscal_year, -1) AS fiscal_year, filing_date, form_type FROM filing")
def a15_spill_round_trip(spark, sf):
    f = raw(spark, sf, "filing").select("filing_seq", F.coalesce("fiscal_year", F.lit(-1)).alias("fiscal_year"), "filing_date", "form_type")
    at = new_folder(spark, "spill")
    A.spill(f, at)
    return A.spilled(spark, at, f.schema)


@query("SELECT id, filing_seq FROM (SELECT id, filing_seq, row_number() OVER (PARTITION BY id ORDER BY filing_seq DESC) AS n FROM filing WHERE id IS NOT NULL) WHERE n = 1")
def a19_upsert(spark, sf):
    f = raw(spark, sf, "filing").where("id IS NOT NULL").select("id", "filing_seq", "batch_no")
    stored = merge.first_wins(f.where("batch_no = 0"), ["id"], [F.col("filing_seq").desc()])
    return A.upserted(stored, f.where("batch_no > 0"), "id", "filing_seq").select("id", "filing_seq")


@query("SELECT file_name AS file, count(*) AS n_lines, count(*) FILTER (WHERE NOT json_valid(raw)) AS n_bad FROM run_report GROUP BY 1")
def a22_staged_lines(spark, sf):
    r = raw(spark, sf, "run_report")
    return r.groupBy(F.col("file_name").alias("file")).agg(F.count("*").alias("n_lines"), F.count_if(~readable(F.col("raw"))).alias("n_bad"))


@query("SELECT * FROM (VALUES ('fiscal_year', 'bigint', NULL), ('cik', NULL, 'string'), ('is_current', NULL, 'string')) v(name, found, expected) WHERE name = 'never' UNION ALL SELECT 'region', NULL, 'string' UNION ALL SELECT 'sic_code', 'string', NULL")
def a25_schema_diff(spark, sf):
    c = raw(spark, sf, "company")
    expected = A.schema_of([x for x in c.columns if x != "sic_code"] + ["region"])
    return A.schema_diff(spark, c, expected)


@query("SELECT ticker, name, CAST(NULL AS VARCHAR) AS region FROM company")
def a26_rebuilt(spark, sf):
    return A.rebuilt(raw(spark, sf, "company"), A.schema_of(["ticker", "name", "region"]))


@query("SELECT CAST(batch_no AS VARCHAR) AS name, max(retrieved_at) AS created FROM filing WHERE batch_no IS NOT NULL GROUP BY batch_no ORDER BY created DESC, name OFFSET 5")
def a28_retention(spark, sf):
    b = raw(spark, sf, "filing").where("batch_no IS NOT NULL").groupBy(F.col("batch_no").cast("string").alias("name")).agg(F.max("retrieved_at").alias("created"))
    return A.retained(b, 5)


@query("SELECT ticker, 'Record in [company]: ticker is ' || ticker || ', name is ' || name || CASE WHEN coalesce(sector, '') <> '' THEN ', sector is ' || sector ELSE '' END || '.' AS sentence FROM company")
def a8_row_sentences(spark, sf):
    c = raw(spark, sf, "company").select("ticker", "name", "sector")
    return c.select("ticker", M.row_sentences(c, "company").alias("sentence"))


@query("SELECT ticker, CAST(c AS INTEGER) AS col_no, CASE c WHEN 1 THEN ticker WHEN 2 THEN name END AS cell FROM company, (VALUES (1), (2)) v(c)")
def a7_html_cells(spark, sf):
    """Cells of an HTML table rendered from each row."""
    escaped = F.regexp_replace(F.regexp_replace("name", "&", "&amp;"), "<", "&lt;")
    html = F.concat(F.lit("<html><head><title>x</title></head><body><p>a</p><table><tr><td> "), "ticker", F.lit("</td><td><b>"), escaped, F.lit("</b></td></tr></table>"))
    return M.html_cells(raw(spark, sf, "company").select("ticker", html.alias("h")), "ticker", "h").select("ticker", "col_no", "cell")


@query("SELECT filing_seq, 'us-gaap:Lag' AS tag, CAST(reporting_lag_in_days * 1000 AS DOUBLE) AS value FROM filing WHERE reporting_lag_in_days IS NOT NULL")
def m12_inline_facts(spark, sf):
    """Inline tagged facts rendered from each row."""
    lag = F.col("reporting_lag_in_days")
    html = F.concat(F.lit('<p>Lag <ix:nonFraction name="us-gaap:Lag" contextRef="c1" scale="3" sign="'), F.when(lag < 0, "-").otherwise(""), F.lit('" unitRef="d"><b>'), F.abs(lag).cast("string"), F.lit("</b></ix:nonFraction></p>"))
    f = raw(spark, sf, "filing").where(lag.isNotNull()).select("filing_seq", html.alias("h"))
    return M.xbrl_facts(f, "filing_seq", "h").select("filing_seq", "tag", "value")


# -- M: documents --------------------------------------------------------------------------------------------------------------


@query("SELECT id, CAST(w AS INTEGER) AS window_no, CAST(w * 350 AS INTEGER) AS token_start, CAST(least(w * 350 + 400, n) AS INTEGER) AS token_end FROM (SELECT id, n, unnest(range(0, CAST(greatest(ceil((n - 400) / 350.0), 0) AS BIGINT) + 1)) AS w FROM (SELECT id, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}]+(?:[-''’][\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}]+)*|[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]')) AS n FROM chunk) WHERE n > 0)")
def m9_token_windows(spark, sf):
    return M.token_windows(raw(spark, sf, "chunk"), "id", "text", 400, 50).select("id", "window_no", "token_start", "token_end")


@query("SELECT parsed_id, CAST(p AS INTEGER) AS page, length(substr(content, (p - 1) * 3000 + 1, 3000)) AS n FROM (SELECT parsed_id, content, unnest(range(1, CAST(ceil(length(content) / 3000.0) AS BIGINT) + 1)) AS p FROM parsed_document WHERE length(content) > 0)")
def m11_pages(spark, sf):
    return M.pages(raw(spark, sf, "parsed_document"), "parsed_id", "content").select("parsed_id", "page", F.length("text").cast("bigint").alias("n"))


@query()
def m8_char_chunks(spark, sf):
    return M.char_chunks(raw(spark, sf, "parsed_document"), "parsed_id", "content")


@query()
def m10_markdown_chunks(spark, sf):
    return M.markdown_chunks(raw(spark, sf, "parsed_document"), "parsed_id", "content")


@query("SELECT parsed_id, count(*) AS n_cells FROM (SELECT parsed_id, unnest(string_split(regexp_replace(trim(l), '^\\||\\|$', '', 'g'), '|')) AS c FROM (SELECT parsed_id, unnest(string_split(replace(content, chr(13), ''), chr(10))) AS l FROM parsed_document) WHERE regexp_full_match(trim(l), '\\|.*\\|') AND NOT regexp_full_match(trim(l), '\\|[\\s|:-]+\\|')) GROUP BY 1")
def m4_pipe_table_cells(spark, sf):
    return M.pipe_tables(raw(spark, sf, "parsed_document"), "parsed_id", "content").groupBy("parsed_id").agg(F.count("*").alias("n_cells"))


@query()
def m14_item_sections(spark, sf):
    """Sections of texts assembled from each filing's chunks in order."""
    c = raw(spark, sf, "chunk").where("section IS NOT NULL AND text IS NOT NULL")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.concat(F.lit("\n"), "section", F.lit(". Title\n"), "text").alias("t")))), lambda x: x["t"]), "\n")
    return M.item_sections(c.groupBy("filing_id").agg(body.alias("text")), "filing_id", "text")


_CUES = [("depends_on", "we depend on"), ("offsets", "partly offset by"), ("drives", "mainly because of"), ("exposes", "could interrupt|would weigh on")]
_OUTCOMES = [("margin", "margin"), ("revenue", "revenue|sales"), ("cash", "cash flow|capital expenditure"), ("cost", "cost|expense")]


@query()
def m17_cue_relations(spark, sf):
    return M.cue_relations(raw(spark, sf, "filing"), "filing_seq", "content", _CUES, _OUTCOMES)


@query("SELECT filing_seq, nullif(upper(regexp_extract(document_title, '(?i)\\b(10-[KQ](?:/A)?|8-K(?:/A)?|DEF 14A|S-\\d)\\b', 1)), '') AS form_type FROM filing")
def m1_metadata(spark, sf):
    return raw(spark, sf, "filing").select("filing_seq", M.filing_metadata(F.col("document_title"))["form_type"].alias("form_type"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '(?:^|[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}])(\\p{Lu}[\\p{L}\\p{M}''’-]+(?:[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+\\p{Lu}[\\p{L}\\p{M}''’-]+){0,3})', 1))) AS n FROM documents")
def m28_capitalised_spans(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", F.size(M.capitalised_spans(F.col("text"))).cast("bigint").alias("n"))


# -- N: entity resolution ------------------------------------------------------------------------------------------------------

# Full-width letters and ligatures as ordinary ones, for SQL.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_PLAIN = "translate({0}, '" + _WIDE + "', '" + _NARROW.replace("'", "''") + "')"
_PLAIN = _PLAIN.replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}")
for _a, _b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ß", "ss"), ("™", "tm")):
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"
_BARE = f"regexp_replace(strip_accents({_PLAIN}), '\\p{{{{Mn}}}}+', '', 'g')"
_KEY = f"trim(regexp_replace(regexp_replace(regexp_replace(lower({_BARE.format('name')}), '\\.', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '[\\s_]+', ' ', 'g'))"


@query(f"SELECT entity_type, arg_min(name, mention_id) AS display, count(DISTINCT name) AS n_spellings, count(*) AS n_mentions FROM (SELECT entity_type, name, mention_id, {_KEY} AS k FROM extracted_entity) WHERE k <> '' GROUP BY entity_type, k")
def n1_registry(spark, sf):
    return resolution.register(raw(spark, sf, "extracted_entity"), ["entity_type"], "name", "mention_id").drop("entity_id")


@query(f"SELECT entity_type, count(DISTINCT {_KEY}) AS n_entities, count(*) AS n_mentions FROM extracted_entity WHERE {_KEY} <> '' GROUP BY 1")
def v12_resolution_report(spark, sf):
    e = raw(spark, sf, "extracted_entity")
    return resolution.register(e, ["entity_type"], "name", "mention_id").groupBy("entity_type").agg(F.count("*").alias("n_entities"), F.sum("n_mentions").alias("n_mentions"))


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '\\.', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '[\\s_]+', ' ', 'g')), ' '), lambda t: length(t) >= 3 AND t NOT IN (" + ", ".join(f"'{w}'" for w in J.STOPWORDS) + ")))"


@query(
    f"WITH n AS (SELECT id, unnest(w) AS word, w FROM (SELECT mention_id AS id, {_WORDS.format('name')} AS w FROM extracted_entity WHERE name IS NOT NULL)), k AS (SELECT canonical_id, unnest(w) AS word, w FROM (SELECT canonical_id, {_WORDS.format('canonical_name')} AS w FROM canonical_entity)), "
    "j AS (SELECT DISTINCT id, canonical_id, len(list_intersect(n.w, k.w)) / len(list_distinct(list_concat(n.w, k.w))) AS jaccard FROM n JOIN k USING (word)) SELECT id, canonical_id AS known_id, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.5 - 1e-9"
)
def n4_candidates(spark, sf):
    """All pairs of names and known names at least half of whose words are common, through the prefix filter."""
    names = raw(spark, sf, "extracted_entity").where("name IS NOT NULL").select(F.col("mention_id").alias("id"), "name")
    known = raw(spark, sf, "canonical_entity").select(F.col("canonical_id").alias("known_id"), F.col("canonical_name").alias("known_name"))
    both = resolution.candidates(names, known, 0.5).join(names, "id").join(known, "known_id")
    j = J.jaccard(J.content_tokens(F.col("name")), J.content_tokens(F.col("known_name")))
    return both.select("id", "known_id", F.round(j, 6).alias("jaccard")).where("jaccard >= 0.5 - 1e-9")


@query()
def n5_best_fuzzy(spark, sf):
    names = raw(spark, sf, "extracted_entity").where("name IS NOT NULL").groupBy("name").agg(F.min("mention_id").alias("id"))
    known = raw(spark, sf, "canonical_entity").select(F.col("canonical_id").alias("known_id"), F.col("canonical_name").alias("known_name"))
    return resolution.best_fuzzy(names.select("id", "name"), known, 0.6)


@query("WITH m AS (SELECT id, min(canonical_id) AS canonical_id FROM (SELECT ticker AS id, canonical_id FROM canonical_entity WHERE ticker IS NOT NULL UNION ALL SELECT canonical_name, canonical_id FROM canonical_entity) GROUP BY 1) SELECT DISTINCT a.canonical_id AS src, b.canonical_id AS dst, entity_type AS rel FROM extracted_entity e JOIN m a ON e.ticker = a.id JOIN m b ON e.name = b.id WHERE a.canonical_id <> b.canonical_id")
def n8_resolved_subgraph(spark, sf):
    e = raw(spark, sf, "extracted_entity").where("ticker IS NOT NULL AND name IS NOT NULL").select(F.col("ticker").alias("src"), F.col("name").alias("dst"), F.col("entity_type").alias("rel"))
    c = raw(spark, sf, "canonical_entity")
    both = c.select(F.col("ticker").alias("id"), F.col("canonical_id").alias("entity_id")).where("id IS NOT NULL").unionByName(c.select(F.col("canonical_name").alias("id"), F.col("canonical_id").alias("entity_id")))
    return resolution.resolved_edges(e, both.groupBy("id").agg(F.min("entity_id").alias("entity_id")))[0]


# -- O: retrieval --------------------------------------------------------------------------------------------------------------

# Words that are written in capitals and are no tickers.
STOP = (
    "WHAT WHEN WHERE WHICH WHO WHOM WHY HOW CAN COULD DO DOES DID DONE WILL WOULD SHALL SHOULD MAY MIGHT MUST IS ARE WAS WERE BE BEEN BEING "
    "HAVE HAS HAD HAVING GET GOT TELL SHOW GIVE FIND THE A AN AND OR BUT IF THEN ELSE SO FOR NOR YET IN ON AT TO OF BY FROM WITH WITHOUT ABOUT "
    "AGAINST BETWEEN INTO THROUGH DURING BEFORE AFTER ABOVE BELOW UNDER OVER UP DOWN OFF OUT NEAR ALL ANY BOTH EACH FEW MORE MOST OTHER SOME SUCH NO NOT "
    "ONLY OWN SAME THAN TOO VERY JUST ALSO NOW HERE THERE THIS THAT THESE THOSE I ME MY YOU YOUR HE HIM HIS SHE HER IT ITS WE US OUR THEY THEM THEIR "
    "FY SEC CEO CFO COO CTO CIO USD EUR GBP JPY CAD AUD GAAP EPS EBIT EBITDA CAGR PE PB ROE ROA ROIC DCF WACC IRR NPV IPO NAV AUM RAG "
    "LLM AI API ML NLP CPU GPU TPU Q1 Q2 Q3 Q4 H1 H2 K Q YOY MOM QOQ TTM ITEM NOTE FORM RISK RISKS COST COSTS DEBT CASH "
    "TAX TAXES NET GROSS TOTAL FLOW FLOWS SHARE SHARES GROWTH MARGIN INCOME PROFIT LOSS REPORT FILING YEAR "
    "ANNUAL LATEST PRICE VALUE BREAK SALES REVENUE TOP LINE SEGMENT EVENT CHUNK TABLE DATA CORPUS JP"
).split()


def routed(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """O1, O2: id, ticker, route, fiscal_year, quarter, form_type of questions (id, question): a cashtag first, then a company's name, the
    longest first, then a capital token; KNOWN if the ticker is listed, COLD_START if not, AMBIGUOUS without any."""
    q = F.col("question")
    words = questions.select("id", F.explode(F.array_distinct(F.split(F.trim(J.padded(q)), " "))).alias("w"))
    names = companies.select("ticker", F.trim(J.padded(F.col("name"))).alias("n"), F.split(F.trim(J.padded(F.col("name"))), " ")[0].alias("w"))
    by_name = words.join(names.where(F.length("w") >= 4), "w").groupBy("id").agg(F.max_by("ticker", F.struct(F.length("n").alias("l"), "ticker")).alias("named"))
    upper = F.try_element_at(F.filter(F.regexp_extract_all(F.regexp_replace(q, "['’]s\\b", ""), F.lit(r"\b[A-Z]{2,5}\b"), 0), lambda t: ~t.isin(*STOP)), F.lit(1))
    got = questions.join(by_name, "id", "left").withColumn("ticker", F.coalesce(F.nullif(F.upper(F.regexp_extract("question", r"\$([A-Za-z]{1,5})\b", 1)), F.lit("")), F.col("named"), upper))
    known = companies.select("ticker", F.lit(True).alias("listed")).distinct()
    first = lambda p: F.nullif(F.upper(F.regexp_extract("question", p, 1)), F.lit(""))
    out = got.join(known, "ticker", "left")
    return out.select("id", "ticker", F.when(F.col("ticker").isNull(), "AMBIGUOUS").when(F.col("listed"), "KNOWN").otherwise("COLD_START").alias("route"), first(r"\b(20\d{2})\b").cast("int").alias("fiscal_year"), first(r"(?i)\b(Q[1-4]|FY|H[12])\b").alias("quarter"), first(r"(?i)\b(10-K|10-Q|8-K|DEF 14A)\b").alias("form_type"))


@query("SELECT id, TRY_CAST(nullif(regexp_extract(question, '\\b(20\\d{2})\\b', 1), '') AS INTEGER) AS fiscal_year, nullif(upper(regexp_extract(question, '(?i)\\b(Q[1-4]|FY|H[12])\\b', 1)), '') AS quarter FROM eval_question")
def o2_temporal_filters(spark, sf):
    return routed(raw(spark, sf, "eval_question"), raw(spark, sf, "company")).select("id", "fiscal_year", "quarter")


@query()
def o1_routing(spark, sf):
    return routed(raw(spark, sf, "eval_question"), raw(spark, sf, "company"))


_ASKED = ("revenue", "recognition", "inventory", "goodwill")
_BUSINESS = ("distributor", "auditor", "currency")


@query("SELECT id, CAST(score AS INTEGER) AS score FROM (SELECT id, contains(t, 'revenue')::INT + contains(t, 'recognition')::INT + contains(t, 'inventory')::INT + contains(t, 'goodwill')::INT + 2 * (contains(t, 'distributor')::INT + contains(t, 'auditor')::INT + contains(t, 'currency')::INT) AS score FROM (SELECT id, lower(text) AS t FROM chunk)) WHERE score > 0 ORDER BY score DESC, id LIMIT 8")
def o5_chunk_scores(spark, sf):
    """The top chunks by words asked for and, counting double, business words."""
    return scored_chunks(raw(spark, sf, "chunk"), _ASKED, _BUSINESS).select("id", "score").orderBy(F.col("score").desc(), "id").limit(8)


def scored_chunks(chunks: DataFrame, asked: tuple[str, ...], business: tuple[str, ...]) -> DataFrame:
    low = F.lower("text")
    score = sum(low.contains(w).cast("int") for w in asked) + 2 * sum(low.contains(w).cast("int") for w in business)
    return chunks.withColumn("score", score).where("score > 0")


@query(
    "WITH f AS (SELECT * FROM (SELECT id, form_type, upper(ticker) AS issuer, nullif(period_end_date, DATE '0001-01-01') AS period_end, filing_seq, row_number() OVER (PARTITION BY form_type, upper(ticker) ORDER BY nullif(period_end_date, DATE '0001-01-01') DESC NULLS LAST, filing_seq) AS rank FROM filing WHERE upper(ticker) IN ('QVEX', 'XWGG')) WHERE rank <= 3), "
    "c AS (SELECT c.id, f.form_type, f.issuer, contains(lower(text), 'revenue')::INT + contains(lower(text), 'recognition')::INT + contains(lower(text), 'inventory')::INT + contains(lower(text), 'goodwill')::INT + 2 * (contains(lower(text), 'distributor')::INT + contains(lower(text), 'auditor')::INT + contains(lower(text), 'currency')::INT) AS score FROM (SELECT DISTINCT id, text, filing_id FROM chunk) c JOIN (SELECT id, min(form_type) AS form_type, min(issuer) AS issuer FROM f GROUP BY 1) f ON c.filing_id = f.id) "
    "SELECT kind, id, issuer, CAST(score AS INTEGER) AS score, 'E' || row_number() OVER (ORDER BY kind, score DESC, id) AS tag FROM (SELECT 'filing' AS kind, id, min(issuer) AS issuer, 0 AS score FROM f GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'passage', id, issuer, score FROM c WHERE score > 0 ORDER BY score DESC, form_type <> '10-K', id LIMIT 8))"
)
def flagship_financial_context(spark, sf):
    """The evidence for a question about two issuers: their latest periods per form, the best passages of those filings, and tags."""
    f = raw(spark, sf, "filing").withColumn("issuer", F.upper("ticker")).where(F.col("issuer").isin("QVEX", "XWGG"))
    f = f.select("id", "form_type", "issuer", F.nullif("period_end_date", F.lit("0001-01-01").cast("date")).alias("period_end"), "filing_seq")
    kept = ranking.top_k(f, ["form_type", "issuer"], [F.col("period_end").desc_nulls_last(), F.col("filing_seq")], 3)
    own = kept.groupBy("id").agg(F.min("form_type").alias("form_type"), F.min("issuer").alias("issuer"))
    chunks = raw(spark, sf, "chunk").select("id", "text", F.col("filing_id")).join(own.withColumnRenamed("id", "filing_id"), "filing_id").dropDuplicates(["id"])
    best = scored_chunks(chunks, _ASKED, _BUSINESS).orderBy(F.col("score").desc(), (F.col("form_type") != "10-K").cast("int"), "id").limit(8)
    both = own.select(F.lit("filing").alias("kind"), "id", "issuer", F.lit(0).alias("score")).unionByName(best.select(F.lit("passage").alias("kind"), "id", "issuer", "score"))
    # A few rows: the tags number what the caps above have left.
    return both.withColumn("tag", F.concat(F.lit("E"), F.row_number().over(W.orderBy("kind", F.col("score").desc(), "id")).cast("string")))


@query("SELECT DISTINCT ticker FROM extracted_entity WHERE ticker IS NOT NULL AND ticker NOT IN (SELECT ticker FROM company)")
def o11_unknown_companies(spark, sf):
    g = Graph(spark, sf)
    asked = g.raw("extracted_entity").where("ticker IS NOT NULL").select("ticker").distinct()
    return asked.join(g.raw("company").select("ticker"), "ticker", "left_anti")


# -- P: grading ----------------------------------------------------------------------------------------------------------------


def _answers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """An answer and two lines of evidence made of each evaluation question: the expected text, and a cited, a hedged and an uncited
    sentence with numbers."""
    e = raw(spark, sf, "eval_question")
    n = (F.crc32(F.col("id").cast("binary")) % 9000 + 1000).cast("string")
    good = F.crc32(F.concat("id", F.lit("x")).cast("binary")) % 3 != 0
    answer = F.concat(F.lit("Net sales were "), n, F.lit(",5 million [E1]. This may suggest growth. "), F.when(good, F.lit("The margin held [E2].")).otherwise(F.lit("Sales rose to 77,777 million.")))
    answers = e.select(F.col("id").alias("answer_id"), "question", F.regexp_replace(answer, ",5 million", " million").alias("answer"))
    evidence = e.select(F.col("id").alias("answer_id"), F.explode(F.array(F.struct(F.lit("E1").alias("tag"), F.concat(F.lit("Net sales "), n).alias("text")), F.struct(F.lit("E2").alias("tag"), F.lit("The margin held").alias("text")))).alias("x")).select("answer_id", "x.*", F.lit("QVEX").alias("issuer"))
    return answers, evidence


@query()
def graded_sentences(spark, sf):
    return grading.graded_sentences(*_answers(spark, sf)).select("answer_id", "sentence_no", "provenance", F.array_join("ungrounded", ",").alias("ungrounded"))


@query()
def answer_verdicts(spark, sf):
    a, e = _answers(spark, sf)
    return grading.verdicts(a, grading.graded_sentences(a, e))


@query()
def answer_match_rate(spark, sf):
    a, e = _answers(spark, sf)
    expected = raw(spark, sf, "eval_question").select(F.col("id").alias("answer_id"), "acceptable")
    return grading.match_rate(grading.graded_sentences(a, e), expected)


@query("SELECT doc_id, annotator, abusive IS NOT DISTINCT FROM major AS agrees FROM content_label JOIN (SELECT doc_id, CASE WHEN avg(abusive) > 0.5 THEN 1 ELSE 0 END AS major FROM content_label WHERE abusive IS NOT NULL GROUP BY 1) USING (doc_id)")
def label_agreement(spark, sf):
    """Judgements held against the majority, as for pass and fail."""
    c = raw(spark, sf, "content_label")
    major = c.where("abusive IS NOT NULL").groupBy("doc_id").agg(F.when(F.avg("abusive") > 0.5, 1).otherwise(0).alias("major"))
    return c.join(major, "doc_id").select("doc_id", "annotator", F.col("abusive").eqNullSafe(F.col("major")).alias("agrees"))


# -- V -------------------------------------------------------------------------------------------------------------------------


@query("SELECT section, count(*) AS n, round(avg(token_count), 4) AS mean_tokens, CAST(max(token_count) AS BIGINT) AS most_tokens FROM chunk GROUP BY 1")
def v19_report_by_group(spark, sf):
    return raw(spark, sf, "chunk").groupBy("section").agg(F.count("*").alias("n"), F.round(F.avg("token_count"), 4).alias("mean_tokens"), F.max("token_count").alias("most_tokens"))


@query("SELECT filing_id, id, sha1(coalesce(filing_id, '') || chr(31) || CAST(row_number() OVER (PARTITION BY filing_id ORDER BY chunk_index, id) - 1 AS VARCHAR)) AS position_id FROM chunk")
def v10_positional_ids(spark, sf):
    n = F.row_number().over(W.partitionBy("filing_id").orderBy("chunk_index", "id")) - 1
    return raw(spark, sf, "chunk").select("filing_id", "id", F.sha1(F.concat(F.coalesce("filing_id", F.lit("")), F.lit("\u001f"), n.cast("string")).cast("binary")).alias("position_id"))


@query("SELECT filing_id, id, lag(id, 1) OVER w AS before, lead(id, 1) OVER w AS after FROM chunk WINDOW w AS (PARTITION BY filing_id ORDER BY chunk_index, id)")
def v9_neighbours(spark, sf):
    o = W.partitionBy("filing_id").orderBy("chunk_index", "id")
    return raw(spark, sf, "chunk").select("filing_id", "id", F.lag("id").over(o).alias("before"), F.lead("id").over(o).alias("after"))


@query("SELECT max(len) AS longest FROM (SELECT user_id, grp, count(*) AS len FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS grp FROM events) WHERE event_type = 'error' GROUP BY 1, 2)")
def v18_longest_failure_run(spark, sf):
    """The longest run of failures, by gaps and islands."""
    e = raw(spark, sf, "events")
    a, b = (F.row_number().over(W.partitionBy(*k).orderBy("ts", "event_id")) for k in (["user_id"], ["user_id", "event_type"]))
    runs = e.select("user_id", "event_type", (a - b).alias("run")).where("event_type = 'error'").groupBy("user_id", "run").agg(F.count("*").alias("n"))
    return runs.agg(F.max("n").alias("longest"))


@query("SELECT c.canonical_id, count(DISTINCT m.mention_id) AS n FROM canonical_entity c JOIN extracted_entity m ON lower(m.name) = lower(c.canonical_name) GROUP BY 1")
def v15_name_lookup(spark, sf):
    g = Graph(spark, sf)
    c = g.raw("canonical_entity").select("canonical_id", F.lower("canonical_name").alias("k"))
    return g.raw("extracted_entity").select("mention_id", F.lower("name").alias("k")).join(c, "k").groupBy("canonical_id").agg(F.count_distinct("mention_id").alias("n"))


@query("SELECT event_type, day, round(close, 6) AS close, round(close - p, 6) AS change, round(CASE WHEN p <> 0 THEN (close - p) / p * 100 END, 2) AS percent FROM (SELECT *, lag(close) OVER (PARTITION BY event_type ORDER BY day) AS p FROM (SELECT event_type, CAST(ts AS DATE) AS day, max(value) AS close FROM events GROUP BY 1, 2))")
def v16_quotes(spark, sf):
    d = raw(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("close"))
    p = F.lag("close").over(W.partitionBy("event_type").orderBy("day"))
    return d.select("event_type", "day", F.round("close", 6).alias("close"), F.round(F.col("close") - p, 6).alias("change"), F.round(F.try_divide(F.col("close") - p, p) * 100, 2).alias("percent"))


@query("SELECT 'matched' AS side, count(*) AS n FROM extracted_entity WHERE chunk_id IN (SELECT id FROM chunk) UNION ALL SELECT 'orphan', count(*) FROM extracted_entity WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT id FROM chunk) UNION ALL SELECT 'none', count(*) FROM extracted_entity WHERE chunk_id IS NULL")
def v4_expected_vs_present(spark, sf):
    g = Graph(spark, sf)
    e = g.raw("extracted_entity").select("chunk_id")
    here, gone = pattern.endpoints_stored(e.select(F.col("chunk_id").alias("src"), F.lit("x").alias("dst")), g.raw("chunk"), "id", e.sparkSession.createDataFrame([("x",)], "dst string"), "dst")
    marked = here.select(F.lit("matched").alias("side")).unionByName(gone.select(F.when(F.col("src").isNull(), "none").otherwise("orphan").alias("side")))
    counts = marked.groupBy("side").agg(F.count("*").alias("n"))
    return spark.createDataFrame([("matched",), ("orphan",), ("none",)], "side string").join(counts, "side", "left").na.fill(0, ["n"])
