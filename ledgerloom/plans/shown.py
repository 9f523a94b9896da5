"""Sources, functions and streams that other plans only use in passing, each over a whole table (groups A, C, D, F, J, K, L and R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fiscal as K
from ..functions import strings as J
from ..operators.documents import html_text
from ..registry import query
from ..session import new_folder
from ..sources import files as A
from ..streaming import loads
from .graph import Graph


def raw(spark, sf, name):
    return Graph(spark, sf).raw(name)


# -- A, L1: sources --------------------------------------------------------------------------------------------------------------


def _tree(spark, sf):
    """The companies' names as text files under folders of sector, month and form."""
    at = new_folder(spark, "tree")
    c = raw(spark, sf, "company").where("sector IS NOT NULL")
    c.select(F.regexp_replace("sector", "[^A-Za-z]", "").alias("company"), F.lit("2024").alias("year"), F.lit("10k").alias("form"), F.col("name").alias("value")).repartition("company").write.partitionBy("company", "year", "form").text(at)
    bare = lambda x: F.regexp_replace(x, "^[a-z]+=", "")
    return A.filing_tree(spark, at).withColumns({x: bare(x) for x in ("company", "year", "form")})


_SECTOR = "regexp_replace(sector, '[^A-Za-z]', '', 'g')"


@query(f"SELECT {_SECTOR} AS company, '2024' AS year, '10k' AS form, sum(octet_length(encode(name)) + 1)::BIGINT AS n_bytes FROM company WHERE sector IS NOT NULL GROUP BY 1")
def a5_filing_tree(spark, sf):
    """Filings as files under folders of company, year and form, read with what the folders say."""
    return _tree(spark, sf).groupBy("company", "year", "form").agg(F.sum("length").alias("n_bytes"))


@query(f"SELECT {_SECTOR} AS company, count(*) AS n_lines FROM company WHERE sector IS NOT NULL GROUP BY 1")
def a10_text_files(spark, sf):
    """The texts of a tree's files, those of unknown kind being collected apart."""
    ok, _ = A.loaded(_tree(spark, sf))
    return ok.groupBy("company").agg(F.sum(F.size(F.split(F.regexp_replace("text", "\n+$", ""), "\n"))).cast("bigint").alias("n_lines"))


@query("SELECT ticker, name AS text FROM company")
def a6_html_text(spark, sf):
    """The visible text of HTML; scripts, styles and hidden regions are none of it."""
    escaped = F.regexp_replace(F.regexp_replace("name", "&", "&amp;"), "<", "&lt;")
    html = F.concat(F.lit("<html><head><style>p {}</style><script>var x = 1;</script></head><body><div style=\"display:none\">gone</div><p>"), escaped, F.lit("</p></body></html>"))
    return raw(spark, sf, "company").select("ticker", F.trim(html_text(html)).alias("text"))


@query("SELECT accession, form_type AS form, strftime(filing_date, '%Y-%m-%d') AS filed, id AS document FROM filing WHERE accession IS NOT NULL AND form_type IS NOT NULL AND filing_date IS NOT NULL AND id IS NOT NULL")
def a12_submissions(spark, sf):
    """Columnar listings, one for each batch and issuer, as rows."""
    f = raw(spark, sf, "filing").where("accession IS NOT NULL AND form_type IS NOT NULL AND filing_date IS NOT NULL AND id IS NOT NULL")
    x = F.array_sort(F.collect_list(F.struct("filing_seq", "accession", "form_type", F.col("filing_date").cast("string").alias("d"), "id")))
    listed = f.groupBy("ticker", F.expr("filing_seq DIV 1000").alias("part")).agg(x.alias("x"))
    of = lambda c: F.transform("x", lambda r: r[c])
    recent = F.struct(of("accession").alias("accessionNumber"), of("form_type").alias("form"), of("d").alias("filingDate"), of("id").alias("primaryDocument"))
    return A.submissions(listed.select(F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("raw")))


@query("SELECT DISTINCT id FROM filing WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM filing WHERE id IS NOT NULL AND length(content) > 0)")
def a13_to_fetch(spark, sf):
    f = raw(spark, sf, "filing").where("id IS NOT NULL")
    return A.to_fetch(f.select("id").distinct(), f.select("id", F.coalesce(F.length("content"), F.lit(0)).alias("length")), "id")


@query("SELECT name, CASE WHEN name IN ('fiscal_year', 'reporting_lag_in_days') THEN 'bigint' WHEN name IN ('filing_date', 'period_end_date') THEN 'date' ELSE 'string' END AS type FROM (SELECT unnest(['filing_seq', 'batch_no', 'id', 'ticker', 'cik', 'form_type', 'fiscal_year', 'fiscal_period', 'filing_date', 'accession', 'period_end_date', 'reporting_lag_in_days', 'document_title', 'document_url', 'source', 'source_authority', 'filing_status', 'is_amended', 'content_hash', 'retrieved_at', 'content']) AS name)")
def a23_types_by_name(spark, sf):
    """The types that a table's columns are declared with, by their names alone."""
    s = A.schema_of(raw(spark, sf, "filing").columns)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in s], "name string, type string")


# -- C, D, F ---------------------------------------------------------------------------------------------------------------------


@query("WITH a AS (SELECT lower(canonical_name) AS k, canonical_id FROM canonical_entity UNION SELECT lower(former_name), canonical_id FROM canonical_entity WHERE former_name IS NOT NULL UNION SELECT lower(ticker), canonical_id FROM canonical_entity WHERE ticker IS NOT NULL) SELECT mention_id, min(canonical_id) AS canonical_id FROM extracted_entity JOIN a ON a.k = lower(trim(name)) GROUP BY 1")
def c25_alias_seeds(spark, sf):
    """Seeds by any alias of an item: one equi join on the exploded aliases."""
    a = raw(spark, sf, "canonical_entity").select("canonical_id", F.explode(F.array_compact(F.array("canonical_name", "former_name", "ticker"))).alias("k")).select(F.lower("k").alias("k"), "canonical_id").distinct()
    e = raw(spark, sf, "extracted_entity").select("mention_id", F.lower(F.trim("name")).alias("k"))
    return e.join(a, "k").groupBy("mention_id").agg(F.min("canonical_id").alias("canonical_id"))


@query("SELECT id, 'E' || (length(question) % 3 + 1) || CASE WHEN length(question) % 3 + 1 <> 2 THEN ',E2' ELSE '' END AS cited FROM eval_question")
def d25_cited_once(spark, sf):
    """Citations in the order of their first appearance, each once."""
    first = F.concat(F.lit("[E"), (F.length("question") % 3 + 1).cast("string"), F.lit("]"))
    return raw(spark, sf, "eval_question").select("id", F.array_join(J.citations(F.concat(first, F.lit(" and [E2] then "), first)), ",").alias("cited"))


@query("SELECT doc_id, CASE max(CASE WHEN abusive = 1 THEN 2 WHEN abusive IS NULL THEN 1 ELSE 0 END) WHEN 2 THEN 'REFUSED' WHEN 1 THEN 'QUALIFIED' ELSE 'SUPPORTED' END AS verdict, count(*) FILTER (WHERE abusive = 1) AS n_worst FROM content_label GROUP BY 1")
def d26_worst_wins(spark, sf):
    """The worst of several judgements holds, and how often it was given."""
    rank = F.when(F.col("abusive") == 1, 2).when(F.col("abusive").isNull(), 1).otherwise(0)
    v = raw(spark, sf, "content_label").groupBy("doc_id").agg(F.max(rank).alias("w"), F.count_if(F.col("abusive") == 1).alias("n_worst"))
    return v.select("doc_id", F.when(F.col("w") == 2, "REFUSED").when(F.col("w") == 1, "QUALIFIED").otherwise("SUPPORTED").alias("verdict"), "n_worst")


_PAD = "' ' || trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || ' '"


@query(f"SELECT doc_id, arg_max(alias, (length(alias), alias)) AS alias FROM (SELECT doc_id, {_PAD.format('title')} AS t FROM documents WHERE title IS NOT NULL) JOIN (SELECT DISTINCT {_PAD.format('canonical_name')} AS alias FROM canonical_entity) ON contains(t, alias) WHERE length(string_split(trim(alias), ' ')[1]) >= 3 GROUP BY 1")
def f11_longest_alias(spark, sf):
    """The longest alias that stands in a title: candidates by their first word, so nothing is compared with everything."""
    a = raw(spark, sf, "canonical_entity").select(J.padded(F.col("canonical_name")).alias("alias")).distinct().withColumn("w", F.split(F.trim("alias"), " ")[0]).where(F.length("w") >= 3)
    t = raw(spark, sf, "documents").where("title IS NOT NULL").select("doc_id", J.padded(F.col("title")).alias("t"))
    words = t.select("doc_id", "t", F.explode(F.array_distinct(F.split(F.trim("t"), " "))).alias("w"))
    return words.join(a, "w").where(F.col("t").contains(F.col("alias"))).groupBy("doc_id").agg(F.max_by("alias", F.struct(F.length("alias"), "alias")).alias("alias"))


# -- J, K ------------------------------------------------------------------------------------------------------------------------


@query("SELECT canonical_id, rtrim(canonical_name, ' .:;,') AS concept FROM canonical_entity")
def j13_canonical_concepts(spark, sf):
    """Labels with a unit, a footnote mark and a trade mark sign, without them."""
    label = F.concat("canonical_name", F.lit("™ (1) (in thousands)"))
    return raw(spark, sf, "canonical_entity").select("canonical_id", J.canonical_concept(label).alias("concept"))


_TOKENS = "string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '\\.', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '[\\s_]+', ' ', 'g')), ' ')"


@query(f"SELECT id, len(list_filter({sorted(w for p in J.POLARITY for w in p)}, lambda w: list_contains(q, w) <> list_contains(e, w))) > 0 AS conflict FROM (SELECT id, {_TOKENS.format('question')} AS q, {_TOKENS.format('expected')} AS e FROM eval_question WHERE expected IS NOT NULL)")
def j16_polarity(spark, sf):
    return raw(spark, sf, "eval_question").where("expected IS NOT NULL").select("id", J.polarity_conflict(F.col("question"), F.col("expected")).alias("conflict"))


@query("SELECT mention_id, contains(t, n) OR (len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(t, ' ' || x || ' '))) = 0) AS grounded FROM (SELECT mention_id, t, n, list_filter(string_split(trim(n), ' '), lambda x: length(x) >= 3) AS w FROM (SELECT mention_id, ' ' || trim(regexp_replace(lower(c.text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t, ' ' || trim(regexp_replace(lower(e.name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n FROM extracted_entity e JOIN chunk c ON c.id = e.chunk_id WHERE e.name IS NOT NULL AND c.text IS NOT NULL))")
def j24_grounded(spark, sf):
    """Whether a name stands in its passage."""
    c = raw(spark, sf, "chunk").where("text IS NOT NULL").select(F.col("id").alias("chunk_id"), "text")
    e = raw(spark, sf, "extracted_entity").where("name IS NOT NULL").select("mention_id", "chunk_id", "name")
    return e.join(c, "chunk_id").select("mention_id", J.grounded(F.col("name"), F.col("text")).alias("grounded"))


@query("SELECT doc_id, regexp_replace(replace(text, 'e', 'e-' || chr(10)), '(\\w)-\\n(\\w)', '\\1\\2', 'g') AS text FROM documents WHERE text IS NOT NULL")
def j29_joined_words(spark, sf):
    """Words cut at line ends, joined."""
    return raw(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", J.dehyphenated(F.replace("text", F.lit("e"), F.lit("e-\n"))).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE coalesce(nullif(regexp_extract(left(text, 300), '(?s)^(.*[.!?])(?:\\s|$)', 1), ''), left(text, 300)) END AS head FROM documents WHERE text IS NOT NULL")
def j35_truncated(spark, sf):
    return raw(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", J.truncated(F.col("text"), 300).alias("head"))


@query("SELECT filing_seq, CASE filing_seq % 5 WHEN 0 THEN '3M' WHEN 1 THEN '6M' WHEN 2 THEN 'FY' WHEN 3 THEN '9M' ELSE '' END AS code FROM filing")
def k1_duration_codes(spark, sf):
    texts = ["Three months ended", "6-month period", "Year ended", "for the nine months", "As of"]
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("filing_seq") % 5 + 1).cast("int"))
    # "6-month period" has no plural and no blank.
    return raw(spark, sf, "filing").select("filing_seq", K.duration_code(t).alias("code"))


@query("SELECT filing_seq, d IN ('6M', '9M', 'FY') OR (d = '3M' AND abs(period_end_date - make_date(year(period_end_date), 1, 1)) <= 6) AS cumulative FROM (SELECT filing_seq, period_end_date, CASE filing_seq % 3 WHEN 0 THEN '6M' ELSE '3M' END AS d FROM filing WHERE period_end_date > DATE '1000-01-01')")
def k5_cumulative(spark, sf):
    f = raw(spark, sf, "filing").where("period_end_date > DATE'1000-01-01'")
    d = F.when(F.col("filing_seq") % 3 == 0, "6M").otherwise("3M")
    return f.select("filing_seq", K.cumulative(d, F.col("period_end_date"), F.trunc("period_end_date", "year")).alias("cumulative"))


@query("SELECT parsed_id, CASE WHEN regexp_matches(filing_date, '^\\d{4}-\\d{2}-\\d{2}$') THEN filing_date WHEN regexp_matches(filing_date, '(19|20)\\d{2}') THEN 'FY' || regexp_extract(filing_date, '(?:19|20)\\d{2}') ELSE trim(filing_date) END AS period FROM parsed_document")
def k7_period_keys(spark, sf):
    return raw(spark, sf, "parsed_document").select("parsed_id", K.period_key(F.col("filing_date")).alias("period"))


@query("SELECT canonical_id, canonical_name AS concept, '3M' AS duration, '2026-03-28' AS period_end FROM canonical_entity")
def k12_concept_periods(spark, sf):
    name = F.concat("canonical_name", F.lit(" (3M-2026-03-28)"))
    return raw(spark, sf, "canonical_entity").select("canonical_id", K.concept_period(name).alias("p")).select("canonical_id", "p.*")


# -- R: streams ------------------------------------------------------------------------------------------------------------------


@query("SELECT ticker, CASE WHEN length(ticker) % 2 = 0 THEN 'extracted' ELSE 'staged' END AS status, 1::BIGINT AS n_refused FROM company")
def r1_staged_states(spark, sf):
    """The states of staged records after a stream of moves, of which one each is not allowed."""
    at = new_folder(spark, "moves")
    even = F.length("ticker") % 2 == 0
    moves = F.when(even, F.array(*map(F.lit, ("staged", "staged", "extracted")))).otherwise(F.array(*map(F.lit, ("extracted", "staged"))))
    raw(spark, sf, "company").select("ticker", F.posexplode(moves).alias("at", "status")).select("ticker", "status", "at").coalesce(1).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("ticker string, status string, at int").parquet(f"{at}/in")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    loads.transitions(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("ticker string, status string, n_refused bigint, batch int").option("basePath", f"{at}/out").parquet(f"{at}/out")
    return rows.groupBy("ticker").agg(F.max_by(F.struct("status", "n_refused"), "batch").alias("x")).select("ticker", "x.*")


@query("SELECT ticker, 'extracted' AS status FROM company WHERE length(ticker) % 2 = 0")
def r2_drained(spark, sf):
    """Staged files drained: the last record of each file counts, broken lines are passed over, and only what is extracted goes on."""
    line = lambda s: F.concat(F.lit('{"ticker": "'), "ticker", F.lit(f'", "status": "{s}", "timestamp": "2024-01-01"}}'))
    lines = F.when(F.length("ticker") % 2 == 0, F.array(line("staged"), line("extracted"), F.lit('{"ticker": '))).otherwise(F.array(line("extracted"), line("failed")))
    staged = raw(spark, sf, "company").select(F.concat("ticker", F.lit(".jsonl")).alias("file"), F.posexplode(lines).alias("line_no", "line"))
    return A.staged(staged)[0].where("status = 'extracted'").select("ticker", "status")
