"""Evidence, retrieval, federation and checks over whole tables (groups F, G, I, M, O, P, U and V)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import strings as J
from ..operators import merge, ranking
from ..registry import query
from .graph import WITH, Graph


def raw(spark, sf, name):
    return Graph(spark, sf).raw(name)


def latest(filings: DataFrame, by: str) -> DataFrame:
    """by, latest_id: the most recent filing of each group; of equals the one that arrived last."""
    return filings.where(F.col(by).isNotNull()).groupBy(by).agg(F.max_by("id", F.struct(F.coalesce("filing_date", F.lit("0001-01-01").cast("date")), "filing_seq")).alias("latest_id"))


_LATEST = "SELECT ticker, arg_max(id, (coalesce(filing_date, DATE '0001-01-01'), filing_seq)) AS latest_id FROM filing WHERE ticker IS NOT NULL GROUP BY 1"


# -- P: from nodes to the filings and sections that show them --------------------------------------------------------------------


@query("SELECT id, form_type, accession, filing_seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(coalesce(accession, '')) DESC, filing_seq) AS n FROM filing WHERE id IS NOT NULL) WHERE n = 1")
def evidence_filing_index(spark, sf):
    """Of the copies of a filing the one with the longest accession number, the first of equals."""
    f = raw(spark, sf, "filing").where("id IS NOT NULL")
    richest = F.max_by(F.struct("form_type", "accession", "filing_seq"), F.struct(F.length(F.coalesce("accession", F.lit(""))).alias("l"), -F.col("filing_seq")))
    return f.groupBy("id").agg(richest.alias("r")).select("id", "r.*")


@query(f"SELECT mention_id, coalesce(c.filing_id, l.latest_id) AS filing_id, CASE WHEN c.filing_id IS NOT NULL THEN 'passage' WHEN l.latest_id IS NOT NULL THEN 'issuer' ELSE 'none' END AS via FROM extracted_entity e LEFT JOIN (SELECT id, min(filing_id) AS filing_id FROM chunk GROUP BY 1) c ON c.id = e.chunk_id LEFT JOIN ({_LATEST}) l ON l.ticker = e.ticker")
def evidence_filing_of_node(spark, sf):
    """The filing of a mention: that of its passage, else the most recent one of its issuer."""
    chunks = raw(spark, sf, "chunk").groupBy(F.col("id").alias("chunk_id")).agg(F.min("filing_id").alias("own"))
    e = raw(spark, sf, "extracted_entity").select("mention_id", "chunk_id", "ticker").join(chunks, "chunk_id", "left").join(latest(raw(spark, sf, "filing"), "ticker"), "ticker", "left")
    via = F.when(F.col("own").isNotNull(), "passage").when(F.col("latest_id").isNotNull(), "issuer").otherwise("none")
    return e.select("mention_id", F.coalesce("own", "latest_id").alias("filing_id"), via.alias("via"))


@query(
    "WITH c AS (SELECT id, min(filing_id) AS filing_id, min(section) AS section FROM chunk GROUP BY 1), f AS (SELECT filing_id, arg_min(section, (chunk_index, id)) AS section FROM chunk WHERE section IS NOT NULL AND filing_id IS NOT NULL GROUP BY 1), "
    "t AS (SELECT ticker, min(section) AS section FROM chunk WHERE ticker IS NOT NULL GROUP BY 1) SELECT mention_id, coalesce(c.section, f.section, t.section, '') AS section FROM extracted_entity e LEFT JOIN c ON c.id = e.chunk_id LEFT JOIN f USING (filing_id) LEFT JOIN t ON t.ticker = e.ticker"
)
def evidence_section_of_node(spark, sf):
    """The section of a mention by the first source that has one: its passage, the first section of that filing, any of its issuer."""
    c = raw(spark, sf, "chunk")
    own = c.groupBy(F.col("id").alias("chunk_id")).agg(F.min("filing_id").alias("filing_id"), F.min("section").alias("s1"))
    first = c.where("section IS NOT NULL AND filing_id IS NOT NULL").groupBy("filing_id").agg(F.min_by("section", F.struct("chunk_index", "id")).alias("s2"))
    issuer = c.where("ticker IS NOT NULL").groupBy("ticker").agg(F.min("section").alias("s3"))
    e = raw(spark, sf, "extracted_entity").select("mention_id", "chunk_id", "ticker")
    return e.join(own, "chunk_id", "left").join(first, "filing_id", "left").join(issuer, "ticker", "left").select("mention_id", F.coalesce("s1", "s2", "s3", F.lit("")).alias("section"))


@query("SELECT canonical_id, canonical_name || coalesce(' — ' || string_agg(DISTINCT description, '; ' ORDER BY description), '') AS text, count(DISTINCT description) AS n_facts FROM canonical_entity c LEFT JOIN extracted_entity e ON lower(e.name) = lower(c.canonical_name) AND e.description <> '' GROUP BY canonical_id, canonical_name")
def evidence_text(spark, sf):
    """The evidence of an item: its name, and what is said of it, each fact once in order."""
    facts = raw(spark, sf, "extracted_entity").where("description <> ''").groupBy(F.lower("name").alias("k")).agg(F.array_sort(F.collect_set("description")).alias("facts"))
    c = raw(spark, sf, "canonical_entity").select("canonical_id", "canonical_name", F.lower("canonical_name").alias("k")).join(facts, "k", "left")
    text = F.concat("canonical_name", F.when(F.size("facts") > 0, F.concat(F.lit(" — "), F.array_join("facts", "; "))).otherwise(""))
    return c.select("canonical_id", text.alias("text"), F.coalesce(F.size("facts"), F.lit(0)).cast("bigint").alias("n_facts"))


# Fixed value: phrases by which an answer says that a fact is absent.
NEGATION = (
    r"not (?:available|provided|found|included|described|stated|specified|covered|part of the context)"
    r"|can(?:not|'t) (?:be )?(?:determin|answer|establish|derived|told|said|reported)"
    r"|is not possible to|no information|out of (?:the )?context"
    r"|does not (?:mention|include|provide|contain|describe)|is not (?:present|included|described)"
    r"|not enough (?:information|context)|not in (?:the )?(?:context|corpus|database|graph)|unavailable"
    r"|no data|not part of|no record|nothing in the context|based on the context.*?(?:not|no )"
)
_FIGURES = r"len(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace({0}, '\d{{4}}-\d{{2}}-\d{{2}}', ' ', 'g'), '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b', ' ', 'g'), '\(?-?[0-9][0-9,]*\.?[0-9]*\)?%?'), lambda x: rtrim(x, ',')), lambda x: replace(trim(x, '()%'), ',', '') <> '' AND NOT regexp_full_match(replace(trim(x, '()%'), ',', ''), '\d{{4}}|0\d{{6,9}}|\d{{1,2}}')))"


def absent(text: Column) -> Column:
    """Whether an answer says that the fact is absent."""
    return F.lower(text).rlike(NEGATION)


def graded(expected: Column, negative: Column, text: Column, grounded: Column) -> Column:
    """PASS, FAIL or ERROR of one answer. A negative control passes if it states no figure and is ungrounded or says that the fact is
    absent; others if they cite and contain what is expected, letters and digits compared alone. An empty answer is an error."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z]", "")
    figure = F.size(J.figures(text)) > 0
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "ERROR")
        .when(negative, F.when(figure | (grounded & ~absent(text)), "FAIL").otherwise("PASS"))
        .when(~grounded | (expected.isNotNull() & ~norm(text).contains(norm(expected))), "FAIL")
        .otherwise("PASS")
    )


_QA = "SELECT id, expected, length(question) % 3 = 0 AS negative, length(expected) % 2 = 0 AS grounded, CASE length(question) % 5 WHEN 0 THEN '' WHEN 1 THEN 'That cannot be determined.' WHEN 2 THEN 'About 12,345.' ELSE 'Yes: ' || expected END AS text FROM eval_question WHERE expected IS NOT NULL"


def _qa(spark, sf) -> DataFrame:
    """An answer of some kind to each evaluation item."""
    n = F.length("question")
    text = F.when(n % 5 == 0, "").when(n % 5 == 1, "That cannot be determined.").when(n % 5 == 2, "About 12,345.").otherwise(F.concat(F.lit("Yes: "), "expected"))
    return raw(spark, sf, "eval_question").where("expected IS NOT NULL").select("id", "expected", (n % 3 == 0).alias("negative"), (F.length("expected") % 2 == 0).alias("grounded"), text.alias("text"))


@query(
    f"SELECT id, CASE WHEN trim(text) = '' THEN 'ERROR' WHEN negative THEN CASE WHEN {_FIGURES.format('text')} > 0 OR (grounded AND NOT regexp_matches(lower(text), '{NEGATION.replace(chr(39), chr(39) * 2)}')) THEN 'FAIL' ELSE 'PASS' END "
    f"WHEN NOT grounded OR NOT contains(regexp_replace(lower(text), '[^0-9a-z]', '', 'g'), regexp_replace(lower(expected), '[^0-9a-z]', '', 'g')) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM ({_QA})"
)
def qa_verdicts(spark, sf):
    return _qa(spark, sf).select("id", graded(F.col("expected"), F.col("negative"), F.col("text"), F.col("grounded")).alias("verdict"))


@query(f"SELECT doc_id, coalesce(regexp_matches(lower(text), '{NEGATION.replace(chr(39), chr(39) * 2)}'), false) AS absent FROM documents")
def u11_absence(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", F.coalesce(absent(F.col("text")), F.lit(False)).alias("absent"))


_TERMS = ("revenue", "gross margin", "inventory", "goodwill", "capital expenditure", "freight rates")


def terms_found(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that stand in a text as whole words, in the order given."""
    return F.array_compact(F.array(*(F.when(text.rlike(rf"(?i)\b{t}\b"), F.lit(t)) for t in terms)))


_TERMS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({{0}}, '(?i)\\b{t}\\b') THEN '{t}' END" for t in _TERMS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_TERMS_SQL.format('text')}, ',') AS terms FROM documents WHERE text IS NOT NULL")
def j26_terms(spark, sf):
    return raw(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(terms_found(F.col("text"), _TERMS), ",").alias("terms"))


@query(f"SELECT status, count(*) AS n, count(*) FILTER (WHERE asked > 0) AS n_asked, round(100.0 * count(*) FILTER (WHERE asked > 0 AND met = asked) / greatest(count(*) FILTER (WHERE asked > 0), 1), 4) AS rate FROM (SELECT status, len({_TERMS_SQL.format('question')}) AS asked, len(list_intersect({_TERMS_SQL.format('question')}, {_TERMS_SQL.format('expected')})) AS met FROM eval_question) GROUP BY 1")
def qa_concept_scores(spark, sf):
    """How many items mention concepts, and in how many of those the expected answer takes up all of them."""
    q, a = terms_found(F.col("question"), _TERMS), terms_found(F.coalesce("expected", F.lit("")), _TERMS)
    e = raw(spark, sf, "eval_question").select("status", F.size(q).alias("asked"), F.size(F.array_intersect(q, a)).alias("met"))
    asked = F.count_if(F.col("asked") > 0)
    return e.groupBy("status").agg(F.count("*").alias("n"), asked.alias("n_asked"), F.round(100.0 * F.count_if((F.col("asked") > 0) & (F.col("met") == F.col("asked"))) / F.greatest(asked, F.lit(1)), 4).alias("rate"))


@query("SELECT id, array_to_string(list_sort(list_intersect(cited, valid)), ',') AS used, array_to_string(list_sort(list_filter(cited, lambda c: NOT list_contains(valid, c))), ',') AS invented, len(list_intersect(cited, valid)) = len(cited) AS grounded FROM (SELECT id, ['E1', 'E' || (length(question) % 7 + 1)] AS cited0, list_distinct(['E1', 'E' || (length(question) % 7 + 1)]) AS cited, list_transform(range(1, length(expected) % 5 + 2), lambda i: 'E' || i) AS valid FROM eval_question WHERE expected IS NOT NULL)")
def qa_citation_check(spark, sf):
    """Citations of an answer that stand in its context, those that don't, and whether all do."""
    answer = F.concat(F.lit("As stated [E1]; see also [E"), (F.length("question") % 7 + 1).cast("string"), F.lit("]."))
    valid = F.transform(F.sequence(F.lit(1), F.length("expected") % 5 + 1), lambda i: F.concat(F.lit("E"), i.cast("string")))
    e = raw(spark, sf, "eval_question").where("expected IS NOT NULL").select("id", J.citations(answer).alias("cited"), valid.alias("valid"))
    invented = F.array_except("cited", "valid")
    return e.select("id", F.array_join(F.array_sort(F.array_intersect("cited", "valid")), ",").alias("used"), F.array_join(F.array_sort(invented), ",").alias("invented"), (F.size(invented) == 0).alias("grounded"))


# -- O: retrieval and federation -------------------------------------------------------------------------------------------------

# Words that ask for a concept, by a part of the concept's name.
SYNONYMS = {
    "sales": ("sales", "revenue", "top line", "margin", "profit"), "profit": ("profit", "gross margin", "margin"),
    "income": ("income", "operating income", "net income", "earnings", "operating margin", "margin"), "research": ("r&d", "research", "development"),
    "operating expense": ("opex", "operating expense", "expenses"), "cost": ("cost", "cogs"),
}


@query("SELECT id, concept, count(*) AS n_words FROM (SELECT id, lower(question) AS q FROM eval_question), (VALUES " + ", ".join(f"('{c}', '{w}')" for c, ws in SYNONYMS.items() for w in ws) + ") v(concept, word) WHERE contains(q, word) GROUP BY 1, 2")
def o4_concepts_asked(spark, sf):
    """The concepts that a question asks for by any of their words, and by how many."""
    q = F.lower("question")
    each = F.array_compact(F.array(*(F.when(sum(q.contains(w).cast("int") for w in ws) > 0, F.struct(F.lit(c).alias("concept"), sum(q.contains(w).cast("bigint") for w in ws).alias("n_words"))) for c, ws in SYNONYMS.items())))
    return raw(spark, sf, "eval_question").select("id", F.explode(each).alias("x")).select("id", "x.*")


@query("SELECT filing_seq, CASE WHEN form_type IN ('10-K', '10-K/A') THEN 'asked' ELSE 'other' END AS role FROM filing")
def o6_forms_asked(spark, sf):
    """Filings of the forms that a question names, and the rest, which stays in the context under another role."""
    asked = F.array(F.lit("10-K"), F.lit("10-K/A"))
    return raw(spark, sf, "filing").select("filing_seq", F.when(F.coalesce(F.array_contains(asked, F.col("form_type")), F.lit(False)), "asked").otherwise("other").alias("role"))


# Words by which a question concerns a database beside that of the filings.
DATABASES = {
    "supply_chain": ("supplier", "supply", "foundry", "tsmc", "asml", "cowos", "packaging", "wafer", "component", "assembly", "foxconn", "samsung", "sk hynix", "micron", "hbm", "panasonic", "catl", "lithography", "euv", "broadcom", "qualcomm", "customer"),
    "macro_economy": ("gdp", "macro", "economy", "capex", "capital expenditure", "spend", "investment", "fixed investment", "inflation", "productivity", "sector", "transmission", "spillover", "interest rate", "fed", "tariff", "trade", "policy"),
    "governance": ("management", "executive", "ceo", "cfo", "transition", "succession", "board", "director", "officer", "leadership", "governance", "resignation", "appointment", "strategy"),
}


def databases(question: Column) -> Column:
    """The databases that a question concerns; the filings always do."""
    q = F.lower(question)
    return F.array_compact(F.array(F.lit("sec_filings"), *(F.when(q.rlike("|".join(ws)), F.lit(d)) for d, ws in DATABASES.items())))


@query("SELECT id, 'sec_filings'" + "".join(f" || CASE WHEN regexp_matches(lower(question), '{'|'.join(ws)}') THEN ',{d}' ELSE '' END" for d, ws in DATABASES.items()) + " AS databases FROM eval_question")
def o8_databases_asked(spark, sf):
    return raw(spark, sf, "eval_question").select("id", F.array_join(databases(F.col("question")), ",").alias("databases"))


_NODES = "SELECT ticker AS id, 'filings' AS db FROM company UNION ALL SELECT ticker, 'reference' FROM canonical_entity WHERE ticker IS NOT NULL UNION ALL SELECT DISTINCT ticker, 'passages' FROM chunk WHERE ticker IS NOT NULL"


def federated_nodes(spark, sf) -> DataFrame:
    """Nodes of three databases one under the other; what stands in several stays there several times."""
    parts = [raw(spark, sf, "company").select("ticker", F.lit("filings").alias("db")), raw(spark, sf, "canonical_entity").where("ticker IS NOT NULL").select("ticker", F.lit("reference").alias("db"))]
    parts.append(raw(spark, sf, "chunk").where("ticker IS NOT NULL").select("ticker").distinct().withColumn("db", F.lit("passages")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("ticker", "id")


@query(f"SELECT id, db FROM ({_NODES})")
def g3_federated_nodes(spark, sf):
    return federated_nodes(spark, sf)


@query(
    "WITH a AS (SELECT DISTINCT lower(ticker) AS k, sector FROM company WHERE sector IS NOT NULL), b AS (SELECT DISTINCT lower(ticker) AS k, section FROM chunk WHERE ticker IS NOT NULL AND section IS NOT NULL), c AS (SELECT DISTINCT lower(ticker) AS k, entity_type FROM canonical_entity WHERE ticker IS NOT NULL) "
    "SELECT sector, section, entity_type, count(*) AS n_bridges FROM a JOIN b USING (k) JOIN c USING (k) GROUP BY ALL"
)
def o9_federated_paths(spark, sf):
    """Paths over three databases: edges of each, bridged where their nodes are one issuer."""
    k = F.lower("ticker").alias("k")
    a = raw(spark, sf, "company").where("sector IS NOT NULL").select(k, "sector").distinct()
    b = raw(spark, sf, "chunk").where("ticker IS NOT NULL AND section IS NOT NULL").select(k, "section").distinct()
    c = raw(spark, sf, "canonical_entity").where("ticker IS NOT NULL").select(k, "entity_type").distinct()
    return a.join(b, "k").join(c, "k").groupBy("sector", "section", "entity_type").agg(F.count("*").alias("n_bridges"))


@query(
    "WITH m AS (SELECT DISTINCT ticker AS src, lower(name) AS k FROM extracted_entity WHERE ticker IS NOT NULL AND name IS NOT NULL), r AS (SELECT lower(canonical_name) AS k, canonical_id FROM canonical_entity UNION SELECT lower(ticker), canonical_id FROM canonical_entity WHERE ticker IS NOT NULL UNION SELECT lower(former_name), canonical_id FROM canonical_entity WHERE former_name IS NOT NULL) "
    "SELECT src, canonical_id, f.form_type, count(DISTINCT f.id) AS n_filings FROM m JOIN r USING (k) JOIN canonical_entity c USING (canonical_id) JOIN filing f ON f.ticker = c.ticker GROUP BY 1, 2, 3"
)
def c23_overlay_to_backbone(spark, sf):
    """Second hops from overlay edges to the stored graph, whose nodes are met by name, ticker or former name: three equi joins as one."""
    m = raw(spark, sf, "extracted_entity").where("ticker IS NOT NULL AND name IS NOT NULL").select(F.col("ticker").alias("src"), F.lower("name").alias("k")).distinct()
    c = raw(spark, sf, "canonical_entity")
    keys = c.select("canonical_id", "ticker", F.explode(F.array_compact(F.array("canonical_name", "ticker", "former_name"))).alias("k")).select("canonical_id", "ticker", F.lower("k").alias("k")).distinct()
    f = raw(spark, sf, "filing").select("ticker", "id", "form_type")
    return m.join(keys, "k").join(f, "ticker").groupBy("src", "canonical_id", "form_type").agg(F.count_distinct("id").alias("n_filings"))


_STITCH = (
    "WITH r AS (SELECT k, min(canonical_id) AS canonical_id FROM (SELECT lower(canonical_name) AS k, canonical_id FROM canonical_entity UNION ALL SELECT lower(ticker), canonical_id FROM canonical_entity WHERE ticker IS NOT NULL) GROUP BY 1), "
    "e AS (SELECT DISTINCT coalesce('C' || a.canonical_id, 'N' || lower(ticker)) AS src, coalesce('C' || b.canonical_id, 'N' || lower(name)) AS dst FROM extracted_entity LEFT JOIN r a ON a.k = lower(ticker) LEFT JOIN r b ON b.k = lower(name) WHERE ticker IS NOT NULL AND name IS NOT NULL) "
)


def stitched(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (src, dst, texts) with their endpoints resolved to known items (k, canonical_id) where they can be, without self loops."""
    end = lambda c: F.coalesce(F.concat(F.lit("C"), F.col(f"{c}_id").cast("string")), F.concat(F.lit("N"), F.lower(c)))
    out = edges
    for c in ("src", "dst"):
        out = out.join(known.select(F.col("k").alias(f"{c}_k"), F.col("canonical_id").alias(f"{c}_id")), F.lower(c) == F.col(f"{c}_k"), "left")
    return out.select(end("src").alias("src"), end("dst").alias("dst")).where("src <> dst").distinct()


def _overlay(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = raw(spark, sf, "canonical_entity")
    known = c.select("canonical_id", F.explode(F.array_compact(F.array("canonical_name", "ticker"))).alias("k")).groupBy(F.lower("k").alias("k")).agg(F.min("canonical_id").alias("canonical_id"))
    e = raw(spark, sf, "extracted_entity").where("ticker IS NOT NULL AND name IS NOT NULL").select(F.col("ticker").alias("src"), F.col("name").alias("dst"))
    return e, known


@query(_STITCH + "SELECT count(*) FILTER (WHERE src LIKE 'C%' AND dst LIKE 'C%') AS stitched, count(*) FILTER (WHERE src LIKE 'C%' AND dst LIKE 'N%') AS new_nodes, count(*) FILTER (WHERE src LIKE 'N%') AS ephemeral FROM e WHERE src <> dst")
def i15_stitch(spark, sf):
    """Edges of an overlay between stored nodes, to new ones, and from nodes that nothing stored knows."""
    s = stitched(*_overlay(spark, sf))
    known = lambda c: F.col(c).startswith("C")
    return s.agg(F.count_if(known("src") & known("dst")).alias("stitched"), F.count_if(known("src") & ~known("dst")).alias("new_nodes"), F.count_if(~known("src")).alias("ephemeral"))


# Tables of the overlay's entity types.
TABLES = {"company": "Company", "supplier": "Supplier", "competitor": "Company", "product": "Product", "component": "Component", "geographicmarket": "GeographicMarket", "regulatorybody": "RegulatoryBody", "person": "Person"}


@query("SELECT t AS table_name, count(DISTINCT slug) AS n_nodes FROM (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS slug, CASE lower(entity_type) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TABLES.items()) + " ELSE 'Other' END AS t FROM extracted_entity) WHERE slug <> '' GROUP BY 1")
def i16_overlay_tables(spark, sf):
    """The nodes that an overlay adds to each table; a type without a table is kept as Other."""
    t = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TABLES.items() for x in kv)), F.lower("entity_type")), F.lit("Other"))
    e = raw(spark, sf, "extracted_entity").select(t.alias("table_name"), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "").alias("slug")).where("slug <> ''")
    return e.groupBy("table_name").agg(F.count_distinct("slug").alias("n_nodes"))


# -- F, M, U: bounded renderings -------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) FILTER (WHERE n <= 30) AS n_kept, count(*) FILTER (WHERE n > 30) AS n_rejected, min(value) FILTER (WHERE n <= 30) AS least FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) GROUP BY 1")
def f10_best_thirty(spark, sf):
    """The thirty best of each kind, and how many are rejected."""
    e = raw(spark, sf, "events")
    kept = ranking.top_k(e.select("event_type", "value", "event_id"), ["event_type"], [F.col("value").desc(), F.col("event_id")], 30).groupBy("event_type").agg(F.count("*").alias("n_kept"), F.min("value").alias("least"))
    return e.groupBy("event_type").agg(F.count("*").alias("n")).join(kept, "event_type").select("event_type", "n_kept", (F.col("n") - F.col("n_kept")).alias("n_rejected"), "least")


@query("SELECT user_id, k FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, k) AS n, count(*) OVER (PARTITION BY user_id) AS size FROM (SELECT user_id, json_extract_string(props, '$.k') AS k, max(ts) AS last FROM events GROUP BY 1, 2)) WHERE size < 32 OR n <= size - size // 2")
def f13_evicted_caches(spark, sf):
    """What caches of at most 32 entries hold after the accesses of a log: a full one drops its older half."""
    last = raw(spark, sf, "events").groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.max("ts").alias("last"))
    n, size = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("last").desc(), "k")), F.count("*").over(W.partitionBy("user_id"))
    return last.select("user_id", "k", n.alias("n"), size.alias("size")).where("size < 32 OR n <= size - size DIV 2").select("user_id", "k")


@query("SELECT id, arg_min(name, mention_id) AS name, arg_min(lower(entity_type), mention_id) AS entity_type FROM extracted_entity WHERE trim(coalesce(id, '')) <> '' AND trim(coalesce(name, '')) <> '' AND lower(entity_type) IN (" + ", ".join(f"'{t}'" for t in TABLES) + ") GROUP BY 1")
def m29_valid_extractions(spark, sf):
    """Extracted entities with an id, a name and a known type, the first of each id."""
    ok = (F.trim(F.coalesce("id", F.lit(""))) != "") & (F.trim(F.coalesce("name", F.lit(""))) != "") & F.lower("entity_type").isin(*TABLES)
    e = raw(spark, sf, "extracted_entity").where(ok).select("id", "name", F.lower("entity_type").alias("entity_type"), "mention_id")
    return merge.first_wins(e, ["id"], ["mention_id"]).select("id", "name", "entity_type")


@query("SELECT CASE WHEN trim(coalesce(id, '')) = '' THEN 'no id' WHEN trim(coalesce(name, '')) = '' THEN 'no name' WHEN lower(entity_type) NOT IN (" + ", ".join(f"'{t}'" for t in TABLES) + ") OR entity_type IS NULL THEN 'unknown type' WHEN len(string_split(trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')), ' ')) > 30 THEN 'long quote' ELSE 'valid' END AS outcome, count(*) AS n FROM extracted_entity GROUP BY 1")
def l5_payload_checks(spark, sf):
    """Payloads by the first rule that they break; those rejected are counted, not lost silently."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    words = F.size(F.split(F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"\s+", " ")), " "))
    outcome = F.when(empty("id"), "no id").when(empty("name"), "no name").when(~F.coalesce(F.lower("entity_type").isin(*TABLES), F.lit(False)), "unknown type").when(words > 30, "long quote").otherwise("valid")
    return raw(spark, sf, "extracted_entity").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


# Words of a question that name nothing.
QUESTION_WORDS = (
    "a an the of in on at to for from by with about into over is are was were be been being do does did what which who whom whose how when where why and or "
    "but if then than that this these those there here it its as not no nor so such very much many more most some any all both each other another same"
).split()
_Q = ", ".join(f"'{w}'" for w in QUESTION_WORDS)


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(question), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({_Q})))), ' ') AS tokens FROM eval_question")
def j10_question_tokens(spark, sf):
    t = F.array_remove(F.array_except(F.split(F.lower("question"), "[^a-z0-9]+"), F.array(*map(F.lit, QUESTION_WORDS))), "")
    return raw(spark, sf, "eval_question").select("id", F.array_join(F.array_sort(t), " ").alias("tokens"))


def lexical_seeds(questions: DataFrame, names: DataFrame, per_token: int = 2, most: int = 6) -> DataFrame:
    """Id, rank, node: the nodes whose names hold the content words of a question, at most ``per_token`` a word, shorter names first,
    and ``most`` a question, earlier words first. questions: id, question; names: node, name."""
    tokens = questions.select("id", F.posexplode(F.split(F.lower("question"), "[^a-z0-9]+")).alias("at", "w")).where((F.length("w") > 2) & ~F.col("w").isin(*QUESTION_WORDS))
    words = names.select("node", "name", F.explode(F.array_distinct(F.split(F.lower("name"), "[^a-z0-9]+"))).alias("w")).where("w <> ''")
    best = ranking.top_k(words, ["w"], [F.length("name"), F.col("name"), F.col("node")], per_token).select("w", "node", F.length("name").alias("l"), "name")
    met = tokens.join(best, "w").groupBy("id", "node").agg(F.min(F.struct("at", "l", "name")).alias("o"))
    n = F.row_number().over(W.partitionBy("id").orderBy("o", "node"))
    return met.select("id", n.cast("bigint").alias("rank"), "node").where(F.col("rank") <= most)


@query(
    f"WITH t AS (SELECT id, lower(unnest(q)) AS w, generate_subscripts(q, 1) - 1 AS pos FROM (SELECT id, string_split_regex(lower(question), '[^a-z0-9]+') AS q FROM eval_question)), "
    "w AS (SELECT DISTINCT canonical_id AS node, canonical_name AS name, unnest(string_split_regex(lower(canonical_name), '[^a-z0-9]+')) AS w FROM canonical_entity), "
    "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY length(name), name, node) AS n FROM w WHERE w <> '') WHERE n <= 2), "
    f"m AS (SELECT id, node, min({{p: pos, l: length(name), n: name}}) AS o FROM t JOIN b USING (w) WHERE length(w) > 2 AND w NOT IN ({_Q}) GROUP BY 1, 2) SELECT id, rank, node FROM (SELECT id, node, row_number() OVER (PARTITION BY id ORDER BY o, node) AS rank FROM m) WHERE rank <= 6"
)
def m30_lexical_seeds(spark, sf):
    c = raw(spark, sf, "canonical_entity")
    return lexical_seeds(raw(spark, sf, "eval_question").select("id", "question"), c.select(F.col("canonical_id").alias("node"), F.col("canonical_name").alias("name")))


@query("SELECT ticker, string_agg('[E' || n || '] ' || line, chr(10) ORDER BY n) AS context FROM (SELECT ticker, line, row_number() OVER (PARTITION BY ticker ORDER BY line) AS n FROM (SELECT DISTINCT ticker, name || ' (' || entity_type || ')' AS line FROM extracted_entity WHERE ticker IS NOT NULL AND name <> '' AND entity_type IS NOT NULL)) WHERE n <= 12 GROUP BY 1")
def m31_context(spark, sf):
    """The context of an issuer: its nodes in order, tagged, as many as fit."""
    e = raw(spark, sf, "extracted_entity").where("ticker IS NOT NULL AND name <> '' AND entity_type IS NOT NULL")
    lines = ranking.top_k(e.select("ticker", F.concat("name", F.lit(" ("), "entity_type", F.lit(")")).alias("line")).distinct(), ["ticker"], [F.col("line")], 12)
    all_ = F.array_sort(F.collect_list("line"))  # twelve lines
    return lines.groupBy("ticker").agg(all_.alias("l")).select("ticker", F.array_join(F.transform("l", lambda x, i: F.concat(F.lit("[E"), (i + 1).cast("string"), F.lit("] "), x)), "\n").alias("context"))


@query("SELECT ticker, array_to_string(list_sort(list(name) FILTER (WHERE n <= 6)), '; ') || CASE WHEN max(size) > 6 THEN '; and ' || (max(size) - 6) || ' more' ELSE '' END AS spokes FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY name) AS n, count(*) OVER (PARTITION BY ticker) AS size FROM (SELECT DISTINCT ticker, name FROM extracted_entity WHERE ticker IS NOT NULL AND name <> '')) GROUP BY 1")
def u7_spokes(spark, sf):
    """Six neighbours of each seed, and how many more there are."""
    e = raw(spark, sf, "extracted_entity").where("ticker IS NOT NULL AND name <> ''").select("ticker", "name").distinct()
    shown = ranking.top_k(e, ["ticker"], [F.col("name")], 6).groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("s"))
    size = e.groupBy("ticker").agg(F.count("*").alias("size"))
    more = F.when(F.col("size") > 6, F.concat(F.lit("; and "), (F.col("size") - 6).cast("string"), F.lit(" more"))).otherwise("")
    return shown.join(size, "ticker").select("ticker", F.concat("s", more).alias("spokes"))


@query("SELECT upper(ticker) AS issuer, array_to_string(list_sort(list_distinct(list(form_type) FILTER (WHERE form_type IS NOT NULL))), ', ') AS forms, count(DISTINCT id) AS n_filings FROM filing WHERE ticker IS NOT NULL GROUP BY 1")
def u8_where_to_look(spark, sf):
    """For what no evidence shows: the forms of an issuer in which it may stand."""
    f = raw(spark, sf, "filing").where("ticker IS NOT NULL")
    return f.groupBy(F.upper("ticker").alias("issuer")).agg(F.array_join(F.array_sort(F.collect_set("form_type")), ", ").alias("forms"), F.count_distinct("id").alias("n_filings"))


def eval_table(lines: DataFrame, line: str, id_pattern: str = r"^EQ-\d+$") -> DataFrame:
    """Id, cells of the rows of a Markdown table that have at least five cells and an id in the first; other lines are none."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return lines.select(cells.alias("cells")).where((F.size("cells") >= 5) & F.col("cells")[0].rlike(id_pattern)).select(F.col("cells")[0].alias("id"), "cells")


@query("SELECT id, coalesce(status, '') AS status, coalesce(section, '') AS section FROM eval_question WHERE regexp_full_match(id, 'EQ-\\d+')")
def u10_eval_table(spark, sf):
    """The evaluation set written as a Markdown table and parsed again."""
    c = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"[|\n]", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "id", c("question"), c("expected"), c("status"), c("section")), F.lit(" |"))
    t = eval_table(raw(spark, sf, "eval_question").select(line.alias("line")), "line")
    return t.select("id", F.col("cells")[3].alias("status"), F.col("cells")[4].alias("section"))


@query("SELECT (SELECT count(*) > 0 FROM company) AND (SELECT count(*) > 0 FROM filing WHERE content IS NOT NULL) AND (SELECT count(*) = 0 FROM content_label WHERE abusive NOT IN (0, 1)) AS ready, (SELECT count(*) FROM chunk WHERE filing_id NOT IN (SELECT id FROM filing WHERE id IS NOT NULL)) AS n_orphans")
def u13_readiness(spark, sf):
    """Whether all checks pass, and a count that is reported only."""
    checks = [raw(spark, sf, "company").agg((F.count("*") > 0).alias("ok")), raw(spark, sf, "filing").agg((F.count("content") > 0).alias("ok")), raw(spark, sf, "content_label").agg((F.count_if(~F.col("abusive").isin(0, 1)) == 0).alias("ok"))]
    every = checks[0].unionByName(checks[1]).unionByName(checks[2]).agg(F.bool_and("ok").alias("ready")).withColumn("one", F.lit(1))
    f = raw(spark, sf, "filing").where("id IS NOT NULL").select(F.col("id").alias("filing_id"))
    orphans = raw(spark, sf, "chunk").where("filing_id IS NOT NULL").join(f, "filing_id", "left_anti").agg(F.count("*").alias("n_orphans")).withColumn("one", F.lit(1))
    return every.join(orphans, "one").drop("one")


@query("SELECT c.ticker, count(DISTINCT f.id) AS by_ticker, (SELECT count(DISTINCT g.id) FROM filing g WHERE ltrim(regexp_replace(g.cik, '[^0-9]', '', 'g'), '0') = ltrim(c.cik, '0')) AS by_cik FROM company c LEFT JOIN filing f ON upper(f.ticker) = c.ticker GROUP BY c.ticker, c.cik")
def u14_registry_lookups(spark, sf):
    """Filings of each company, found by ticker in any case and by CIK with or without leading zeros."""
    f = raw(spark, sf, "filing").select("id", F.upper("ticker").alias("t"), F.regexp_replace(F.regexp_replace("cik", "[^0-9]", ""), "^0+", "").alias("k"))
    c = raw(spark, sf, "company").select("ticker", F.regexp_replace("cik", "^0+", "").alias("k"))
    a = f.groupBy(F.col("t").alias("ticker")).agg(F.count_distinct("id").alias("by_ticker"))
    b = f.groupBy("k").agg(F.count_distinct("id").alias("by_cik"))
    return c.join(a, "ticker", "left").join(b, "k", "left").select("ticker", F.coalesce("by_ticker", F.lit(0)).alias("by_ticker"), F.coalesce("by_cik", F.lit(0)).alias("by_cik"))


def large_amount(v: Column) -> Column:
    """An amount with T, B, M or K and two decimals; negative ones are written out."""
    steps = F.lit(None)
    for size, sign in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        steps = F.when(v >= size, F.format_string(f"$%.2f{sign}", v / size)).otherwise(steps)
    return F.when(v.isNotNull(), F.coalesce(steps, F.format_string("$%.2f", v)))


@query("SELECT c_custkey, CASE WHEN v >= 1e9 THEN printf('$%.2fB', v / 1e9) WHEN v >= 1e6 THEN printf('$%.2fM', v / 1e6) ELSE printf('$%.2f', v) END AS amount FROM (SELECT c_custkey, c_acctbal * 1e6 AS v FROM customer)")
def u15_large_amounts(spark, sf):
    return raw(spark, sf, "customer").select("c_custkey", large_amount(F.col("c_acctbal").cast("double") * 1e6).alias("amount"))


@query("SELECT stage, count(*) AS n, sum(TRY_CAST(p AS BIGINT)) AS processed, sum(TRY_CAST(f AS BIGINT)) AS failed FROM (SELECT json_extract_string(raw, '$.stage') AS stage, json_extract_string(raw, '$.items_processed') AS p, json_extract_string(raw, '$.items_failed') AS f FROM run_report WHERE json_valid(raw)) WHERE stage IS NOT NULL GROUP BY 1")
def u16_stage_totals(spark, sf):
    """The records of all runs merged into totals of each stage."""
    from ..operators.drift import readable

    j = lambda p: F.get_json_object("raw", p)
    r = raw(spark, sf, "run_report").where(readable(F.col("raw"))).select(j("$.stage").alias("stage"), j("$.items_processed").try_cast("bigint").alias("p"), j("$.items_failed").try_cast("bigint").alias("f"))
    return r.where("stage IS NOT NULL").groupBy("stage").agg(F.count("*").alias("n"), F.sum("p").alias("processed"), F.sum("f").alias("failed"))


@query("SELECT event_type, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95, round(100.0 * count(*) FILTER (WHERE value > 5) / count(*), 4) AS success_rate FROM events WHERE value IS NOT NULL GROUP BY 1")
def u17_stage_benchmark(spark, sf):
    """Mean, percentiles by index and success rate of each stage; values are counted before they are ranked."""
    e = raw(spark, sf, "events").where("value IS NOT NULL").select("event_type", "value")
    p = ranking.index_percentile(e, ["event_type"], "value", [0.5, 0.95])
    both = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(100.0 * F.count_if(F.col("value") > 5) / F.count("*"), 4).alias("success_rate"))
    return both.join(p, "event_type").select("event_type", "mean", "p50", "p95", "success_rate")
