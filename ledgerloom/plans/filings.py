"""Filing extraction, fiscal periods, catalog, sinks and small functions over whole tables (groups A, B, C, F, H, J, K, L, M, U and V)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import fiscal as K
from ..functions import strings as J
from ..operators import merge, pattern, ranking
from ..registry import query
from ..session import new_folder
from .graph import WITH, Graph


def raw(spark, sf, name):
    return Graph(spark, sf).raw(name)


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _case(column: str, pairs: dict, otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE {otherwise} END"


# -- A, B, C, F: catalog, sinks, predicates, joins -------------------------------------------------------------------------------


@query("SELECT filing_seq, id, form_type FROM filing WHERE form_type IS NOT NULL")
def a17_bulk_copy(spark, sf):
    """A bulk append of one table, and of a few rows behind it (A18), read again."""
    f, at = raw(spark, sf, "filing").where("form_type IS NOT NULL").select("filing_seq", "id", "form_type"), new_folder(spark, "bulk")
    few = F.col("filing_seq") % 100 == 0
    f.where(~few).write.mode("append").parquet(at)
    f.where(few).write.mode("append").parquet(at)
    return spark.read.schema(f.schema).parquet(at)


@query("SELECT 'before' AS moment, count(*) AS n FROM company UNION ALL SELECT 'after', 0")
def a20_delete_all(spark, sf):
    """A stored table, emptied by overwriting it with no rows of its own schema."""
    c, at = raw(spark, sf, "company"), new_folder(spark, "emptied")
    c.write.parquet(at)
    before = spark.read.schema(c.schema).parquet(at).agg(F.count("*").alias("n")).first()["n"]
    spark.createDataFrame([], c.schema).write.mode("overwrite").parquet(at)
    after = spark.read.schema(c.schema).parquet(at).agg(F.lit("after").alias("moment"), F.count("*").alias("n"))
    return spark.range(1).select(F.lit("before").alias("moment"), F.lit(before).cast("bigint").alias("n")).unionByName(after)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def a21_json_report(spark, sf):
    """A report written as JSON lines and read again."""
    at = new_folder(spark, "report")
    raw(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).write.json(at)
    return spark.read.schema("event_type string, n bigint, total double").json(at)


@query("SELECT table_name, column_name, data_type FROM (SELECT 'company' AS table_name, unnest(['ticker', 'name', 'cik', 'sic_code', 'sector', 'fiscal_year_end_month', 'fiscal_year_end_day_rule']) AS column_name, unnest(['string', 'string', 'string', 'string', 'string', 'bigint', 'string']) AS data_type)")
def a24_table_columns(spark, sf):
    """The columns of a stored table as rows: its schema, no data."""
    return spark.createDataFrame([("company", n, t) for n, t in raw(spark, sf, "company").dtypes], "table_name string, column_name string, data_type string")


@query(WITH + "SELECT id, name, entity_type FROM (SELECT ticker AS id, name, 'Company' AS entity_type FROM g_company WHERE contains(lower(ticker), 'c1') OR contains(lower(name), 'c1') OR contains('company', 'c1') UNION ALL SELECT id, name, 'Segment' FROM g_segment WHERE contains(lower(name), 'c1') OR contains(lower(segment_type), 'c1') OR contains('segment', 'c1') UNION ALL SELECT id, canonical_name, 'Metric' FROM g_metric WHERE contains(lower(canonical_name), 'c1') OR contains(lower(id), 'c1') OR contains('metric', 'c1')) ORDER BY entity_type, id LIMIT 500")
def b19_entity_search(spark, sf):
    """Entities by a part of their id, name or type, or of the very name of their label, the first 500."""
    g, q = Graph(spark, sf), "c1"

    def hits(df, label, kept, *columns):
        return df.where(reduce(lambda a, b: a | b, (F.lower(c).contains(q) for c in columns), F.lit(q in label.lower()))).select(*kept, F.lit(label).alias("entity_type"))

    parts = [hits(g.company, "Company", (F.col("ticker").alias("id"), "name"), "ticker", "name"), hits(g.segment, "Segment", ("id", "name"), "name", "segment_type"), hits(g.metric, "Metric", ("id", F.col("canonical_name").alias("name")), "canonical_name", "id")]
    return reduce(DataFrame.unionByName, parts).orderBy("entity_type", "id").limit(500)


# Words that begin a writing clause.
WRITES = ("CREATE", "INSERT", "DELETE", "DETACH", "MERGE", "SET", "REMOVE", "DROP", "COPY", "ALTER", "RENAME")


def mutates(statement: Column) -> Column:
    """Whether a statement writes: a writing word outside its string literals."""
    bare = F.regexp_replace(statement, r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"", " ")
    return bare.rlike(rf"(?i)\b(?:{'|'.join(WRITES)})\b")


@query("SELECT id, length(question) % 3 = 2 AS mutates FROM eval_question")
def b20_mutations(spark, sf):
    text = F.regexp_replace("question", r"['\"\\]", " ")
    quoted = F.concat(F.lit("MATCH (n) WHERE n.tag = 'please SET it' AND n.text = '"), text, F.lit("' RETURN n"))
    written = F.concat(F.lit("MATCH (n) WHERE n.text = '"), text, F.lit("' set n.tag = 1"))
    return raw(spark, sf, "eval_question").select("id", mutates(F.when(F.length("question") % 3 == 2, written).otherwise(quoted)).alias("mutates"))


@query("SELECT ticker, name FROM company WHERE sector IS NOT NULL AND fiscal_year_end_month > 0")
def b23_active_registry(spark, sf):
    return raw(spark, sf, "company").where("sector IS NOT NULL AND fiscal_year_end_month > 0").select("ticker", "name")


@query("SELECT DISTINCT c.ticker AS src, k.id AS dst, 'MENTIONS' AS rel FROM extracted_entity e JOIN company c ON c.ticker = e.ticker JOIN chunk k ON k.id = e.chunk_id")
def c8_created_edges(spark, sf):
    """Edges created between nodes that two keys name: two equi joins, no product."""
    e = raw(spark, sf, "extracted_entity").select("ticker", F.col("chunk_id").alias("id"))
    made = e.join(raw(spark, sf, "company").select("ticker"), "ticker", "left_semi").join(raw(spark, sf, "chunk").select("id"), "id", "left_semi")
    return made.select(F.col("ticker").alias("src"), F.col("id").alias("dst"), F.lit("MENTIONS").alias("rel")).distinct()


@query(WITH + "SELECT 0::BIGINT AS n_kept, count(*) AS n_dangling FROM g_filing")
def c19_self_edges(spark, sf):
    """Edges written from an id to itself though their ends have different labels always dangle."""
    g = Graph(spark, sf)
    edges = g.filing.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("TRANSACTED").alias("rel"))
    kept, lost = pattern.endpoints_stored(edges, g.filing, "id", g.company, "ticker")
    both = kept.select(F.lit(1).alias("k")).unionByName(lost.select(F.lit(0).alias("k")))
    return both.agg(F.count_if(F.col("k") == 1).alias("n_kept"), F.count_if(F.col("k") == 0).alias("n_dangling"))


@query("SELECT filing_seq, form_type FROM filing ORDER BY form_type NULLS LAST, filing_seq LIMIT 50")
def f2_null_key_order(spark, sf):
    """An order by a property that is null throughout: the keys behind it decide."""
    return raw(spark, sf, "filing").select("filing_seq", "form_type", F.lit(None).cast("int").alias("gone")).orderBy("gone", F.col("form_type").asc_nulls_last(), "filing_seq").limit(50).drop("gone")


@query("SELECT l_returnflag, round(sum(CASE l_returnflag WHEN 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS value FROM lineitem GROUP BY 1")
def h11_transforms(spark, sf):
    """Values under the transform of their rule: negated, or as they are and summed."""
    rule = F.when(F.col("l_returnflag") == "R", "negate").otherwise("identity")
    v = F.when(rule == "negate", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return raw(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(v), 2).alias("value"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, CAST(NULL AS DOUBLE) AS macd FROM events GROUP BY ALL")
def h4_macd(spark, sf):
    """MACD(12, 26, 9) as it is delivered: null, for its two averages never have the same length."""
    return raw(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.lit(None).cast("double").alias("macd"))


# -- J, L: text and records ------------------------------------------------------------------------------------------------------

# Entities of the text.
ENTITIES = {"&nbsp;": " ", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”", "&mdash;": "—", "&ndash;": "–", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def plain_text(c: Column) -> Column:
    """Entities as characters, runs of white space as one space, trimmed."""
    c = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), c)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _replaced(c: str) -> str:
    for a, b in ENTITIES.items():
        c = f"replace({c}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


@query(f"SELECT doc_id, trim(regexp_replace({_replaced('text')}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS plain FROM documents")
def j3_plain_text(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", plain_text(F.col("text")).alias("plain"))


# Concepts by the pattern of their label; the first that fits holds.
CONCEPTS = (
    (r"^(total )?(net )?(sales|revenues?)\b", "Revenue", "income"), (r"^cost of (sales|revenues?|goods sold)", "Cost of revenue", "income"), (r"^gross (profit|margin)", "Gross profit", "income"), (r"^operating income", "Operating income", "income"),
    (r"^net income", "Net income", "income"), (r"^total (current )?assets", "Total assets", "balance"), (r"^total liabilities", "Total liabilities", "balance"), (r"^(net )?cash (provided|used)", "Operating cash flow", "cash"),
)


def normalised_label(label: Column) -> Column:
    """A row label without its unit, what follows a double space, and a colon at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(J.clean_text(F.regexp_replace(label, r"\s{2,}.*$", "")), r"(?i)\s*\(in (thousands|millions|billions)\)$", ""), r"\s{2,}.*$", ""), r":+$", ""))


def canonical_metric(label: Column, is_percent: Column) -> Column:
    """struct(name, category): the concept of the first pattern that fits, else the label itself; percents are told apart."""
    low = F.lower(normalised_label(label))
    known = F.coalesce(*(F.when(low.rlike(p), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"))) for p, n, c in CONCEPTS), F.struct(normalised_label(label).alias("name"), F.lit(None).cast("string").alias("category")))
    return F.struct(F.concat(known["name"], F.when(is_percent, " (%)").otherwise("")).alias("name"), known["category"].alias("category"))


_SUBJECT = "trim(regexp_extract(content, '^([A-Za-z ,&-]+?) (?:of|in|from|for) ', 1))"
_LABEL = "trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace({0}, '\\s{{2,}}.*$', ''), '\\s+', ' ', 'g')), '(?i)\\s*\\(in (thousands|millions|billions)\\)$', ''), ':+$', ''))"


@query(f"SELECT filing_seq, {_LABEL.format('label')} AS label FROM (SELECT filing_seq, {_SUBJECT} || ' (in thousands):' AS l0, {_SUBJECT} || ' (in thousands)' AS label FROM filing WHERE content IS NOT NULL)")
def j15_labels(spark, sf):
    subject = F.trim(F.regexp_extract("content", "^([A-Za-z ,&-]+?) (?:of|in|from|for) ", 1))
    return raw(spark, sf, "filing").where("content IS NOT NULL").select("filing_seq", normalised_label(F.concat(subject, F.lit(" (in thousands)"))).alias("label"))


@query("SELECT filing_seq, " + "CASE " + " ".join(f"WHEN regexp_matches(lower({_SUBJECT}), '{p}') THEN '{n}'" for p, n, _ in CONCEPTS) + f" ELSE {_SUBJECT} END || CASE WHEN contains(content, '%') THEN ' (%)' ELSE '' END AS name, CASE " + " ".join(f"WHEN regexp_matches(lower({_SUBJECT}), '{p}') THEN '{c}'" for p, _, c in CONCEPTS) + " END AS category FROM filing WHERE content IS NOT NULL")
def j14_canonical_metrics(spark, sf):
    """The concept of what each filing speaks of first."""
    subject = F.trim(F.regexp_extract("content", "^([A-Za-z ,&-]+?) (?:of|in|from|for) ", 1))
    return raw(spark, sf, "filing").where("content IS NOT NULL").select("filing_seq", canonical_metric(subject, F.col("content").contains("%")).alias("m")).select("filing_seq", "m.*")


@query("SELECT id, contains(regexp_replace(lower(expected), '[^0-9a-z]', '', 'g'), regexp_replace(lower(left(expected, 40)), '[^0-9a-z]', '', 'g')) AS same, contains(regexp_replace(lower(question), '[^0-9a-z]', '', 'g'), regexp_replace(lower(left(expected, 12)), '[^0-9a-z]', '', 'g')) AS asked FROM eval_question")
def j28_containment(spark, sf):
    """Containment of what letters and digits alone leave."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z]", "")
    head = lambda n: norm(F.substring("expected", 1, n))
    return raw(spark, sf, "eval_question").select("id", norm(F.col("expected")).contains(head(40)).alias("same"), norm(F.col("question")).contains(head(12)).alias("asked"))


def protected(text: Column, block: str = r"(?md)^\|.*\|$") -> tuple[Column, Column]:
    """A text whose blocks are masked by marks, and the blocks in order; ``restored`` puts them back."""
    blocks = F.regexp_extract_all(text, F.lit(block), 0)
    parts = F.split(F.regexp_replace(text, block, "\u0000"), "\u0000")
    marked = F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.concat(F.lit("\u0000PROTECTED"), (i - 1).cast("string"), F.lit("\u0000"))).otherwise(""), p)), "")
    return marked, blocks


def restored(masked: Column, blocks: Column) -> Column:
    parts = F.split(masked, r"\u0000PROTECTED\d+\u0000")
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.coalesce(F.try_element_at(blocks, i), F.lit(""))).otherwise(""), p)), "")


@query("SELECT parsed_id, content AS restored, len(list_filter(string_split(content, chr(10)), lambda l: starts_with(l, '|') AND ends_with(l, '|') AND length(l) > 1)) AS n_blocks FROM parsed_document")
def j30_protected_blocks(spark, sf):
    """Table lines masked while the text between them is worked on, and restored."""
    masked, blocks = protected(F.col("content"))
    d = raw(spark, sf, "parsed_document").select("parsed_id", masked.alias("masked"), blocks.alias("blocks"))
    return d.select("parsed_id", restored(F.col("masked"), F.col("blocks")).alias("restored"), F.size("blocks").cast("bigint").alias("n_blocks"))


@query("SELECT sector, '| ticker | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || ticker || ' | ' || replace(name, '|', '\\|') || ' |', chr(10) ORDER BY ticker) AS markdown FROM company WHERE sector IS NOT NULL GROUP BY 1")
def j31_markdown_tables(spark, sf):
    """The companies of a sector as a Markdown table."""
    c = raw(spark, sf, "company").where("sector IS NOT NULL")
    row = F.concat(F.lit("| "), "ticker", F.lit(" | "), F.replace("name", F.lit("|"), F.lit("\\|")), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ticker", row.alias("r")))), lambda x: x["r"])
    return c.groupBy("sector").agg(F.concat(F.lit("| ticker | name |\n| --- | --- |\n"), F.array_join(rows, "\n")).alias("markdown"))


def attributes(tag: Column) -> Column:
    """L2: the attributes of a tag as a map; the last of a name holds."""
    p = F.lit(r"([A-Za-z_:][-A-Za-z0-9_:.]*)=\"([^\"]*)\"")
    return F.map_from_entries(F.arrays_zip(F.regexp_extract_all(tag, p, 1), F.regexp_extract_all(tag, p, 2)))


@query("SELECT canonical_id, 'entity_type=' || entity_type || ';name=' || canonical_name AS attributes FROM canonical_entity")
def l2_attributes(spark, sf):
    c = raw(spark, sf, "canonical_entity")
    tag = F.concat(F.lit('<ix:item name="'), "canonical_name", F.lit('" entity_type="'), "entity_type", F.lit('">'))
    pairs = F.transform(F.array_sort(F.map_entries(attributes(tag))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return c.select("canonical_id", F.array_join(pairs, ";").alias("attributes"))


def coerced_list(text: Column) -> Column:
    """L4: a JSON value as a list of JSON objects: an object alone as a list of one, anything else as an empty list."""
    t = F.trim(text)
    many = F.filter(F.from_json(t, "array<string>"), lambda x: F.trim(x).startswith("{"))
    return F.coalesce(F.when(t.startswith("{"), F.array(t)).when(t.startswith("["), many), F.array().cast("array<string>"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS n FROM events")
def l4_coerced_lists(spark, sf):
    shape = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit(", 7, "), "props", F.lit("]"))).otherwise(F.lit("junk"))
    return raw(spark, sf, "events").select("event_id", F.size(coerced_list(shape)).cast("bigint").alias("n"))


@query("SELECT mention_id, 'id=' || coalesce(id, '') || ';ticker=' || coalesce(ticker, '') AS properties FROM extracted_entity")
def l6_properties(spark, sf):
    """Property maps without their reserved keys."""
    m = F.create_map(*(x for c in ("id", "name", "ticker", "entity_type") for x in (F.lit(c), F.coalesce(F.col(c), F.lit("")))))
    kept = F.map_filter(m, lambda k, v: ~k.isin("name", "entity_type"))
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return raw(spark, sf, "extracted_entity").select("mention_id", F.array_join(pairs, ";").alias("properties"))


@query("SELECT ticker, '{\"ticker\":\"' || ticker || '\",\"month\":' || fiscal_year_end_month || ',\"listed\":true}' AS wire FROM company")
def l10_wire(spark, sf):
    return raw(spark, sf, "company").select("ticker", F.to_json(F.struct("ticker", F.col("fiscal_year_end_month").alias("month"), F.lit(True).alias("listed"))).alias("wire"))


# -- K: fiscal periods -----------------------------------------------------------------------------------------------------------


def period_metadata(key: Column, close_month: Column, close_day: Column) -> Column:
    """K6: struct(period_code, period_start, period_end, period_days, period_cumulative) of a period key such as 3M-2026-03-28; a key
    without a date gives empty values."""
    p = r"^(?:(3M|6M|9M|FY)-)?(\d{4}-\d{2}-\d{2})$"
    code, end = F.regexp_extract(key, p, 1), F.try_to_date(F.nullif(F.regexp_extract(key, p, 2), F.lit("")), "yyyy-MM-dd")
    span = K.period_span(code, end)
    cumulative = K.cumulative(code, span["start"], K.fiscal_year_start(span["start"], close_month, close_day))
    return F.struct(code.alias("period_code"), span["start"].alias("period_start"), end.alias("period_end"), F.coalesce(span["days"], F.lit(0)).alias("period_days"), F.coalesce(cumulative, F.lit(False)).cast("int").alias("period_cumulative"))


@query("SELECT filing_seq, CASE WHEN fiscal_period = 'FY' THEN 'FY' ELSE '3M' END AS period_code, period_end_date AS period_end, CASE WHEN fiscal_period = 'FY' THEN 364 ELSE 91 END AS period_days FROM filing WHERE period_end_date > DATE '1000-01-01' AND fiscal_period IS NOT NULL")
def k6_period_metadata(spark, sf):
    f = raw(spark, sf, "filing").where("period_end_date > DATE'1000-01-01' AND fiscal_period IS NOT NULL")
    key = F.concat(F.when(F.col("fiscal_period") == "FY", "FY").otherwise("3M"), F.lit("-"), F.col("period_end_date").cast("string"))
    return f.select("filing_seq", period_metadata(key, F.lit(12), F.lit(31)).alias("m")).select("filing_seq", "m.period_code", "m.period_end", "m.period_days")


@query("SELECT filing_seq, CASE WHEN CAST(fiscal_year AS VARCHAR) = strftime(period_end_date, '%Y') THEN strftime(period_end_date, '%Y-%m-%d') ELSE 'FY' || fiscal_year END AS period FROM filing WHERE fiscal_year > 0")
def k8_resolved_year(spark, sf):
    """A bare year as the filing's own period end if that falls into it."""
    own = F.year("period_end_date") == F.col("fiscal_year")
    return raw(spark, sf, "filing").where("fiscal_year > 0").select("filing_seq", F.when(own, F.col("period_end_date").cast("string")).otherwise(F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"))).alias("period"))


@query("SELECT filing_seq, CASE WHEN bits = '' THEN '' ELSE 'period ' || bits END AS label FROM (SELECT filing_seq, trim(coalesce(fiscal_period, '') || CASE WHEN year(period_end_date) > 1900 THEN ' ending ' || strftime(period_end_date, '%Y-%m-%d') ELSE '' END) AS bits FROM filing)")
def k13_period_label(spark, sf):
    """A period as text: its code, and its end unless that is a sentinel."""
    end = F.when(F.year("period_end_date") > 1900, F.concat(F.lit("ending "), F.col("period_end_date").cast("string")))
    bits = F.concat_ws(" ", F.nullif(F.trim("fiscal_period"), F.lit("")), end)
    return raw(spark, sf, "filing").select("filing_seq", F.when(bits == "", "").otherwise(F.concat(F.lit("period "), bits)).alias("label"))


@query("SELECT parsed_id, coalesce(strftime(coalesce(try_strptime(filing_date, '%Y-%m-%d'), try_strptime(filing_date, '%m/%d/%Y')), '%Y-%m-%d'), filing_date) AS day FROM parsed_document")
def k15_parsed_date(spark, sf):
    """Dates of either format as ISO text; other text as it is."""
    return raw(spark, sf, "parsed_document").select("parsed_id", F.coalesce(K.iso_date(F.col("filing_date")).cast("string"), F.col("filing_date")).alias("day"))


@query("SELECT DISTINCT f.ticker, f.fiscal_year, make_date(f.fiscal_year - 1, c.fiscal_year_end_month, 28) AS year_start, make_date(f.fiscal_year, c.fiscal_year_end_month, 28) AS year_end FROM filing f JOIN company c ON f.ticker = c.ticker WHERE f.fiscal_year > 1 AND c.fiscal_year_end_month > 0")
def k16_fiscal_years(spark, sf):
    """Nodes of fiscal years: they begin on the same day of the year before, not on the day after."""
    c = raw(spark, sf, "company").where("fiscal_year_end_month > 0").select("ticker", F.col("fiscal_year_end_month").cast("int").alias("m"))
    y = raw(spark, sf, "filing").where("fiscal_year > 1").select("ticker", "fiscal_year").distinct().join(c, "ticker")
    at = lambda y: F.make_date(y.cast("int"), F.col("m"), F.lit(28))
    return y.select("ticker", "fiscal_year", at(F.col("fiscal_year") - 1).alias("year_start"), at(F.col("fiscal_year")).alias("year_end"))


# Audit status by form.
AUDIT = {"10-K": "audited", "10-K/A": "audited", "20-F": "audited", "10-Q": "reviewed", "10-Q/A": "reviewed"}


@query(f"SELECT filing_seq, {_case('upper(trim(form_type))', AUDIT, chr(39) + 'unaudited' + chr(39))} AS audit_status FROM filing")
def k17_audit_status(spark, sf):
    """The audit status of a form; unknown ones count as unaudited."""
    return raw(spark, sf, "filing").select("filing_seq", F.coalesce(F.try_element_at(_map(AUDIT), F.upper(F.trim("form_type"))), F.lit("unaudited")).alias("audit_status"))


# -- M, U: extraction from filings -----------------------------------------------------------------------------------------------


@query("SELECT filing_seq, id, rank FROM (SELECT filing_seq, id, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC NULLS LAST, filing_seq) AS rank FROM filing WHERE form_type IN ('8-K', '8-K/A') AND ticker IS NOT NULL) WHERE rank <= 32")
def m7_events(spark, sf):
    """The events of an issuer, of current reports only, at most 32, the latest first."""
    f = raw(spark, sf, "filing").where("form_type IN ('8-K', '8-K/A') AND ticker IS NOT NULL").select("ticker", "filing_seq", "id", "filing_date")
    few = ranking.top_k(f, ["ticker"], [F.col("filing_date").desc_nulls_last(), F.col("filing_seq")], 32)
    n = F.row_number().over(W.partitionBy("ticker").orderBy(F.col("filing_date").desc_nulls_last(), "filing_seq"))
    return few.select("filing_seq", "id", n.cast("bigint").alias("rank"))


@query("SELECT filing_id, metric, arg_min(section, (rank, id)) AS section, min(rank) AS rank FROM (SELECT filing_id, id, section, unnest(regexp_extract_all(lower(text), 'gross margin|net sales|inventory|goodwill|backlog|pension cost')) AS metric, CASE section WHEN 'Item 8' THEN 0 WHEN 'Item 7' THEN 1 WHEN 'Item 1' THEN 2 ELSE 3 END AS rank FROM chunk WHERE filing_id IS NOT NULL AND section IS NOT NULL) GROUP BY 1, 2")
def m5_resolved_metrics(spark, sf):
    """Metrics of a filing, each from the section of highest priority that has it."""
    rank = F.coalesce(F.try_element_at(_map({"Item 8": 0, "Item 7": 1, "Item 1": 2}), F.col("section")), F.lit(3))
    found = raw(spark, sf, "chunk").where("filing_id IS NOT NULL AND section IS NOT NULL").select("filing_id", "id", "section", rank.alias("rank"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("gross margin|net sales|inventory|goodwill|backlog|pension cost"), 0)).alias("metric"))
    return found.groupBy("filing_id", "metric").agg(F.min_by("section", F.struct("rank", "id")).alias("section"), F.min("rank").alias("rank"))


@query("SELECT segment, count(DISTINCT doc_id) AS n_documents, count(*) AS n_mentions FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:the|The) ([A-Z][a-z]+(?: [A-Z][a-z]+)?) segment', 1)) AS segment FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def m6_segments(spark, sf):
    """The segments that texts name, with their totals."""
    s = raw(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?:the|The) ([A-Z][a-z]+(?: [A-Z][a-z]+)?) segment"), 1)).alias("segment"))
    return s.groupBy("segment").agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_mentions"))


@query("SELECT id, rank, length(paragraph) AS n FROM (SELECT id, paragraph, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank FROM (SELECT id, trim(unnest(p)) AS paragraph, generate_subscripts(p, 1) AS pos FROM (SELECT id, string_split(text, chr(10)) AS p FROM chunk WHERE section IN ('Item 1A', 'Part II Item 1A'))) WHERE length(paragraph) >= 120) WHERE rank <= 60")
def m16_risk_factors(spark, sf):
    """The paragraphs of a risk section that are long enough, at most sixty a section."""
    p = raw(spark, sf, "chunk").where("section IN ('Item 1A', 'Part II Item 1A')").select("id", F.slice(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 120), 1, 60).alias("p"))
    return p.select("id", F.posexplode("p").alias("at", "paragraph")).select("id", (F.col("at") + 1).cast("bigint").alias("rank"), F.length("paragraph").cast("bigint").alias("n"))


# Kinds of notes by a word of their text.
NOTE_KINDS = (("revenue", "revenue"), ("inventor", "inventory"), ("goodwill", "goodwill"), ("pension", "pension"), ("tax", "tax"), ("lease", "lease"), ("litigation", "contingency"))


@query("SELECT id, CASE " + " ".join(f"WHEN contains(lower(text), '{a}') THEN '{b}'" for a, b in NOTE_KINDS) + " ELSE 'other' END AS kind FROM chunk WHERE section = 'Item 8' AND length(trim(text)) >= 80")
def m15_notes(spark, sf):
    """Notes to the statements that are long enough, typed by the first word that fits."""
    kind = F.coalesce(*(F.when(F.lower("text").contains(a), F.lit(b)) for a, b in NOTE_KINDS), F.lit("other"))
    return raw(spark, sf, "chunk").where((F.col("section") == "Item 8") & (F.length(F.trim("text")) >= 80)).select("id", kind.alias("kind"))


@query("SELECT filing_seq, form_type AS amended_form_type, CASE WHEN regexp_matches(content, '(?i)restate') THEN 'restatement' ELSE 'amendment filed; reason not extracted' END AS reason FROM filing WHERE regexp_matches(form_type, '^10-[KQ]/A$')")
def m18_restatements(spark, sf):
    """Restatements: of amended annual and quarterly reports only, whatever other texts say."""
    f = raw(spark, sf, "filing").where(F.col("form_type").rlike("^10-[KQ]/A$"))
    return f.select("filing_seq", F.col("form_type").alias("amended_form_type"), F.when(F.col("content").rlike("(?i)restate"), "restatement").otherwise("amendment filed; reason not extracted").alias("reason"))


@query("SELECT DISTINCT doc_id, lower(coalesce(ticker, '') || ':' || name) AS name FROM (SELECT doc_id, ticker, list_distinct(list_transform(regexp_extract_all(text, '(?:expired|settled|discontinued|divested)[a-z ]*? in ([A-Z][a-z]+)', 1), lambda x: trim(x)))[1:20] AS names FROM documents WHERE text IS NOT NULL), unnest(names) u(name)")
def m19_discontinued(spark, sf):
    """What texts say to be given up, each name once, at most twenty a text."""
    p = F.lit("(?:expired|settled|discontinued|divested)[a-z ]*? in ([A-Z][a-z]+)")
    names = F.slice(F.array_distinct(F.regexp_extract_all("text", p, 1)), 1, 20)
    return raw(spark, sf, "documents").select("doc_id", "ticker", F.explode(names).alias("n")).select("doc_id", F.lower(F.concat(F.coalesce("ticker", F.lit("")), F.lit(":"), F.trim("n"))).alias("name")).distinct()


@query("SELECT sector, count(*) AS n_companies, count(DISTINCT left(sic_code, 2)) AS n_areas FROM company WHERE sector IS NOT NULL AND sic_code IS NOT NULL GROUP BY 1")
def m20_sectors(spark, sf):
    """A node for each sector that has a concept of its own (M20), and how many codes map to it."""
    return raw(spark, sf, "company").where("sector IS NOT NULL AND sic_code IS NOT NULL").groupBy("sector").agg(F.count("*").alias("n_companies"), F.count_distinct(F.substring("sic_code", 1, 2)).alias("n_areas"))


@query("SELECT DISTINCT ticker, fiscal_year, fiscal_period FROM filing WHERE form_type NOT IN ('8-K', '8-K/A') AND ticker IS NOT NULL AND fiscal_year > 0 AND fiscal_period IS NOT NULL")
def m22_fiscal_periods(spark, sf):
    """The fiscal periods of an issuer; current reports have none."""
    return raw(spark, sf, "filing").where("form_type NOT IN ('8-K', '8-K/A') AND ticker IS NOT NULL AND fiscal_year > 0 AND fiscal_period IS NOT NULL").select("ticker", "fiscal_year", "fiscal_period").distinct()


@query("SELECT relation, lower(ticker) AS ticker, count(*) AS n, max(criticality) AS criticality FROM (SELECT ticker, unnest(['supplier', 'component', 'product', 'manufacturing']) AS relation, unnest([contains(lower(text), 'supplier') OR contains(lower(text), 'supply'), contains(lower(text), 'component') OR contains(lower(text), 'sensor'), contains(lower(text), 'product'), contains(lower(text), 'site') OR contains(lower(text), 'plant')]) AS hit, CASE WHEN contains(lower(text), 'critical') THEN 3 WHEN contains(lower(text), 'notable') THEN 2 ELSE 1 END AS criticality FROM documents WHERE text IS NOT NULL AND ticker IS NOT NULL) WHERE hit GROUP BY 1, 2")
def m23_supply_chain(spark, sf):
    """Relations of the supply chain by their pattern table, each issuer's once, with the highest criticality."""
    low, table = F.lower("text"), {"supplier": "supplier|supply", "component": "component|sensor", "product": "product", "manufacturing": "site|plant"}
    hits = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(r)) for r, p in table.items())))
    criticality = F.when(low.contains("critical"), 3).when(low.contains("notable"), 2).otherwise(1)
    d = raw(spark, sf, "documents").where("ticker IS NOT NULL").select(F.lower("ticker").alias("ticker"), criticality.alias("criticality"), F.explode(hits).alias("relation"))
    return d.groupBy("relation", "ticker").agg(F.count("*").alias("n"), F.max("criticality").alias("criticality"))


@query("SELECT filing_seq, pos, sentence FROM (SELECT filing_seq, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT filing_seq, string_split(regexp_replace(content, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS s FROM filing WHERE form_type IN ('10-K', '10-Q') AND content IS NOT NULL)) WHERE regexp_matches(sentence, '(?i)\\b(weigh on|interrupt|risk|may have to)\\b')")
def m24_risk_sentences(spark, sf):
    """Commentary on risks: the sentences of annual and quarterly reports that hold a cue, with their place."""
    s = F.split(F.regexp_replace("content", "([.!?]) +", "$1\u0001"), "\u0001")
    d = raw(spark, sf, "filing").where("form_type IN ('10-K', '10-Q') AND content IS NOT NULL").select("filing_seq", F.posexplode(s).alias("at", "sentence"))
    return d.where(F.col("sentence").rlike(r"(?i)\b(weigh on|interrupt|risk|may have to)\b")).select("filing_seq", (F.col("at") + 1).cast("bigint").alias("pos"), "sentence")


# Record kinds by form.
FORM_KINDS = {"4": "insider", "13F-HR": "holding", "DEF 14A": "shareholder", "S-3": "raise", "EX-10.2": "plan", "EX-21": "exhibit", "EX-31.1": "exhibit", "EX-99.1": "support"}


@query(f"SELECT kind, count(*) AS n, count(DISTINCT ticker) AS n_issuers, count(*) FILTER (WHERE regexp_matches(content, '\\$[\\d,.]+')) AS n_with_amount FROM (SELECT *, {_case('form_type', FORM_KINDS, 'NULL')} AS kind FROM filing) WHERE kind IS NOT NULL GROUP BY 1")
def m25_form_records(spark, sf):
    """Records that only certain forms hold, and how many state an amount."""
    f = raw(spark, sf, "filing").withColumn("kind", F.try_element_at(_map(FORM_KINDS), F.col("form_type"))).where("kind IS NOT NULL")
    return f.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("n_issuers"), F.count_if(F.col("content").rlike(r"\$[\d,.]+")).alias("n_with_amount"))


@query("SELECT filing_seq, person FROM (SELECT filing_seq, unnest(list_distinct(regexp_extract_all(content, '(?:Compensation of|led by|answers to) ([A-Z][a-z]+ [A-Z][a-z]+)', 1))) AS person FROM filing WHERE content IS NOT NULL)")
def m26_executives(spark, sf):
    """Persons that filings name in an office, each once."""
    p = F.lit("(?:Compensation of|led by|answers to) ([A-Z][a-z]+ [A-Z][a-z]+)")
    return raw(spark, sf, "filing").select("filing_seq", F.explode(F.array_distinct(F.regexp_extract_all("content", p, 1))).alias("person"))


@query("SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'Filing' AS kind, id AS a, '' AS b FROM filing WHERE id IS NOT NULL UNION ALL SELECT DISTINCT 'SUBMITTED', ticker, id FROM filing WHERE ticker IS NOT NULL AND id IS NOT NULL UNION ALL SELECT DISTINCT 'HAS_CHUNK', filing_id, id FROM chunk WHERE filing_id IS NOT NULL UNION ALL SELECT DISTINCT 'MENTIONS', chunk_id, id FROM extracted_entity WHERE chunk_id IS NOT NULL AND id IS NOT NULL) GROUP BY 1")
def m27_assembly(spark, sf):
    """Filings assembled into nodes and edge lists, each once; how many of each kind."""
    kinds = (("Filing", "filing", "id", None), ("SUBMITTED", "filing", "ticker", "id"), ("HAS_CHUNK", "chunk", "filing_id", "id"), ("MENTIONS", "extracted_entity", "chunk_id", "id"))
    parts = [raw(spark, sf, t).select(F.lit(k).alias("kind"), F.col(a).alias("a"), (F.col(b) if b else F.lit("")).alias("b")) for k, t, a, b in kinds]
    return reduce(DataFrame.unionByName, parts).dropna().distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT parsed_id, min(line_no) AS line_no, arg_max(n_groups, (n_groups, -line_no)) AS n_groups FROM (SELECT parsed_id, pos AS line_no, len(regexp_extract_all(line, '\\$[\\d,.]+|\\d+(?:\\.\\d+)? percent')) AS n_groups, max(len(regexp_extract_all(line, '\\$[\\d,.]+|\\d+(?:\\.\\d+)? percent'))) OVER (PARTITION BY parsed_id) AS most FROM (SELECT parsed_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT parsed_id, string_split(content, chr(10))[1:6] AS l FROM parsed_document))) WHERE n_groups = most AND n_groups > 0 GROUP BY 1")
def m3_period_columns(spark, sf):
    """The row of the first six that has the most column groups, the first of equals."""
    line = F.transform(F.slice(F.split("content", "\n"), 1, 6), lambda x, i: F.struct(F.size(F.regexp_extract_all(x, F.lit(r"\$[\d,.]+|\d+(?:\.\d+)? percent"), 0)).alias("n"), (-i - 1).alias("at")))
    best = raw(spark, sf, "parsed_document").select("parsed_id", F.array_max(line).alias("b")).where("b.n > 0")
    return best.select("parsed_id", (-F.col("b.at")).cast("bigint").alias("line_no"), F.col("b.n").cast("bigint").alias("n_groups"))


# Units.
UNITS = {"usd": "USD", "shares": "shares", "pure": "ratio", "usd/shares": "USD/shares", "iso4217:usd": "USD", "usd/sh": "USD/shares", "xbrli:shares": "shares", "iso4217:eur": "EUR", "iso4217:jpy": "JPY", "iso4217:gbp": "GBP", "n": "count", "decimals": "ratio", "text": "text"}


def unit_of(ref: Column) -> Column:
    """The unit of a reference, or the reference itself; '' if missing."""
    return F.coalesce(F.try_element_at(_map(UNITS), F.lower(F.trim(ref))), F.trim(ref), F.lit(""))


def decimals_of(text: Column) -> Column:
    """Decimals as a number; -1 for INF, blank or bad text."""
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(-1))


@query(f"SELECT event_id, {_case('lower(trim(u))', UNITS, 'u')} AS unit, coalesce(TRY_CAST(d AS INTEGER), -1) AS decimals FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' USD ' WHEN 1 THEN 'iso4217:eur' WHEN 2 THEN 'barrels' ELSE '' END AS u, CASE event_id % 3 WHEN 0 THEN 'INF' WHEN 1 THEN '-3' ELSE '' END AS d FROM events)")
def u2_units(spark, sf):
    n = F.col("event_id")
    u, d = F.when(n % 4 == 0, " USD ").when(n % 4 == 1, "iso4217:eur").when(n % 4 == 2, "barrels").otherwise(""), F.when(n % 3 == 0, "INF").when(n % 3 == 1, "-3").otherwise("")
    return raw(spark, sf, "events").select("event_id", unit_of(u).alias("unit"), decimals_of(d).alias("decimals"))


AXES = ("SegmentsAxis", "ProductOrServiceAxis", "StatementGeographicalAxis", "ConsolidationItemsAxis")


@query("SELECT canonical_id, CASE WHEN canonical_id % 3 = 0 THEN NULL ELSE replace(canonical_name, ' ', '') END AS segment FROM canonical_entity")
def u1_member_segments(spark, sf):
    """The segment of an axis and member: the axis by its last part, then the member's own name; unknown axes give none."""
    c = raw(spark, sf, "canonical_entity").select("canonical_id", F.replace("canonical_name", F.lit(" "), F.lit("")).alias("leaf"))
    axis = F.when(F.col("canonical_id") % 3 == 0, "us-gaap:LegalEntityAxis").otherwise("us-gaap:SegmentsAxis")
    known = F.exists(F.array(*map(F.lit, AXES)), lambda a: F.endswith(axis, a))
    return c.select("canonical_id", F.when(known, F.element_at(F.split(F.concat(F.lit("x:"), "leaf"), ":"), -1)).alias("segment"))


@query("SELECT ticker, coalesce(mode, 'USD') AS currency FROM (SELECT ticker, arg_max(cur, (n, cur)) AS mode FROM (SELECT ticker, unnest(regexp_extract_all(content, '[$€£]')) AS cur, count(*) AS n FROM filing WHERE ticker IS NOT NULL GROUP BY 1, 2) GROUP BY 1) RIGHT JOIN (SELECT DISTINCT ticker FROM filing WHERE ticker IS NOT NULL) USING (ticker)")
def u4_currencies(spark, sf):
    """The currency that an issuer's filings declare most often; USD without any."""
    f = raw(spark, sf, "filing").where("ticker IS NOT NULL")
    n = f.select("ticker", F.explode(F.regexp_extract_all("content", F.lit("[$€£]"), 0)).alias("cur")).groupBy("ticker", "cur").agg(F.count("*").alias("n"))
    return f.select("ticker").distinct().join(n.groupBy("ticker").agg(F.max_by("cur", F.struct("n", "cur")).alias("m")), "ticker", "left").select("ticker", F.coalesce("m", F.lit("USD")).alias("currency"))


# Titles of items by form.
ITEMS = {
    "10-K": {"1": "Business", "1A": "Risk Factors", "2": "Properties", "7": "Management's Discussion", "7A": "Market Risk", "8": "Financial Statements", "9A": "Controls and Procedures"},
    "10-Q": {"1": "Financial Statements", "2": "Management's Discussion", "1A": "Risk Factors"},
}


def item_title(form: Column, code: Column) -> Column:
    """The title of an item under a form; that of its head for a sub-item; '' if unknown."""
    table = _map({f"{f}|{c}": t for f, items in ITEMS.items() for c, t in items.items()})
    at = lambda c: F.try_element_at(table, F.concat(F.upper(F.trim(form)), F.lit("|"), c))
    code = F.upper(F.trim(code))
    return F.coalesce(at(code), at(F.split(code, r"\.")[0]), F.lit(""))


_ITEM_CASE = " ".join(f"WHEN form || '|' || code = '{f}|{c}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for f, items in ITEMS.items() for c, t in items.items())


@query(f"SELECT id, CASE {_ITEM_CASE} ELSE '' END AS title FROM (SELECT id, CASE WHEN starts_with(section, 'Part') THEN '10-Q' ELSE '10-K' END AS form, regexp_extract(section, 'Item (\\w+)', 1) AS code FROM chunk WHERE section IS NOT NULL)")
def u18_item_titles(spark, sf):
    form = F.when(F.col("section").startswith("Part"), "10-Q").otherwise("10-K")
    return raw(spark, sf, "chunk").where("section IS NOT NULL").select("id", item_title(form, F.regexp_extract("section", r"Item (\w+)", 1)).alias("title"))


# -- V: pipeline bookkeeping -----------------------------------------------------------------------------------------------------


@query("SELECT source_file, count(*) AS n_documents, sum(len(string_split(content, chr(10)))) AS n_lines FROM parsed_document WHERE content IS NOT NULL GROUP BY 1")
def v1_batch_results(spark, sf):
    """One job over all files, with the results of each."""
    return raw(spark, sf, "parsed_document").where("content IS NOT NULL").groupBy("source_file").agg(F.count("*").alias("n_documents"), F.sum(F.size(F.split("content", "\n"))).alias("n_lines"))


@query("SELECT batch_no, count(*) FILTER (WHERE state = 'cached') AS cached, count(*) FILTER (WHERE state = 'downloaded') AS downloaded, count(*) FILTER (WHERE state = 'failed') AS failed FROM (SELECT batch_no, CASE WHEN content IS NULL THEN 'failed' WHEN n > 1 THEN 'cached' ELSE 'downloaded' END AS state FROM (SELECT batch_no, content, CASE WHEN id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY id ORDER BY filing_seq) END AS n FROM filing)) GROUP BY 1")
def v2_download_counts(spark, sf):
    """Of each batch how many filings were there before, came new, or failed."""
    f = raw(spark, sf, "filing")
    first = f.where("id IS NOT NULL").groupBy("id").agg(F.min("filing_seq").alias("first"))
    state = F.when(F.col("content").isNull(), "failed").when(F.col("filing_seq") > F.col("first"), "cached").otherwise("downloaded")
    s = f.join(first, "id", "left").select("batch_no", state.alias("state"))
    return s.groupBy("batch_no").agg(*(F.count_if(F.col("state") == x).alias(x) for x in ("cached", "downloaded", "failed")))


@query("SELECT filing_seq, id, coalesce(ticker, '') AS ticker, coalesce(form_type, '') AS form_type, coalesce(fiscal_year, -1) AS fiscal_year, coalesce(filing_date, DATE '0001-01-01') AS filing_date, coalesce(length(content), 0) AS n_chars, content IS NOT NULL AS has_text FROM filing")
def v3_metadata_rows(spark, sf):
    """A metadata row for each filing, sentinels in place of what is missing."""
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return raw(spark, sf, "filing").select("filing_seq", "id", d("ticker", ""), d("form_type", ""), d("fiscal_year", -1), F.coalesce("filing_date", F.lit("0001-01-01").cast("date")).alias("filing_date"), F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("n_chars"), F.col("content").isNotNull().alias("has_text"))


@query("SELECT c.ticker, count(f.filing_seq) AS n_filings, count(DISTINCT f.form_type) AS n_forms FROM company c LEFT JOIN filing f ON upper(f.ticker) = c.ticker WHERE c.sector IS NOT NULL GROUP BY 1")
def v5_active_runs(spark, sf):
    """All active companies in one partitioned job."""
    c = raw(spark, sf, "company").where("sector IS NOT NULL").select("ticker")
    n = raw(spark, sf, "filing").groupBy(F.upper("ticker").alias("ticker")).agg(F.count("*").alias("n"), F.count_distinct("form_type").alias("k"))
    return c.join(n, "ticker", "left").select("ticker", F.coalesce("n", F.lit(0)).alias("n_filings"), F.coalesce("k", F.lit(0)).alias("n_forms"))


@query("SELECT parsed_id, coalesce(nullif(regexp_extract(filing_date, '^\\d{4}-\\d{2}-\\d{2}$'), ''), nullif(regexp_extract(source_file, '/(\\d{4})/', 1), '') || '-12-31') AS period_end FROM parsed_document")
def v7_period_end(spark, sf):
    """The first full date of the metadata, else the year in the file's path."""
    full, year = F.regexp_extract("filing_date", r"^\d{4}-\d{2}-\d{2}$", 0), F.regexp_extract("source_file", r"/(\d{4})/", 1)
    return raw(spark, sf, "parsed_document").select("parsed_id", F.coalesce(F.nullif(full, F.lit("")), F.concat(F.nullif(year, F.lit("")), F.lit("-12-31"))).alias("period_end"))


@query("SELECT parsed_id, line_no, cells[1] AS label, nullif(list_filter(list_transform(cells[2:], lambda c: regexp_extract(c, '\\d[\\d,]*(?:\\.\\d+)?')), lambda x: x <> '')[1], '') AS first_number, len(list_filter(cells, lambda c: contains(c, 'percent') OR contains(c, '%'))) > 0 AS has_percent FROM (SELECT parsed_id, pos AS line_no, list_transform(string_split(trim(line, '|'), '|'), lambda x: trim(x)) AS cells FROM (SELECT parsed_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT parsed_id, string_split(content, chr(10)) AS l FROM parsed_document)) WHERE starts_with(line, '|') AND ends_with(line, '|'))")
def v8_column_bands(spark, sf):
    """The label of a table row, the first number behind it, and whether a cell has the mark of a percentage."""
    lines = raw(spark, sf, "parsed_document").select("parsed_id", F.posexplode(F.split("content", "\n")).alias("at", "line")).where(F.col("line").startswith("|") & F.col("line").endswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    c = lines.select("parsed_id", (F.col("at") + 1).cast("bigint").alias("line_no"), cells.alias("c"))
    numbers = F.filter(F.transform(F.slice("c", 2, 1000), lambda x: F.regexp_extract(x, r"\d[\d,]*(?:\.\d+)?", 0)), lambda x: x != "")
    return c.select("parsed_id", "line_no", F.col("c")[0].alias("label"), F.try_element_at(numbers, F.lit(1)).alias("first_number"), F.exists("c", lambda x: x.contains("percent") | x.contains("%")).alias("has_percent"))


@query("SELECT mention_id, coalesce(regexp_full_match(name, '[A-Z][A-Za-z.''-]*( [A-Z][A-Za-z.''-]*)+') AND NOT regexp_matches(lower(name), '\\b(which|that|because|the company|our)\\b'), false) AS proper FROM extracted_entity")
def v11_proper_names(spark, sf):
    """Names of at least two words, all with capitals, and no words of a clause."""
    n = F.col("name")
    return raw(spark, sf, "extracted_entity").select("mention_id", F.coalesce(n.rlike("^[A-Z][A-Za-z.'-]*( [A-Z][A-Za-z.'-]*)+$") & ~F.lower(n).rlike(r"\b(which|that|because|the company|our)\b"), F.lit(False)).alias("proper"))


def anchors(df: DataFrame, key: str, html: str) -> DataFrame:
    """Key, anchor, position: where each fragment id begins; of several of one id the last holds."""
    parts = F.split(html, r"(?=<a id=\")")
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    each = df.select(key, F.explode(F.arrays_zip(parts.alias("p"), F.slice(ends, 1, F.size(parts)).alias("at"))).alias("x"))
    found = each.select(key, F.regexp_extract("x.p", r"^<a id=\"([^\"]*)\"", 1).alias("anchor"), F.col("x.at").cast("bigint").alias("position")).where("anchor <> ''")
    return found.groupBy(key, "anchor").agg(F.max("position").alias("position"))


@query("SELECT ticker, 'x' AS anchor, 21 + length(name) AS position FROM company UNION ALL SELECT ticker, 'y', 42 + length(name) FROM company")
def v13_anchors(spark, sf):
    html = F.concat(F.lit('<p><a id="x"></a>    '), "name", F.lit('<a id="x"></a>       <a id="y"></a>'))
    return anchors(raw(spark, sf, "company").select("ticker", html.alias("h")), "ticker", "h")


@query("SELECT id, CASE WHEN contains(lower(text), 'margin') THEN 'margin' WHEN contains(lower(text), 'sales') OR contains(lower(text), 'revenue') THEN 'revenue' WHEN contains(lower(text), 'cost') THEN 'cost' ELSE '' END AS outcome FROM chunk WHERE section IN ('Item 7', 'Item 2')")
def v14_item_outcomes(spark, sf):
    """The outcome that a passage of certain items speaks of: the first of an ordered list."""
    t = F.lower("text")
    outcome = F.when(t.contains("margin"), "margin").when(t.contains("sales") | t.contains("revenue"), "revenue").when(t.contains("cost"), "cost").otherwise("")
    return raw(spark, sf, "chunk").where("section IN ('Item 7', 'Item 2')").select("id", outcome.alias("outcome"))


@query(WITH + "SELECT c.ticker, c.name, f.id AS filing, f.form_type FROM (SELECT ticker, name FROM g_company WHERE contains(lower(name), '00') ORDER BY ticker LIMIT 20) c JOIN g_submitted s ON s.src = c.ticker JOIN g_filing f ON f.id = s.dst")
def v17_one_hop_by_name(spark, sf):
    """Twenty companies by a part of their name, with what is one hop away."""
    g = Graph(spark, sf)
    few = g.company.where(F.lower("name").contains("00")).select("ticker", "name").orderBy("ticker").limit(20)
    return few.join(g.submitted, F.col("ticker") == F.col("src")).join(g.filing.select(F.col("id").alias("filing"), "form_type"), F.col("dst") == F.col("filing")).select("ticker", "name", "filing", "form_type")


@query("SELECT day, errors / n > 0.25 AS saturated FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1)")
def v20_saturation(spark, sf):
    """Whether a day's run would have to stop for its error rate."""
    return raw(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "error") / F.count("*") > 0.25).alias("saturated"))


@query("SELECT batch_no, count(DISTINCT h) AS n_to_extract FROM (SELECT batch_no, sha256(content) AS h, min(batch_no) OVER (PARTITION BY content) AS first FROM filing WHERE content IS NOT NULL AND batch_no IS NOT NULL) WHERE batch_no = first GROUP BY 1")
def v21_extraction_plan(spark, sf):
    """What a cache keyed by content leaves to extract of each batch."""
    f = raw(spark, sf, "filing").where("content IS NOT NULL AND batch_no IS NOT NULL").groupBy(F.sha2("content", 256).alias("h")).agg(F.min("batch_no").alias("batch_no"))
    return f.groupBy("batch_no").agg(F.count("*").alias("n_to_extract"))


FORM_GROUPS = {"annual": ("10-K", "10-K/A"), "quarterly": ("10-Q", "10-Q/A"), "current": ("8-K", "8-K/A")}


@query("SELECT grp, f.form_type, count(*) AS n, count(p.parsed_id) AS n_documents FROM filing f JOIN (VALUES " + ", ".join(f"('{g}', '{x}')" for g, fs in FORM_GROUPS.items() for x in fs) + ") v(grp, form_type) ON v.form_type = f.form_type LEFT JOIN (SELECT content_hash, min(parsed_id) AS parsed_id FROM parsed_document WHERE content_hash IS NOT NULL GROUP BY 1) p ON p.content_hash = f.content_hash GROUP BY 1, 2")
def v22_form_groups(spark, sf):
    """Form groups expanded to their forms, with the documents of equal hash attached."""
    groups = spark.createDataFrame([(g, x) for g, fs in FORM_GROUPS.items() for x in fs], "grp string, form_type string")
    p = raw(spark, sf, "parsed_document").where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("parsed_id").alias("parsed_id"))
    f = raw(spark, sf, "filing").select("form_type", "content_hash").join(F.broadcast(groups), "form_type").join(p, "content_hash", "left")
    return f.groupBy("grp", "form_type").agg(F.count("*").alias("n"), F.count("parsed_id").alias("n_documents"))


@query("SELECT source_file, parsed_id, CASE WHEN n = 1 THEN source_file ELSE regexp_replace(source_file, '\\.([^.]*)$', '_' || n || '.\\1') END AS archived FROM (SELECT source_file, parsed_id, row_number() OVER (PARTITION BY source_file ORDER BY parsed_id) AS n FROM parsed_document)")
def v23_archive_names(spark, sf):
    """Names in the archive that don't collide: a later file of a name gets its number."""
    n = F.row_number().over(W.partitionBy("source_file").orderBy("parsed_id"))
    d = raw(spark, sf, "parsed_document").select("source_file", "parsed_id", n.cast("string").alias("n"))
    name = F.concat(F.regexp_replace("source_file", r"\.([^.]*)$", ""), F.lit("_"), "n", F.lit("."), F.regexp_extract("source_file", r"\.([^.]*)$", 1))
    return d.select("source_file", "parsed_id", F.when(F.col("n") == "1", F.col("source_file")).otherwise(name).alias("archived"))


@query("SELECT id, 'Question: ' || question || chr(10) || 'Evidence:' || chr(10) || coalesce(list_aggregate(list_transform(list_filter([expected, section], lambda x: x IS NOT NULL), lambda x, i: '[E' || i || '] ' || x), 'string_agg', chr(10)), 'none') AS prompt FROM eval_question")
def v24_prompts(spark, sf):
    """A prompt made of a question and its tagged evidence; without evidence it says so."""
    e = F.transform(F.array_compact(F.array("expected", "section")), lambda x, i: F.concat(F.lit("[E"), (i + 1).cast("string"), F.lit("] "), x))
    body = F.when(F.size(e) > 0, F.array_join(e, "\n")).otherwise("none")
    return raw(spark, sf, "eval_question").select("id", F.concat(F.lit("Question: "), "question", F.lit("\nEvidence:\n"), body).alias("prompt"))


@query("SELECT chunk_id, slug, arg_min(name, mention_id) AS name FROM (SELECT chunk_id, mention_id, name, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS slug FROM extracted_entity WHERE chunk_id IS NOT NULL) WHERE slug <> '' GROUP BY 1, 2")
def v26_identified(spark, sf):
    """The entities that a passage names, the first spelling of each slug."""
    e = raw(spark, sf, "extracted_entity").where("chunk_id IS NOT NULL").select("chunk_id", "mention_id", "name", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "").alias("slug")).where("slug <> ''")
    return merge.first_wins(e, ["chunk_id", "slug"], ["mention_id"]).select("chunk_id", "slug", "name")


@query("SELECT label, count(*) AS n, round(avg(0.6 * lexical + 0.4 * c), 4) AS blend FROM (SELECT e.label, e.vec_id, greatest(0, least(1, list_dot_product(e.embedding::DOUBLE[], s.embedding::DOUBLE[]))) AS c, CASE WHEN e.label = s.label THEN 0.9 ELSE 0.5 END AS lexical FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) s) GROUP BY 1")
def n7_blended_similarity(spark, sf):
    """Lexical and embedding similarity blended 0.6 to 0.4 against one item; a lexical score of 0.95 and more would stand alone."""
    e = raw(spark, sf, "embeddings")
    seed = e.where("vec_id = 0").select("embedding", "label").first()
    dot = F.aggregate(F.zip_with("embedding", F.array(*(F.lit(float(x)) for x in seed["embedding"])), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    lexical = F.when(F.col("label") == seed["label"], 0.9).otherwise(0.5)
    blend = F.when(lexical >= 0.95, lexical).otherwise(0.6 * lexical + 0.4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(blend), 4).alias("blend"))


@query("SELECT entity_type, k, min(mention_id) AS first_mention FROM (SELECT lower(entity_type) AS entity_type, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k, mention_id FROM extracted_entity WHERE name IS NOT NULL AND entity_type IS NOT NULL) WHERE k <> '' GROUP BY 1, 2")
def n9_registry_round_trip(spark, sf):
    """The registry of resolved entities, stored by type and read again."""
    at = new_folder(spark, "registry")
    e = raw(spark, sf, "extracted_entity").where("name IS NOT NULL AND entity_type IS NOT NULL").select(F.lower("entity_type").alias("entity_type"), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "").alias("k"), "mention_id").where("k <> ''")
    e.groupBy("entity_type", "k").agg(F.min("mention_id").alias("first_mention")).write.partitionBy("entity_type").parquet(at)
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("first_mention", T.LongType()), T.StructField("entity_type", T.StringType())])
    return spark.read.schema(schema).parquet(at).select("entity_type", "k", "first_mention")


@query("SELECT batch_no, count(*) AS n_processed FROM (SELECT id, min(batch_no) AS batch_no FROM filing WHERE id IS NOT NULL AND batch_no IS NOT NULL GROUP BY 1) GROUP BY 1")
def r4_checkpointed_stages(spark, sf):
    """A pipeline in stages that skips the ids it has processed: each run takes what earlier ones left, and records it."""
    at = new_folder(spark, "stages")
    f = raw(spark, sf, "filing").where("id IS NOT NULL AND batch_no IS NOT NULL").select("id", "batch_no")
    done = spark.createDataFrame([], f.schema)
    cut = f.agg(F.max("batch_no")).first()[0] or 0
    for upto in (cut // 2, cut):  # two runs, the second after a restart
        fresh = f.where(F.col("batch_no") <= upto).join(done.select("id"), "id", "left_anti").groupBy("id").agg(F.min("batch_no").alias("batch_no"))
        fresh.write.mode("append").parquet(at)
        done = spark.read.schema(f.schema).parquet(at)
    return done.groupBy("batch_no").agg(F.count("*").alias("n_processed"))


@query("SELECT filing_seq, length(content) AS n FROM filing WHERE content IS NOT NULL")
def r5_ordered_replay(spark, sf):
    """Extraction in parallel, results in the order of arrival."""
    got = raw(spark, sf, "filing").where("content IS NOT NULL").select("filing_seq", F.length("content").cast("bigint").alias("n"))
    return got.repartition("filing_seq").orderBy("filing_seq")
