"""Document operators (groups A and M): chunkers, sections, events, tables, tagged facts, cue extraction.

Each takes a DataFrame with a key column and a text column, and returns a row per thing found. Null texts give no rows; empty texts none
unless said otherwise. Built-in expressions do the work; only HTML, whose structure they cannot follow, is parsed in Arrow batches.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.strings import clean_text, sentences, tokens


def token_windows(df: DataFrame, key: str, text: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """key, window_no, token_start, token_end, text: windows of ``size`` tokens that share ``overlap`` (M9). The last window ends with the
    text; a text without tokens gives none."""
    own = df.select(key, tokens(F.col(text)).alias("t")).withColumn("n", F.size("t")).where("n > 0")
    step = size - overlap
    # The first window that reaches the end is the last one.
    last = F.greatest(F.ceil((F.col("n") - size) / step), F.lit(0)).cast("int")
    each = own.select(key, "t", "n", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    a = F.col("window_no") * step
    return each.select(key, "window_no", a.alias("token_start"), F.least(a + size, F.col("n")).alias("token_end"), F.array_join(F.slice("t", a + 1, F.lit(size)), " ").alias("text"))


def pages(df: DataFrame, key: str, text: str, width: int = 3000) -> DataFrame:
    """key, page, text: segments of a fixed width."""
    n = F.ceil(F.length(text) / width).cast("int")
    own = df.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(1), n)).alias("page"))
    return own.select(key, "page", F.substring(F.col(text), (F.col("page") - 1) * width + 1, F.lit(width)).alias("text"))


def char_chunks(df: DataFrame, key: str, text: str, most: int = 2000, least: int = 40) -> DataFrame:
    """key, chunk_no, text: sentences gathered into chunks of at most ``most`` characters (M8); chunks of under ``least`` are dropped, a
    longer sentence stands alone, cut at ``most``."""
    parts = F.flatten(F.transform(sentences(F.col(text)), lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / most), F.lit(1)).cast("int") - 1), lambda i: F.substring(s, i * most + 1, F.lit(most)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, s: Column) -> Column:
        joined = F.when(a["open"] == "", s).otherwise(F.concat(a["open"], F.lit(" "), s))
        fits = F.length(joined) <= most
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"), F.when(fits, joined).otherwise(s).alias("open"))

    chunks = F.aggregate(parts, start, step, lambda a: F.filter(F.concat(a["done"], F.array(a["open"])), lambda c: F.length(c) >= least))
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(chunks).alias("chunk_no", "text"))


def markdown_chunks(df: DataFrame, key: str, text: str, most: int = 3000) -> DataFrame:
    """key, chunk_no, heading, text: Markdown cut at headings first, then at paragraphs, gathered up to ``most`` characters."""
    parts = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\n(?=#{1,6} )|\n\s*\n")).alias("no", "part"))
    heading = F.nullif(F.regexp_extract("part", r"^(#{1,6} [^\n]*)", 1), F.lit(""))
    o = W.partitionBy(key).orderBy("no")
    placed = parts.withColumn("heading", F.last(heading, ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, 0))).withColumn("section", F.sum(heading.isNotNull().cast("int")).over(o))
    upto = F.sum(F.length("part") + 2).over(W.partitionBy(key, "section").orderBy("no"))
    grouped = placed.withColumn("slot", F.floor((upto - 1) / most))
    out = grouped.groupBy(key, "section", "slot").agg(F.min("no").alias("first"), F.max("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda x: x["part"]), "\n\n").alias("text"))
    return out.select(key, F.row_number().over(W.partitionBy(key).orderBy("first")).alias("chunk_no"), "heading", "text")


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def pipe_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no, row_no, col_no, cell of tables written with bars (A7, M4): neighbouring lines that begin and end with a bar."""
    rows = lines_of(df, key, text).where(F.trim("line").rlike(r"^\|.*\|$") & ~F.trim("line").rlike(r"^\|[\s|:-]+\|$"))
    o = W.partitionBy(key).orderBy("line_no")
    opens = F.coalesce((F.col("line_no") - F.lag("line_no").over(o) > 1).cast("int"), F.lit(1))
    numbered = rows.withColumn("opens", opens).withColumn("table_no", F.sum("opens").over(o.rowsBetween(W.unboundedPreceding, 0)))
    numbered = numbered.withColumn("row_no", F.row_number().over(W.partitionBy(key, "table_no").orderBy("line_no")))
    cells = F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|")
    return numbered.select(key, "table_no", "row_no", F.posexplode(cells).alias("at", "cell")).select(key, "table_no", "row_no", (F.col("at") + 1).alias("col_no"), F.trim("cell").alias("cell"))


class _Reader(HTMLParser):
    """Cells of tables and the visible text of an HTML document."""

    SKIP, BLOCK = {"script", "style", "head", "title"}, {"p", "div", "tr", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells, self.text, self.open, self.n_tables, self.hidden = [], [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        style = dict(attrs).get("style") or ""
        if tag in self.SKIP or self.hidden or re.search(r"display\s*:\s*none", style):
            self.hidden += tag not in ("br", "hr", "img", "input", "meta", "link")
            return
        if tag == "table":
            self.n_tables += 1
            self.open.append([self.n_tables, 0, 0, None])
        elif self.open and tag == "tr":
            self.open[-1][1] += 1
            self.open[-1][2] = 0
        elif self.open and tag in ("td", "th"):
            self._close()
            self.open[-1][2] += 1
            self.open[-1][3] = []
        if tag in self.BLOCK:
            self.text.append("\n")

    def _close(self):
        t, r, c, words = self.open[-1]
        if words is not None:
            self.cells.append((t, r, c, re.sub(r"\s+", " ", "".join(words)).strip()))
            self.open[-1][3] = None

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden -= 1
            return
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.open.pop()
        if tag in self.BLOCK:
            self.text.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.open and self.open[-1][3] is not None:
                self.open[-1][3].append(data)


CELL = T.StructType([T.StructField(c, T.IntegerType()) for c in ("table_no", "row_no", "col_no")] + [T.StructField("cell", T.StringType())])


def _read(html: str | None) -> _Reader:
    r = _Reader()
    r.feed(html or "")
    r.close()
    return r


def _cells(values: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("table_no", pa.int32()), ("row_no", pa.int32()), ("col_no", pa.int32()), ("cell", pa.string())]))
    return pa.array([[dict(zip(("table_no", "row_no", "col_no", "cell"), c)) for c in _read(x).cells] for x in values.to_pylist()], kind)


def _texts(values: pa.Array) -> pa.Array:
    return pa.array([None if x is None else re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\xa0]+", " ", "".join(_read(x).text))).strip() for x in values.to_pylist()], pa.string())


def html_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, col_no, cell of HTML tables, nested ones by themselves."""
    return df.select(key, F.explode(F.arrow_udf(_cells, T.ArrayType(CELL))(html)).alias("c")).select(key, "c.*")


def html_text(html: Column) -> Column:
    """The visible text of an HTML document, block by block."""
    return F.arrow_udf(_texts, T.StringType())(html)


def xbrl_facts(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, fact_no, tag, context, value, unit: inline tagged facts (M12). Scale and sign are applied; dashes give null; equal facts of
    one context once."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)(<ix:nonFraction\b[^>]*>.*?</ix:nonFraction>)"), 1)
    one = df.select(key, F.posexplode(found).alias("fact_no", "x"))
    attribute = lambda a: F.nullif(F.regexp_extract("x", rf'\b{a}="([^"]*)"', 1), F.lit(""))
    shown = F.regexp_replace(F.regexp_extract("x", r"(?s)>(.*)</ix:nonFraction>", 1), r"<[^>]+>|[,\s$]", "")
    value = shown.try_cast("double") * F.pow(F.lit(10.0), F.coalesce(attribute("scale").try_cast("int"), F.lit(0))) * F.when(attribute("sign") == "-", -1.0).otherwise(1.0)
    facts = one.select(key, "fact_no", attribute("name").alias("tag"), attribute("contextRef").alias("context"), value.alias("value"), attribute("unitRef").alias("unit"))
    first = facts.groupBy(key, "tag", "context", "value", "unit").agg(F.min("fact_no").alias("fact_no"))
    return first.select(key, "fact_no", "tag", "context", "value", "unit")


def item_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, item_code, title, start, end: sections from one "Item N." heading to the next (M14, E7); headings that follow each other
    closely (a table of contents) are dropped (E9)."""
    heads = lines_of(df, key, text).withColumn("size", F.length("line") + 1)
    o = W.partitionBy(key).orderBy("line_no")
    placed = heads.withColumn("start", F.coalesce(F.sum("size").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    item = F.regexp_extract("line", r"(?i)^\W*item\s+(\d{1,2}[AB]?(?:\.\d{2})?)\b", 1)
    found = placed.where(item != "").select(key, F.upper(item).alias("item_code"), clean_text(F.regexp_replace("line", r"(?i)^\W*item\s+\d{1,2}[AB]?(?:\.\d{2})?[.:\s—-]*", "")).alias("title"), "start")
    near = (F.lead("start").over(W.partitionBy(key).orderBy("start")) - F.col("start")) < 80
    kept = found.withColumn("near", F.coalesce(near, F.lit(False))).where("NOT near").drop("near")
    total = df.select(key, F.length(text).alias("total"))
    return kept.join(total, key).withColumn("end", F.coalesce(F.lead("start").over(W.partitionBy(key).orderBy("start")), F.col("total"))).drop("total")


def cue_relations(df: DataFrame, key: str, text: str, cues: list[tuple[str, str]], outcomes: list[tuple[str, str]]) -> DataFrame:
    """key, sentence_no, relation, outcome, sentence: sentences of 40 to 600 characters with a cue, the first in the order given, and the
    first outcome named (M17)."""
    s = df.select(key, F.posexplode(sentences(F.col(text))).alias("sentence_no", "sentence")).where(F.length("sentence").between(40, 600))
    low = F.lower("sentence")
    first = lambda pairs: F.coalesce(*(F.when(low.rlike(p), F.lit(n)) for n, p in pairs))
    return s.select(key, "sentence_no", first(cues).alias("relation"), first(outcomes).alias("outcome"), "sentence").where("relation IS NOT NULL")


def capitalised_spans(text: Column) -> Column:
    """Runs of capitalised words of any script, accents composed or apart, as candidates for names."""
    word = r"\p{Lu}[\p{L}\p{M}'’-]+"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?U)\b{word}(?:\s+{word}){{0,3}}"), 0))


def filing_metadata(text: Column) -> Column:
    """struct(form_type, fiscal_year, period_end, cik, ticker) found in a text (M1, M2); parts not found are null."""
    get = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.struct(
        F.upper(get(r"(?i)\b(10-[KQ](?:/A)?|8-K(?:/A)?|DEF 14A|S-\d)\b")).alias("form_type"), get(r"(?i)fiscal\s+(?:year\s+)?((?:19|20)\d{2})").cast("int").alias("fiscal_year"),
        get(r"((?:19|20)\d{2}-\d{2}-\d{2})").alias("period_end"), get(r"(?i)\bCIK[:#\s]*0*(\d{4,10})").alias("cik"), get(r"\((?:[A-Z]+:\s*)?([A-Z]{1,5})\)").alias("ticker"),
    )


def row_sentences(df: DataFrame, name: str) -> Column:
    """A delimited row as a sentence (A8): ``Record in [name]: K is V, ...``; missing values are left out."""
    parts = [F.when(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c} is "), F.col(f"`{c}`").cast("string"))) for c in df.columns]
    return F.concat(F.lit(f"Record in [{name}]: "), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("."))
