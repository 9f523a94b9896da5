"""Problem 6: lines repeated across one site's documents.

Pass 1 builds a mergeable summary of each site's lines: counters of a count-min sketch, added up per partition before the shuffle and
over partitions after it. A counter never falls short of the documents of any line that it counts, so every line that is frequent
enough stays a candidate. Pass 2 counts the candidate lines exactly; pass 3 removes the confirmed lines.

The three passes share one written table of the documents' distinct line keys (16 bytes a line instead of the text). The confirmed set
is counted first and broadcast only under ``BROADCAST_LINES``; beyond that the same joins shuffle, and adaptive execution splits the
lines of a large site.

Defined results: documents with a null or blank ticker belong to no site and stay whole; a null content stays null; a line without
letters is never removed; lines of one document count once; a document read twice under one id counts twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..session import written
from .forms import BREAKS, one_form

LEAST_DOCUMENTS = 6
#: Counters of a site's sketch, in two rows.
WIDTH, DEPTH = 1 << 20, 2
#: Most confirmed lines that are broadcast (under 40 bytes each).
BROADCAST_LINES = 500_000

_BREAKS = re.compile(f"[\r{BREAKS}]")  # only \n ends a line
_DIGITS, _RUNS, _LETTER = re.compile(r"\d+"), re.compile(r"[^\S\n]+"), re.compile(r"[^\W\d_]")


def line_keys(content: str) -> list[int | None]:
    """A 64-bit key of each line, None for lines without letters. Lines are compared in the consistent form without digits and
    without outer and repeated spaces."""
    lines = _RUNS.sub(" ", _DIGITS.sub("", one_form(_BREAKS.sub(" ", content)))).split("\n")
    return [xxhash.xxh3_64_intdigest(s) - (1 << 63) if _LETTER.search(s := x.strip()) else None for x in lines]


def _keys(values: pa.Array) -> pa.Array:
    return pa.array([None if x is None else line_keys(x) for x in values.to_pylist()], pa.list_(pa.int64()))


def keys_of(content: Column) -> Column:
    return F.arrow_udf(_keys, ArrayType(LongType()))(content)


def site_of(ticker: Column) -> Column:
    return F.nullif(F.upper(F.trim(ticker)), F.lit(""))


def site_lines(df: DataFrame, key: str = "parsed_id", site: str = "ticker", content: str = "content") -> DataFrame:
    """parsed_id, site, line_no, line: the lines with letters of documents that belong to a site."""
    own = df.select(F.col(key).cast("bigint").alias("parsed_id"), site_of(F.col(site)).alias("site"), F.col(content).alias("content")).where("site IS NOT NULL AND content IS NOT NULL")
    lines = own.select("parsed_id", F.xxhash64("site").alias("site"), F.posexplode(keys_of(F.col("content"))).alias("at", "line"))
    return lines.where("line IS NOT NULL").select("parsed_id", "site", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def _cell(row: int) -> Column:
    return F.pmod(F.xxhash64("site", "line", F.lit(row)), F.lit(WIDTH))


def repeated_lines(lines: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """site, line, n_documents of the lines that at least ``least`` documents of a site hold."""
    once = lines.select("parsed_id", "site", "line").withColumn("cells", F.array(*[F.struct(F.lit(r).alias("row"), _cell(r).alias("cell")) for r in range(DEPTH)]))
    # A line that recurs within a document may count more than once here: the summary may only exceed the truth.
    sketch = once.select("site", F.explode("cells").alias("c")).groupBy("site", "c.row", "c.cell").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    candidate = once.select("parsed_id", "site", "line")
    for r in range(DEPTH):
        cells = sketch.where(F.col("row") == r).select("site", F.col("cell").alias(f"cell{r}"))
        candidate = candidate.withColumn(f"cell{r}", _cell(r)).join(cells, ["site", f"cell{r}"], "left_semi")
    return candidate.select("parsed_id", "site", "line").distinct().groupBy("site", "line").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") >= least)


def found(df: DataFrame, least: int = LEAST_DOCUMENTS, **columns: str) -> DataFrame:
    """parsed_id, line_no of every occurrence of a repeated line."""
    lines = written(site_lines(df, **columns), "lines")
    confirmed = written(repeated_lines(lines, least).select("site", "line"), "confirmed")
    if confirmed.count() <= BROADCAST_LINES:
        confirmed = F.broadcast(confirmed)
    return lines.join(confirmed, ["site", "line"], "left_semi").select("parsed_id", "line_no")


def without_repeated(df: DataFrame, least: int = LEAST_DOCUMENTS, key: str = "parsed_id", site: str = "ticker", content: str = "content") -> DataFrame:
    """Every document: parsed_id, content without the repeated lines of its site, n_removed."""
    confirmed = written(repeated_lines(written(site_lines(df, key, site, content), "lines"), least).select("site", "line"), "confirmed")
    own = df.select(F.col(key).cast("bigint").alias("parsed_id"), F.xxhash64(site_of(F.col(site))).alias("site"), site_of(F.col(site)).isNotNull().alias("of_site"), F.col(content).alias("content"))
    if confirmed.count() > BROADCAST_LINES:  # the lines to remove of each document come to it by a join
        drop = site_lines(df, key, site, content).join(confirmed, ["site", "line"], "left_semi").groupBy("parsed_id").agg(F.collect_set("line_no").alias("drop"))
        own = own.join(drop, "parsed_id", "left")
        kept = F.filter(F.split("content", "\n", -1), lambda x, i: ~F.array_contains("drop", (i + 1).cast("bigint")))
        whole = F.col("drop").isNull() | F.col("content").isNull()
        return own.select("parsed_id", F.when(whole, F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"))
    sets: dict[int, set[int]] = {}
    for r in confirmed.toLocalIterator():
        sets.setdefault(r["site"], set()).add(r["line"])
    shared = df.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sites, of, texts = (c.to_pylist() for c in batch.columns)
            out, removed = [], []
            for s, o, t in zip(sites, of, texts):
                drop = shared.value.get(s) if o and t is not None else None
                if drop:
                    lines = t.split("\n")
                    kept = [x for x, k in zip(lines, line_keys(t)) if k not in drop]
                    removed.append(len(lines) - len(kept))
                    t = "\n".join(kept)
                else:
                    removed.append(0)
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(removed, pa.int32())], ["parsed_id", "content", "n_removed"])

    return own.mapInArrow(run, "parsed_id bigint, content string, n_removed int")


def lines_removed(df: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """site, line, n_documents, n_lines: the lines removed of each site, as one of their occurrences has them."""
    lines = written(site_lines(df), "lines")
    repeated = repeated_lines(lines, least)
    occurrences = lines.join(repeated, ["site", "line"]).groupBy("site", "line").agg(F.max("n_documents").alias("n_documents"), F.count("*").alias("n_lines"), F.min(F.struct("parsed_id", "line_no")).alias("one"))
    texts = df.select(F.col("parsed_id").cast("bigint").alias("pid"), site_of(F.col("ticker")).alias("ticker"), F.split("content", "\n", -1).alias("own"))
    return occurrences.join(texts, F.col("one.parsed_id") == F.col("pid")).select(F.col("ticker").alias("site"), F.trim(F.element_at("own", F.col("one.line_no").cast("int"))).alias("line"), "n_documents", "n_lines")
