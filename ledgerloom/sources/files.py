"""Readers and writers (group A): filing trees, HTML, delimited and plain text, JSON lines, columnar JSON, spilled tables, upserts, schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators.documents import html_text, row_sentences
from ..operators.merge import first_wins

SUPPORTED = ("htm", "html", "txt", "md", "csv", "tsv")
#: Columns typed by name, whatever the table; all others are text.
INTEGERS = ("fiscal_year", "period_days", "period_cumulative", "reporting_lag_in_days", "chunk_index", "fiscal_year_end_month")
DATES = ("filing_date", "period_start", "period_end", "period_end_date", "transaction_date")
DOUBLES = ("value", "reported_value", "confidence")


def column_type(name: str) -> T.DataType:
    """The type of a column by its name."""
    return T.LongType() if name in INTEGERS else T.DateType() if name in DATES else T.DoubleType() if name in DOUBLES else T.StringType()


def schema_of(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, column_type(c)) for c in columns])


def filing_tree(spark: SparkSession, root: str) -> DataFrame:
    """Company, year, form, name, extension and content of the files under ``<company>/<year>/<form>/``; annual reports first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    part = lambda i: F.element_at(F.split("path", "/"), -i)
    out = files.select(part(4).alias("company"), part(3).alias("year"), F.lower(part(2)).alias("form"), part(1).alias("name"), F.lower(F.element_at(F.split(part(1), r"\."), -1)).alias("extension"), "content", "length")
    return out.withColumn("form_rank", F.coalesce(*(F.when(F.col("form") == f, F.lit(i)) for i, f in enumerate(("10k", "10q", "8k"))), F.lit(3)))


def loaded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts of the supported files, and the others with the reason, which are collected rather than raised."""
    known = F.col("extension").isin(*SUPPORTED)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    ok = files.where(known).withColumn("raw", text).withColumn("text", F.when(F.col("extension").isin("htm", "html"), html_text(F.col("raw"))).otherwise(F.col("raw"))).drop("content", "raw")
    return ok, files.where(~known).select("company", "year", "form", "name", F.concat(F.lit("unsupported: "), "extension").alias("error"))


def delimited(spark: SparkSession, path: str, name: str, sep: str = ",") -> DataFrame:
    """A delimited file as sentences. A header of numbers only is no header; columns are then column_1 and so on."""
    first = spark.read.text(path).limit(1).first()
    header = bool(first) and not all(_numeric(x) for x in first[0].split(sep))
    df = spark.read.csv(path, sep=sep, header=header)
    df = df if header else df.toDF(*(f"column_{i + 1}" for i in range(len(df.columns))))
    return df.select(row_sentences(df, name).alias("text"))


def _numeric(text: str) -> bool:
    try:
        return float(text.replace(",", "")) is not None
    except ValueError:
        return False


def submissions(raw: DataFrame, column: str = "raw") -> DataFrame:
    """The columnar listing of filings as rows: accession, form, filed, document."""
    kind = "struct<filings:struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,primaryDocument:array<string>>>>"
    r = raw.select(F.from_json(column, kind)["filings"]["recent"].alias("r"))
    zipped = F.arrays_zip(F.col("r.accessionNumber").alias("accession"), F.col("r.form").alias("form"), F.col("r.filingDate").alias("filed"), F.col("r.primaryDocument").alias("document"))
    return r.select(F.explode(zipped).alias("z")).select("z.*")


def to_fetch(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What is wanted and not present, or present and empty."""
    return wanted.join(present.where("length > 0").select(key), key, "left_anti")


def spill(df: DataFrame, path: str, rows: int = 50_000) -> None:
    """A table in files of at most ``rows`` rows."""
    df.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)


def spilled(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A spilled table, or an empty one of the right types if nothing was ever spilled."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def upserted(stored: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of the batch replace stored ones of the same key, the last by order within the batch."""
    latest = first_wins(batch, [key], [F.col(order).desc()])
    return stored.join(latest.select(key), key, "left_anti").unionByName(latest)


def staged(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last record of each staged file, and how many lines of it were unreadable. lines: file, line_no, line."""
    kind = "struct<ticker:string,status:string,timestamp:string,_bad:string>"
    parsed = lines.withColumn("r", F.from_json("line", kind, {"columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("r IS NOT NULL AND r._bad IS NULL")
    last = good.groupBy("file").agg(F.max_by("r", "line_no").alias("r")).select("file", "r.ticker", "r.status", "r.timestamp")
    return last, parsed.groupBy("file").agg(F.count_if(F.col("r").isNull() | F.col("r._bad").isNotNull()).alias("n_bad"))


def schema_diff(spark: SparkSession, df: DataFrame, expected: T.StructType) -> DataFrame:
    """Column, found, expected for columns that are missing, extra, or of another type."""
    rows = lambda s: spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in s], "name string, type string")
    a, b = rows(df.schema).withColumnRenamed("type", "found"), rows(expected).withColumnRenamed("type", "expected")
    return a.join(b, "name", "full_outer").where("NOT found <=> expected")


def rebuilt(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The table in a new schema: columns of the same type keep their values, others begin as null."""
    have = {f.name: f.dataType for f in df.schema}
    return df.select([F.col(f"`{f.name}`") if have.get(f.name) == f.dataType else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def retained(backups: DataFrame, newest: int) -> DataFrame:
    """Backups beyond the newest n."""
    return backups.withColumn("n", F.row_number().over(W.orderBy(F.col("created").desc(), "name"))).where(F.col("n") > newest).drop("n")
