import json
import os

from pyspark.sql import functions as F

from ledgerloom.session import shared_dir, written
from ledgerloom.sources import files
from ledgerloom.streaming import loads


def test_filing_tree(spark, tmp_path):
    for form, name, text in (("10k", "a.htm", "<p>Annual</p>"), ("8k", "b.txt", "Current"), ("8k", "c.pdf", "%PDF")):
        d = tmp_path / "aapl" / "2024" / form
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_text(text)
    ok, bad = files.loaded(files.filing_tree(spark, str(tmp_path)))
    assert {(r["company"], r["form"], r["text"]) for r in ok.collect()} == {("aapl", "10k", "Annual"), ("aapl", "8k", "Current")}
    assert [r["error"] for r in bad.collect()] == ["unsupported: pdf"]


def test_delimited(spark, tmp_path):
    (tmp_path / "data.csv").write_text("Region,Quarter,Revenue\nNorth,Q1,10\nSouth,,20\n")
    (tmp_path / "bare.csv").write_text("1,2\n3,4\n")
    assert {r["text"] for r in files.delimited(spark, str(tmp_path / "data.csv"), "data.csv").collect()} == {"Record in [data.csv]: Region is North, Quarter is Q1, Revenue is 10.", "Record in [data.csv]: Region is South, Revenue is 20."}
    assert {r["text"] for r in files.delimited(spark, str(tmp_path / "bare.csv"), "b").collect()} == {"Record in [b]: column_1 is 1, column_2 is 2.", "Record in [b]: column_1 is 3, column_2 is 4."}


def test_submissions_and_staging(spark):
    raw = json.dumps({"filings": {"recent": {"accessionNumber": ["a", "b"], "form": ["10-K", "8-K"], "filingDate": ["2024-01-01", "2024-02-01"], "primaryDocument": ["x", "y"]}}})
    assert {r["form"] for r in files.submissions(spark.createDataFrame([(raw,)], "raw string")).collect()} == {"10-K", "8-K"}
    lines = spark.createDataFrame([("f", 1, '{"ticker": "A", "status": "staged"}'), ("f", 2, '{"ticker": "A", "status": "extracted"}'), ("f", 3, "{broken")], "file string, line_no int, line string")
    last, bad = files.staged(lines)
    assert last.first()["status"] == "extracted" and bad.first()["n_bad"] == 1


def test_spill_upsert_schema(spark, tmp_path):
    df = spark.range(120).select(F.col("id"), F.lit("x").alias("v"))
    files.spill(df, str(tmp_path / "t"), 50)
    assert files.spilled(spark, str(tmp_path / "t"), df.schema).count() == 120
    assert files.spilled(spark, str(tmp_path / "never"), df.schema).count() == 0
    new = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (500, "c", 1)], "id bigint, v string, seq int")
    got = files.upserted(df.withColumn("seq", F.lit(0)), new, "id", "seq")
    assert got.count() == 121 and got.where("id = 5").first()["v"] == "b"
    diff = files.schema_diff(spark, df, files.schema_of(["v", "fiscal_year"]))
    assert {(r["name"], r["found"], r["expected"]) for r in diff.collect()} == {("id", "bigint", None), ("fiscal_year", None, "bigint")}
    assert files.rebuilt(df, files.schema_of(["v", "filing_date"])).dtypes == [("v", "string"), ("filing_date", "date")]


def test_incremental_load_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, seq int").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("id string, seq int").parquet(src)
    at = str(tmp_path / "out")
    assert loads.incremental_load(spark, stream(), "id", "seq", at).count() == 2
    spark.createDataFrame([("b", 9), ("c", 4)], "id string, seq int").coalesce(1).write.mode("append").parquet(src)
    got = loads.incremental_load(spark, stream(), "id", "seq", at)
    assert {(r["id"], r["seq"]) for r in got.collect()} == {("a", 1), ("b", 2), ("c", 4)}


def test_a_replayed_batch_leaves_the_table_as_it_was(spark, tmp_path):
    src, at = tmp_path / "src", tmp_path / "out"
    for rows in ([("a", 1), ("b", 2)], [("b", 9), ("c", 4)]):
        spark.createDataFrame(rows, "id string, seq int").coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema("id string, seq int").option("maxFilesPerTrigger", 1).parquet(str(src))
    before = {tuple(r) for r in loads.incremental_load(spark, stream(), "id", "seq", str(at)).collect()}
    assert len(before) == 3
    marks = sorted(p for p in (at / "progress/commits").iterdir() if p.name.isdigit())
    assert len(marks) == 2  # two micro-batches
    marks[-1].unlink()  # the last batch was written, but its commit was lost
    (at / "progress/commits" / f".{marks[-1].name}.crc").unlink(missing_ok=True)
    assert {tuple(r) for r in loads.incremental_load(spark, stream(), "id", "seq", str(at)).collect()} == before


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    kind = "ts string, event_type string, value double"
    seen = set()
    for n, rows in enumerate(([("2024-01-01 10:05:00", "x", 1.0)], [("2024-01-01 14:00:00", "x", 2.0)], [("2024-01-01 14:01:00", "x", 2.0)], [("2024-01-01 10:10:00", "x", 5.0), ("2024-01-01 13:55:00", "x", 3.0)], [("2024-01-01 18:00:00", "x", 1.0)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        for f in set(tmp_path.glob("src/*.parquet")) - seen:
            os.utime(f, (1_700_000_000 + 60 * n,) * 2)  # the order of arrival
            seen.add(f)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    keep = lambda b, i: b.select(F.col("w.start").cast("string").alias("start"), "n", "total").write.mode("append").parquet(out)
    loads.windowed(stream).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    # The row of 10:10 arrives after the window of 10:00 was closed; that of 13:55 within the ten minutes that are waited.
    assert {("2024-01-01 10:00:00", 1, 1.0), ("2024-01-01 13:00:00", 1, 3.0), ("2024-01-01 14:00:00", 2, 4.0)} <= got and len(got) <= 4


def test_transitions(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [("A", "staged", 1), ("A", "extracted", 2), ("A", "failed", 3), ("B", "extracted", 1), ("B", "staged", 2)]
    spark.createDataFrame(rows, "ticker string, status string, at int").write.parquet(src)
    q = loads.transitions(spark.readStream.schema("ticker string, status string, at int").parquet(src))
    keep = lambda b, i: b.write.mode("append").parquet(out)
    q.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {("A", "extracted", 1), ("B", "staged", 1)}


def test_written_tables_go_to_the_shared_folder(spark):
    df = written(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and all(f.startswith(shared_dir(spark)) or f.startswith("file:") for f in df.inputFiles())


def test_the_core_needs_no_llm_folder():
    import ledgerloom.queries as q

    assert "report_metric_by_company" in q.QUERIES and set(q.ORACLE) <= set(q.QUERIES)
