"""Streaming plans, run over what has arrived (group R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..session import new_folder
from ..streaming import loads
from .graph import Graph


@query("SELECT id, min(filing_seq) AS filing_seq FROM filing WHERE id IS NOT NULL GROUP BY 1")
def r3_incremental_load(spark, sf):
    """The table's batches of the first and of later arrival as two files, one micro-batch each."""
    at = new_folder(spark, "arrivals")
    f = Graph(spark, sf).raw("filing").where("id IS NOT NULL").select("id", "filing_seq", F.coalesce("batch_no", F.lit(0)).alias("batch_no"))
    for late in (False, True):
        f.where((F.col("batch_no") > 0) == late).select("id", "filing_seq").coalesce(1).write.mode("append").parquet(f"{at}/part")
    stream = spark.readStream.schema("id string, filing_seq bigint").option("maxFilesPerTrigger", 1).parquet(f"{at}/part")
    return loads.incremental_load(spark, stream, "id", "filing_seq").groupBy("id").agg(F.min("filing_seq").alias("filing_seq"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def r_tumbling_windows(spark, sf):
    """Event-time windows, an extension: a stream into the shared folder, read again."""
    at = new_folder(spark, "windows")
    out = loads.windowed(loads.file_stream(spark, sf, "events", 1000))

    def keep(batch, batch_id):
        batch.select(F.col("w.start").alias("start"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    schema = "start timestamp, event_type string, n bigint, total double, batch int"
    rows = spark.read.schema(schema).option("basePath", f"{at}/out").parquet(f"{at}/out")
    # In update mode the last row of a window holds.
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "x.n", F.round("x.total", 4).alias("total"))


@query("SELECT user_id, count(*) AS n_sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 END AS opens FROM events) WHERE opens = 1 GROUP BY 1")
def r_session_windows(spark, sf):
    """Session windows with a gap of six hours, an extension."""
    e = Graph(spark, sf).raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("n_sessions"))
